"""Dimension tables (fixed values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Asset types in the order of their ordinals, with their families.
ASSET_TYPES = [
    ("box_front", "packaging"), ("box_back", "packaging"), ("spine", "packaging"), ("box_3d_render", "packaging"),
    ("cartridge_front", "physical_media"), ("cartridge_back", "physical_media"), ("disc", "physical_media"), ("pcb", "physical_media"),
    ("manual", "documentation"), ("map", "documentation"),
    ("screenshot", "digital_media"), ("title_screen", "digital_media"), ("gameplay_video", "digital_media"), ("logo", "digital_media"), ("icon", "digital_media"), ("wallpaper_artwork", "digital_media"),
    ("flyer", "promotional_and_historical"),
    ("arcade_cabinet", "hardware_arcade"), ("control_panel", "hardware_arcade"), ("marquee", "hardware_arcade"),
]

#: What each coverage profile adds for a packaging family; `cartridge` is met by cartridge_front.
PROFILES = {
    "cardboard_box": [["box_front", "box_back", "spine"], ["cartridge_front", "manual"], ["insert"]],
    "jewel_case": [["box_front", "box_back", "spine"], ["disc", "manual"], ["insert"]],
    "keep_case": [["box_front", "box_back", "spine"], ["disc"], ["manual", "insert"]],
    "cartridge_case": [["box_front", "box_back", "spine"], ["cartridge_front"], ["manual", "insert"]],
    "arcade_board": [["marquee"], ["pcb"], ["flyer", "control_panel", "bezel"]],
    "digital_only": [["box_front"], [], ["logo", "icon"]],
}
PROFILE_NAMES = ["packaging", "physical", "archival"]

#: Platforms by packaging family, as release lists name them (fixed values).
PLATFORMS = {
    "cardboard_box": [
        "Atari - 2600", "Atari - 5200", "Atari - 7800", "Nintendo - Game Boy", "Nintendo - Game Boy Advance", "Nintendo - Game Boy Color",
        "Nintendo - Nintendo 64", "Nintendo - Nintendo Entertainment System", "Nintendo - Super Nintendo Entertainment System", "Nintendo - Virtual Boy",
    ],
    "jewel_case": [
        "NEC - PC Engine CD - TurboGrafx-CD", "Philips - CD-i", "Sega - Dreamcast", "Sega - Mega-CD - Sega CD", "Sega - Saturn", "SNK - Neo Geo CD",
        "Sony - PlayStation", "The 3DO Company - 3DO",
    ],
    "keep_case": [
        "Microsoft - Xbox", "Microsoft - Xbox 360", "Microsoft - Xbox One", "Nintendo - GameCube", "Nintendo - Wii", "Nintendo - Wii U",
        "Sony - PlayStation 2", "Sony - PlayStation 3", "Sony - PlayStation 4", "Sony - PlayStation Portable",
    ],
    "cartridge_case": ["Nintendo - Nintendo 3DS", "Nintendo - Nintendo DS", "Nintendo - Nintendo DSi", "Nintendo - Nintendo Switch", "Sony - PlayStation Vita"],
    "arcade_board": ["FBNeo - Arcade Games", "MAME"],
}
DIGITAL_SUFFIXES = ["(Digital)", "(PSN)"]

#: The language that a region implies (fixed values).
LANGUAGE_OF_REGION = {
    "Argentina": "Es", "Asia": "En", "Australia": "En", "Austria": "De", "Brazil": "Pt", "Bulgaria": "Bg", "Canada": "En", "Chile": "Es", "China": "Zh",
    "Croatia": "Hr", "Czech": "Cs", "Denmark": "Da", "Europe": "En", "Finland": "Fi", "France": "Fr", "Germany": "De", "Greece": "El", "Hong Kong": "Zh",
    "Hungary": "Hu", "India": "En", "Ireland": "En", "Israel": "He", "Italy": "It", "Japan": "Ja", "Korea": "Ko", "Latin America": "Es", "Mexico": "Es",
    "Netherlands": "Nl", "New Zealand": "En", "Norway": "No", "Peru": "Es", "Poland": "Pl", "Portugal": "Pt", "Russia": "Ru", "Slovakia": "Sk", "Spain": "Es",
    "Sweden": "Sv", "Taiwan": "Zh", "Turkey": "Tr", "UK": "En", "USA": "En", "United Kingdom": "En", "World": "En",
}
#: Codes that a language tag is made of (fixed values).
LANGUAGE_CODES = (
    "Af Ar Bg Ca Cs Cy Da De El En Es Et Eu Fa Fi Fr Ga Gd He Hi Hr Hu Id Is It Ja Ko Lt Lv Ms Nl No Pl Pt Ro Ru Sk Sl Sq Sr Sv Th Tr Uk Vi Zh"
).split()

#: Countries by the region whose releases they share (fixed values, lower case).
COUNTRIES = {
    "europe": [
        "albania", "andorra", "austria", "belarus", "belgium", "bosnia and herzegovina", "bulgaria", "croatia", "cyprus", "czech", "czech republic", "czechia",
        "denmark", "england", "estonia", "finland", "france", "germany", "great britain", "greece", "hungary", "iceland", "ireland", "italy", "latvia",
        "liechtenstein", "lithuania", "luxembourg", "malta", "moldova", "monaco", "montenegro", "netherlands", "north macedonia", "norway", "poland", "portugal",
        "romania", "san marino", "scandinavia", "scotland", "serbia", "slovakia", "slovenia", "spain", "sweden", "switzerland", "uk", "ukraine",
        "united kingdom", "wales", "australia", "new zealand", "oceania",
    ],
    "usa": ["canada", "north america"],
    "asia": ["hong kong", "taiwan", "singapore", "malaysia"],
    "latin america": ["argentina", "chile", "colombia", "mexico", "peru"],
}
REGION_OF_COUNTRY = {c: r for r, cs in COUNTRIES.items() for c in cs}

#: What asset types are called where it isn't their name with capitals (fixed values).
LABELS = {t: t.replace("_", " ").title() for t, _ in ASSET_TYPES} | {"box_3d_render": "Box 3D Render", "pcb": "PCB", "wallpaper_artwork": "Wallpaper / Artwork"}
#: File name endings by media type (fixed values).
EXTENSIONS = {
    "image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/bmp": "bmp", "image/tiff": "tif", "image/avif": "avif",
    "image/heic": "heic", "image/heif": "heif", "image/jxl": "jxl", "image/qoi": "qoi", "image/vnd.radiance": "hdr", "image/x-exr": "exr",
    "image/x-farbfeld": "ff", "image/x-icon": "ico", "image/x-ilbm": "iff", "image/x-portable-anymap": "pnm", "image/x-tga": "tga",
    "application/pdf": "pdf", "video/mp4": "mp4", "video/webm": "webm", "video/quicktime": "mov", "model/gltf-binary": "glb",
}
#: Words with which the tags of games begin that were not sold (fixed values).
NOT_RETAIL = ["proto", "beta", "demo", "sample", "pirate", "hack", "aftermarket", "program"]


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value of a small fixed table, null where the key isn't in it."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def asset_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, t, f) for n, (t, f) in enumerate(ASSET_TYPES)], "ordinal int, asset_type string, family string")


def profiles(spark: SparkSession) -> DataFrame:
    """What each profile asks for: what it adds and what those before it do; no row for a profile that adds nothing."""
    rows = [(f, PROFILE_NAMES[n], n, t) for f, lists in PROFILES.items() for n, ts in enumerate(lists) if ts for own in lists[: n + 1] for t in own]
    return spark.createDataFrame(rows, "family string, profile string, position int, asset_type string")


#: Platforms of software lists by the list's short name (fixed values).
SOFTWARE_LISTS = {
    "32x": "Sega - 32X", "a2600": "Atari - 2600", "a7800": "Atari - 7800", "coleco": "Coleco - ColecoVision", "dc": "Sega - Dreamcast",
    "gameboy": "Nintendo - Game Boy", "gamegear": "Sega - Game Gear", "gba": "Nintendo - Game Boy Advance", "gbcolor": "Nintendo - Game Boy Color",
    "genesis": "Sega - Mega Drive - Genesis", "intv": "Mattel - Intellivision", "lynx": "Atari - Lynx", "megacd": "Sega - Mega-CD - Sega CD",
    "megadriv": "Sega - Mega Drive - Genesis", "n64": "Nintendo - Nintendo 64", "nes": "Nintendo - Nintendo Entertainment System",
    "ngp": "SNK - Neo Geo Pocket", "ngpc": "SNK - Neo Geo Pocket Color", "pce": "NEC - PC Engine - TurboGrafx 16", "psx": "Sony - PlayStation",
    "saturn": "Sega - Saturn", "segacd": "Sega - Mega-CD - Sega CD", "sg1000": "Sega - SG-1000", "sms": "Sega - Master System - Mark III",
    "snes": "Nintendo - Super Nintendo Entertainment System", "tg16": "NEC - PC Engine - TurboGrafx 16", "vboy": "Nintendo - Virtual Boy",
    "wscolor": "Bandai - WonderSwan Color", "wswan": "Bandai - WonderSwan",
}
#: Regions as software lists abbreviate them (fixed values).
SHORT_REGIONS = {
    "Aus": "Australia", "Bra": "Brazil", "Can": "Canada", "Chn": "China", "Den": "Denmark", "Euro": "Europe", "Fin": "Finland", "Fra": "France",
    "Ger": "Germany", "Hol": "Netherlands", "Ita": "Italy", "Jpn": "Japan", "Kor": "Korea", "Nor": "Norway", "Por": "Portugal", "Rus": "Russia",
    "Spa": "Spain", "Swe": "Sweden", "Tai": "Taiwan",
}
#: Regions that software lists spell out (fixed values).
LONG_REGIONS = "Asia Australia Brazil Canada China Europe France Germany Italy Japan Korea Netherlands Spain Sweden Taiwan UK USA World".split()
#: Platforms that share an atlas of maps with others: the atlas, and the words that say the platform (fixed values).
SHARED_ATLASES = {
    "Nintendo - Game Boy": ("GB-GBC", ["Game Boy", "GB"]),
    "Nintendo - Game Boy Color": ("GB-GBC", ["Game Boy Color", "GBC"]),
    "Nintendo - Nintendo Entertainment System": ("NES", ["NES", "Famicom"]),
    "Nintendo - Family Computer Disk System": ("NES", ["Famicom Disk System", "Disk System", "FDS"]),
    "NEC - PC Engine - TurboGrafx-16": ("TG16", ["TurboGrafx-16", "PC Engine", "TG16"]),
    "NEC - PC Engine CD - TurboGrafx-CD": ("TG16", ["TurboGrafx-CD", "PC Engine CD", "CD-ROM2"]),
    "SNK - Neo Geo Pocket": ("NGP-NGPC", ["Neo Geo Pocket", "NGP"]),
    "SNK - Neo Geo Pocket Color": ("NGP-NGPC", ["Neo Geo Pocket Color", "NGPC"]),
    "Bandai - WonderSwan": ("WS-WSC", ["WonderSwan", "WS"]),
    "Bandai - WonderSwan Color": ("WS-WSC", ["WonderSwan Color", "WSC"]),
}
