"""JSON answers of media services as tables of candidates.

Answers are rows with a `body`, fetched by whatever fills the folder they are read from. A body
that lacks its list is an error, as it does not say that nothing was found; entries that lack what a
candidate needs are left out. Wanted are rows (title, platform); a game is theirs only under the same
name, whatever its case and punctuation.
"""

from __future__ import annotations

from lodestack.functions import text
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of every table of candidates.
CANDIDATE = ["candidate_id", "title", "platform", "region", "edition", "asset_type", "label", "source_url", "filename"]

#: Names by which a service lists platforms of other words (fixed values).
SCREENSHOT_ALIASES = {
    "Nintendo - Nintendo Entertainment System": ["NES"],
    "Nintendo - Super Nintendo Entertainment System": ["SNES"],
    "Sega - Mega Drive - Genesis": ["Genesis"],
    "Sega - Master System - Mark III": ["SEGA Master System"],
    "Sega - Mega-CD - Sega CD": ["SEGA CD"],
    "Sony - PlayStation Portable": ["PSP"],
    "Sony - PlayStation Vita": ["PS Vita"],
    "Panasonic - 3DO Interactive Multiplayer": ["3DO"],
}
#: The same of the service that lists box art (fixed values).
BOXART_ALIASES = {
    "Nintendo - Super Nintendo Entertainment System": ["Super Nintendo (SNES)"],
    "Sega - Mega Drive - Genesis": ["Sega Genesis", "Sega Mega Drive"],
    "Sega - Mega-CD - Sega CD": ["Sega CD"],
    "Sega - Master System - Mark III": ["Sega Master System"],
    "NEC - PC Engine - TurboGrafx-16": ["TurboGrafx 16"],
    "NEC - PC Engine CD - TurboGrafx-CD": ["TurboGrafx CD"],
    "Sony - PlayStation Portable": ["Sony PSP"],
    "Bandai - WonderSwan": ["WonderSwan"],
    "Bandai - WonderSwan Color": ["WonderSwan Color"],
    "SNK - Neo Geo Pocket": ["Neo Geo Pocket"],
    "SNK - Neo Geo Pocket Color": ["Neo Geo Pocket Color"],
}
#: Kinds of box-art images: type, side (null: any) and asset type (fixed values).
BOXART_KINDS = [
    ("boxart", "front", "box_front"),
    ("boxart", "back", "box_back"),
    ("screenshot", None, "screenshot"),
    ("titlescreen", None, "title_screen"),
    ("clearlogo", None, "logo"),
    ("fanart", None, "wallpaper_artwork"),
]
#: Asset types of the voted collections (fixed values).
COLLECTIONS = {"logos": "logo", "icons": "icon", "heroes": "wallpaper_artwork"}
MEDIA_HOST = "media.rawg.io"
RAW_HOST = "raw.githubusercontent.com"


def _listed(c: Column, what: str) -> Column:
    return F.coalesce(c, F.raise_error(F.concat(F.lit(f"an answer without its {what}: "), F.coalesce(F.substring("body", 1, 200), F.lit("null")))))


def _part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def _filename(url: Column) -> Column:
    return F.nullif(F.element_at(F.split(_part(url, "PATH"), "/"), -1), F.lit(""))


def _candidates(rows: DataFrame) -> DataFrame:
    """One row per candidate id, of a public location with a file name; of several the lowest title and platform."""
    rows = rows.withColumn("filename", _filename(F.col("source_url"))).where((_part(F.col("source_url"), "PROTOCOL") == "https") & F.col("filename").isNotNull())
    full = rows.withColumns({"region": F.lit("Unknown"), "edition": F.lit("Unspecified")})
    kept = [c for c in CANDIDATE if c != "candidate_id"]
    return full.groupBy("candidate_id").agg(F.min(F.struct("title", "platform", *[c for c in kept if c not in ("title", "platform")])).alias("c")).select("candidate_id", *[F.col(f"c.{c}") for c in kept])


def plain_words(platform: Column) -> Column:
    """The words of a platform's name without what stands in parentheses."""
    return text.word_set(F.regexp_replace(platform, r"\([^()]*\)?", " "))


def same_platforms(wanted: DataFrame, listed: DataFrame, aliases: dict[str, list[str]], without_maker: bool) -> DataFrame:
    """Pairs of a wanted platform and a listed one (its key in `listed_id`) of the same words. A platform
    with aliases goes by these alone; the maker may be missing where `without_maker`; otherwise the
    listed one may have an abbreviation in parentheses. Both sides meet on equal sets of words."""
    names = wanted.select("platform").distinct().withColumn("words", text.word_set(F.col("platform")))
    table = [(catalog, name) for catalog, others in aliases.items() for name in others]
    alias = names.sparkSession.createDataFrame(table, "catalog string, name string")
    brief = text.word_set if without_maker else plain_words
    alias = alias.select(text.word_set(F.col("catalog")).alias("words"), brief(F.col("name")).alias("key"))
    own = F.array(F.col("words"), text.word_set(text.maker_and_name(F.col("platform"))["name"])) if without_maker else F.array("words")
    joined = names.join(F.broadcast(alias), "words", "left")
    keys = joined.select("platform", F.explode(F.when(F.col("key").isNotNull(), F.array("key")).otherwise(own)).alias("key"))
    theirs = F.array(text.word_set(F.col("name"))) if without_maker else F.array(text.word_set(F.col("name")), plain_words(F.col("name")))
    return keys.join(listed.select("listed_id", F.explode(theirs).alias("key")), "key").select("platform", "listed_id").distinct()


def screenshots(wanted: DataFrame, answers: DataFrame, asset_types: list[str] | None = None) -> DataFrame:
    """Backgrounds and screenshots of answers (title, body) to one search per title, for every wanted
    platform that the game is listed on; an image of several platforms is a candidate of each."""
    shape = "results array<struct<id bigint, name string, background_image string, platforms array<struct<platform: struct<name: string>>>, short_screenshots array<struct<id: bigint, image: string>>>>"
    games = answers.select("title", F.explode(_listed(F.from_json("body", shape)["results"], "games")).alias("g"))
    games = games.where(F.col("g.id").isNotNull() & (text.name_key(F.col("g.name")) == text.name_key(F.col("title")))).select("title", "g.*")
    listed = games.select("title", "id", F.explode("platforms").alias("p")).select("title", "id", F.col("p.platform.name").alias("name")).where("name is not null").withColumn("listed_id", F.col("name"))
    pairs = same_platforms(wanted, listed.select("listed_id", "name").distinct(), SCREENSHOT_ALIASES, True)
    found = wanted.join(games, "title").join(listed.select("title", "id", "listed_id"), ["title", "id"]).join(pairs, ["platform", "listed_id"], "left_semi").dropDuplicates(["title", "platform", "id"])
    key = text.name_key(F.col("platform"))
    image = lambda kind, id_, label, url: F.struct(F.lit(kind).alias("asset_type"), id_.alias("candidate_id"), F.lit(label).alias("label"), url.alias("source_url"))
    back = F.array(image("wallpaper_artwork", F.concat(key, F.lit("/games/"), F.col("id").cast("string"), F.lit("/background")), "background", F.col("background_image")))
    shots = F.transform(F.coalesce("short_screenshots", F.array()), lambda s: image("screenshot", F.concat(key, F.lit("/screenshots/"), s["id"].cast("string")), "screenshot", s["image"]))
    rows = found.select("title", "platform", F.inline(F.concat(back, shots)))
    public = (_part(F.col("source_url"), "HOST") == MEDIA_HOST) & _part(F.col("source_url"), "QUERY").isNull() & _part(F.col("source_url"), "REF").isNull()
    rows = rows.where(F.col("candidate_id").isNotNull() & public)
    return _candidates(rows.where(F.col("asset_type").isin(*asset_types)) if asset_types is not None else rows)


def boxart(wanted: DataFrame, platforms: DataFrame, searches: DataFrame, images: DataFrame) -> DataFrame:
    """Box art of games found by name: `platforms` is one body that lists all, `searches` (title, body)
    the pages of each search, `images` (body) the pages of images by game."""
    named = platforms.select(F.explode(F.map_values(_listed(F.from_json("body", "data struct<platforms: map<string, struct<id: bigint, name: string>>>")["data"]["platforms"], "platforms"))).alias("p"))
    pairs = same_platforms(wanted, named.select(F.col("p.id").alias("listed_id"), F.col("p.name").alias("name")).where("listed_id is not null and name is not null"), BOXART_ALIASES, False)
    games = searches.select("title", F.explode(_listed(F.from_json("body", "data struct<games: array<struct<id: bigint, game_title: string, platform: bigint>>>")["data"]["games"], "games")).alias("g"))
    games = games.where(text.name_key(F.col("g.game_title")) == text.name_key(F.col("title"))).select("title", F.col("g.id").alias("id"), F.col("g.platform").alias("listed_id"))
    found = wanted.join(pairs, "platform").join(games, ["title", "listed_id"]).groupBy("id").agg(F.min(F.struct("title", "platform")).alias("w"))
    shape = "data struct<base_url: struct<original: string>, images: map<string, array<struct<id: bigint, type: string, side: string, filename: string>>>>"
    page = images.select("body", F.from_json("body", shape)["data"].alias("d")).select(_listed(F.col("d.base_url.original"), "location").alias("base"), F.explode(_listed(F.col("d.images"), "images")).alias("game", "list"))
    rows = page.select("base", F.col("game").try_cast("bigint").alias("id"), F.inline("list").alias("image", "type", "side", "file"))
    kinds = images.sparkSession.createDataFrame(BOXART_KINDS, "type string, of_side string, asset_type string")
    rows = rows.join(F.broadcast(kinds), "type").where("of_side is null or of_side = side").where("image is not null and file is not null")
    url = F.when(F.col("file").rlike("^[a-z]+://"), F.col("file")).otherwise(F.concat(F.regexp_replace("base", "/[^/]*$", "/"), F.col("file")))
    return _candidates(rows.join(found, "id").select(
        F.concat(F.lit("image/"), F.col("image").cast("string")).alias("candidate_id"), "w.title", "w.platform", "asset_type", F.concat_ws(": ", "type", "side").alias("label"), url.alias("source_url"),
    ))


def voted(wanted: DataFrame, searches: DataFrame, media: DataFrame) -> DataFrame:
    """Media of the first game that a search (title, body) names exactly so: `media` has (game_id,
    collection, body). An image is a candidate of each wanted platform."""
    told = F.from_json("body", "success boolean, data array<struct<id: bigint, name: string>>")
    hits = searches.select("title", F.posexplode(F.when(F.coalesce(told["success"], F.lit(False)), F.coalesce(told["data"], F.array())).otherwise(_listed(F.lit(None), "success"))).alias("pos", "g"))
    hits = hits.where((text.name_key(F.col("g.name")) == text.name_key(F.col("title"))) & F.col("g.id").isNotNull()).groupBy("title").agg(F.min_by("g.id", "pos").alias("game_id"))
    told = F.from_json("body", "success boolean, data array<struct<id: bigint, url: string, style: string>>")
    items = media.select("game_id", "collection", F.inline(F.when(F.coalesce(told["success"], F.lit(False)), told["data"]).otherwise(_listed(F.lit(None), "success"))))
    rows = wanted.join(hits, "title").join(items, "game_id").where("id is not null")
    kind = F.create_map(*[F.lit(x) for pair in COLLECTIONS.items() for x in pair])[F.col("collection")]
    own_id = F.concat(text.name_key(F.col("platform")), F.lit("/"), F.col("collection"), F.lit("/"), F.col("id").cast("string"))
    return _candidates(rows.select(own_id.alias("candidate_id"), "title", "platform", kind.alias("asset_type"), F.concat_ws(": ", "collection", "style").alias("label"), F.col("url").alias("source_url")).where("asset_type is not null"))


def listed_lists(answers: DataFrame) -> DataFrame:
    """directory, platform and location of the datafiles that directory listings (directory, body) name."""
    files = answers.select("directory", F.inline(_listed(F.from_json("body", "array<struct<type: string, name: string, download_url: string>>"), "files")))
    url = F.col("download_url")
    kept = files.where((F.col("type") == "file") & F.col("name").endswith(".dat") & (_part(url, "PROTOCOL") == "https") & (_part(url, "HOST") == RAW_HOST))
    return kept.select("directory", F.regexp_replace("name", r"\.dat$", "").alias("platform"), url.alias("location"))


def list_of(platforms: DataFrame, lists: DataFrame, directories: list[str]) -> DataFrame:
    """The list of each platform: of its exact name in the first directory that has one, else the
    first whose name has the same letters and digits."""
    order = F.array_position(F.array(*[F.lit(d) for d in directories]), F.col("directory"))
    theirs = lists.where(order > 0).select(F.col("platform").alias("named"), text.name_key(F.col("platform")).alias("key"), "location", order.alias("rank"))
    met = platforms.select("platform", text.name_key(F.col("platform")).alias("key")).distinct().join(theirs, "key")
    return met.groupBy("platform").agg(F.min_by(F.struct("named", "location"), F.struct(F.col("named") != F.col("platform"), "rank", "named")).alias("l")).select("platform", "l.named", "l.location")


_TAGS = r"^(.*?)((?:\s*(?:\([^(]*\)|\[[^\[]*\]))*)\s*$"


def listed_manual(title: Column) -> Column:
    """title, platform and region tags of a listed manual, by either scheme: `<platform> Manual:
    <title> (tag)[tag]...` or `<title> [<serial>](<platform>)(<region>) -Manual...`; null otherwise."""
    at = F.locate(" Manual: ", title)
    rest = F.substring(title, at + 9, F.length(title))
    name = text.trimmed(F.regexp_extract(rest, _TAGS, 1))
    first = F.when(name != "", F.struct(name.alias("title"), F.substring(title, F.lit(1), at - 1).alias("platform"), F.regexp_extract_all(F.regexp_extract(rest, _TAGS, 2), F.lit(r"\(([^(]*)\)"), F.lit(1)).alias("tags")))
    scheme = r"^(.*?)\[[^\[\]]*\]\((.*?)\)\((.*?)\) -(.*)$"
    other = text.trimmed(F.regexp_extract(title, scheme, 1))
    manual = F.exists(F.split(F.regexp_extract(title, scheme, 4), "[,(]"), lambda s: text.normalised(s) == "manual")
    second = F.when((other != "") & manual, F.struct(other.alias("title"), F.regexp_extract(title, scheme, 2).alias("platform"), F.array(F.regexp_extract(title, scheme, 3)).alias("tags")))
    return F.when(at > 0, first).otherwise(second)


#: Codes of regions in tags of manuals (fixed values).
MANUAL_REGIONS = {
    "US": "USA", "JP": "Japan", "EU": "Europe", "AS": "Asia", "AU": "Australia", "BR": "Brazil", "CA": "Canada", "CN": "China", "DE": "Germany", "ES": "Spain",
    "FR": "France", "GB": "UK", "HK": "Hong Kong", "IT": "Italy", "KR": "Korea", "NL": "Netherlands", "PT": "Portugal", "SE": "Sweden", "TW": "Taiwan", "UK": "UK",
}


def manual_region(tags: Column) -> Column:
    """The regions of the first tag all of whose codes are known; null where there is none."""
    table = F.create_map(*[F.lit(x) for pair in MANUAL_REGIONS.items() for x in pair])
    named = F.transform(tags, lambda t: F.transform(F.split(t, ","), lambda code: F.try_element_at(table, text.trimmed(code))))
    return F.array_join(F.get(F.filter(named, lambda r: F.forall(r, lambda x: x.isNotNull())), 0), ", ")
