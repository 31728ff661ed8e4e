"""Keys and name grammar as Spark expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestack.functions import dims

#: Qualifiers of platform names that say how dumps are stored (fixed values).
STORAGE_QUALIFIERS = ["Headered", "Headerless", "Decrypted", "Encrypted", "BigEndian", "ByteSwapped", "LittleEndian", "Parent-Clone"]
_TAG = r" \(((?:(?! \().)+)\)(?=\s* \(|\s*$)"
_NAME = r"^(.*?)((?:\s* \((?:(?! \().)+\))*)\s*$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalised(c: Column) -> Column:
    """Unicode trim and lower case: equality of names."""
    return F.lower(trimmed(c))


def comparable(c: Column) -> Column:
    """Without any white space, lower case: equality of claims."""
    return F.lower(F.regexp_replace(c, r"(?U)\s", ""))


def name_key(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}]", ""))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else: equality of regions, platforms and media types."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cell_text(c: Column) -> Column:
    """White space collapsed."""
    return trimmed(F.regexp_replace(c, r"(?U)\s+", " "))


ARTICLES = ["the", "a", "an"]


def title_key(c: Column) -> Column:
    """A title whatever its case, spacing and subtitle sign, each part's article in front ("Legend, The - Next" is "the legend: next")."""
    parts = F.split(F.replace(F.lower(cell_text(c)), F.lit(": "), F.lit(" - ")), " - ")
    moved = lambda p: F.regexp_replace(p, rf"^(.*), ({'|'.join(ARTICLES)})$", "$2 $1")
    return F.array_join(F.transform(parts, moved), ": ")


def match_key(c: Column) -> Column:
    return name_key(title_key(c))


#: Numerals of sequels, from one to twenty (fixed values).
ROMAN = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split()


def sequel_key(c: Column) -> Column:
    """Letters and digits of a title with its article in front and Roman numerals as digits."""
    front = F.regexp_replace(trimmed(c), r"^(.*), (The|A|An)$", "$2 $1")
    words = F.filter(F.split(front, r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")
    digits = {r: str(n) for n, r in enumerate(ROMAN, 1)}
    return F.array_join(F.transform(words, lambda w: F.coalesce(dims.lookup(digits, F.lower(w)), F.lower(w))), "")


def filed_title(c: Column) -> Column:
    """A title as release lists file it: the article behind the main title, subtitles after a dash."""
    flat = F.replace(cell_text(c), F.lit(": "), F.lit(" - "))
    at = F.locate(" - ", flat)
    main = F.when(at > 0, F.substring(flat, F.lit(1), at - 1)).otherwise(flat)
    rest = F.when(at > 0, F.substring(flat, at, F.length(flat))).otherwise("")
    return F.concat(F.regexp_replace(main, rf"(?i)^({'|'.join(ARTICLES)}) (.*)$", "$2, $1"), rest)


def listed_title(c: Column) -> Column:
    """A listed title without the number of discs, dashes and no-break spaces behind it."""
    plain = F.replace(c, F.lit("\u00a0"), F.lit(" "))
    cut = F.regexp_replace(plain, r"(?is)\[(?=[^\[]*disc)[^\[]*$", "")
    return trimmed(F.regexp_replace(trimmed(cut), "-+$", ""))


def word_set(c: Column) -> Column:
    """The distinct words of a name in order: names of one set are one platform."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")))


def maker_and_name(c: Column) -> Column:
    """maker and name of a platform written "Maker - Name"; no maker where there is no dash."""
    at = F.locate(" - ", c)
    return F.struct(F.when(at > 0, F.substring(c, F.lit(1), at - 1)).alias("maker"), F.when(at > 0, F.substring(c, at + 3, F.length(c))).otherwise(c).alias("name"))


def release_title(c: Column) -> Column:
    return F.regexp_extract(c, _NAME, 1)


def release_tags(c: Column) -> Column:
    """The trailing ` (tag)` groups of a release name, in order."""
    return F.regexp_extract_all(F.regexp_extract(c, _NAME, 2), F.lit(_TAG), F.lit(1))


#: Marks of unfinished, unsold or unlicensed games (fixed values).
STATUS = "Alpha Beta Demo Kiosk Preview Promo Proto Prototype Sample Test Debug Pre-Release Prerelease Unl Unlicensed Pirate Aftermarket Homebrew".split()
#: Words that tags of editions hold (fixed values).
EDITION = ["Edition", "Bundle", "Pack", "Disc", "Disk", "Side", "Alt"]


def is_revision(tag: Column) -> Column:
    return tag.rlike(r"^(Rev |Revision )|^(v|Version )[0-9][0-9._-]*$")


def is_status(tag: Column) -> Column:
    return tag.rlike(rf"^({'|'.join(STATUS)})($|[ -])")


def is_language_list(tag: Column) -> Column:
    return F.forall(F.split(tag, ","), lambda p: trimmed(p).rlike("^[A-Z][a-z]{1,2}$"))


def is_date(tag: Column) -> Column:
    return tag.rlike("^[0-9]{4}-")


def is_edition(tag: Column) -> Column:
    return tag.rlike("|".join(EDITION))


def parsed_release_name(c: Column) -> Column:
    """title, region, revision and edition of a release name. The region is the first tag unless that
    is of another class; all other tags, a revision included, are the edition."""
    tags = release_tags(c)
    first = F.get(tags, 0)
    other = is_revision(first) | is_status(first) | is_language_list(first) | is_date(first) | is_edition(first)
    named = first.isNotNull() & ~F.coalesce(other, F.lit(True))
    edition = F.array_join(F.when(named, F.slice(tags, 2, F.greatest(F.size(tags) - 1, F.lit(0)))).otherwise(tags), " · ")
    return F.struct(
        release_title(c).alias("title"), F.when(named, first).otherwise("Unknown").alias("region"),
        F.get(F.filter(tags, is_revision), 0).alias("revision"), F.coalesce(F.nullif(edition, F.lit("")), F.lit("Standard")).alias("edition"),
    )


def atlas_title(title: Column, atlas: Column) -> Column:
    """title and platform of a game on an atlas that several platforms share: words in parentheses at its end
    that say one of them are no part of the title; no platform where there are none."""
    said = {f"{a}|{''.join(ch for ch in w.lower() if ch.isalnum())}": p for p, (a, words) in dims.SHARED_ATLASES.items() for w in words}
    parts = r"(?s)^(.*) \(((?:(?! \().)*)\)$"
    platform = dims.lookup(said, F.concat(atlas, F.lit("|"), name_key(F.regexp_extract(title, parts, 2))))
    base = F.regexp_replace(F.regexp_extract(title, parts, 1), r"(?U)\s+$", "")
    return F.struct(F.when(platform.isNotNull(), base).otherwise(title).alias("title"), platform.alias("platform"))


def software_name(c: Column) -> Column:
    """title, region, revision and edition of a software entry's description, as `Zelda (Jpn, Rev. A)`: the
    parts of the first tag that are regions, abbreviated or spelt out, and all other parts as the edition,
    `Rev. A` written `Rev A`. The last revision counts."""
    known = dims.SHORT_REGIONS | {r: r for r in [*dims.LONG_REGIONS, *dims.SHORT_REGIONS.values()]}
    regions = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])
    parts = F.flatten(F.transform(release_tags(c), lambda tag, i: F.transform(F.filter(F.transform(F.split(tag, ","), trimmed), lambda p: p != ""), lambda p: F.struct(p.alias("part"), F.when(i == 0, F.try_element_at(regions, p)).alias("region")))))
    rest = F.transform(F.filter(parts, lambda x: x["region"].isNull()), lambda x: F.regexp_replace(x["part"], r"^Rev\. ", "Rev "))
    region = F.array_join(F.array_compact(F.transform(parts, lambda x: x["region"])), ", ")
    return F.struct(
        release_title(c).alias("title"), F.coalesce(F.nullif(region, F.lit("")), F.lit("Unknown")).alias("region"),
        F.get(F.reverse(F.filter(rest, is_revision)), F.lit(0)).alias("revision"), F.coalesce(F.nullif(F.array_join(rest, " · "), F.lit("")), F.lit("Standard")).alias("edition"),
    )


def described_name(title: Column, region: Column, edition: Column) -> Column:
    """A release's name from its parts: tags of its region and edition where these say anything."""
    tags = F.array_join(F.transform(F.split(edition, " · "), lambda t: F.concat(F.lit(" ("), trimmed(t), F.lit(")"))), "")
    region_tag = F.when(ascii_lower(region) == "unknown", "").otherwise(F.concat(F.lit(" ("), region, F.lit(")")))
    return F.concat(title, region_tag, F.when(ascii_lower(edition).isin("standard", "unspecified"), "").otherwise(tags))


def listed_languages(name: Column) -> Column:
    """The languages of the first tag that lists some; null where none does."""
    coded = lambda t: F.forall(F.split(t, ","), lambda p: F.substring_index(trimmed(p), "-", 1).isin(*dims.LANGUAGE_CODES))
    return F.transform(F.split(F.get(F.filter(release_tags(name), coded), 0), ","), trimmed)


def platform_name(c: Column) -> Column:
    """Without the tags at its end that say how dumps are stored, trimmed before and after each."""
    return trimmed(F.regexp_replace(trimmed(c), rf"(?U)(\s* \(({'|'.join(STORAGE_QUALIFIERS)})\))+$", ""))


def digest(*columns: Column) -> Column:
    """16 bytes that stand for the values of all columns in a join; null where any is null."""
    told = F.concat(*[x for c in columns for x in (F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))])
    return F.substring(F.unhex(F.sha2(told.cast("binary"), 256)), 1, 16)


def identity(*parts: Column) -> Column:
    """A key of parts, each with its length in bytes before it, so that no two lists give one key."""
    one = [F.concat(F.octet_length(n := normalised(F.coalesce(p, F.lit("")))).cast("string"), F.lit(":"), n) for p in parts]
    return F.concat_ws("|", *one)


def candidate_identity(source_id: Column, provider_id: Column, asset_type: Column, platform: Column, title: Column, region: Column, edition: Column, label: Column, file_name: Column, url: Column) -> Column:
    """What makes two candidates of a queue the same: their source's own id for them and the type, or,
    where that is blank, eight parts that describe them. Each part has its length in bytes before it."""
    by_id = [source_id, provider_id, asset_type]
    described = [source_id, *[normalised(c) for c in (platform, title, region, edition)], asset_type, normalised(F.coalesce(label, file_name)), url]
    key = lambda parts: F.concat(F.lit("candidate"), *[F.concat(F.lit(":"), F.octet_length(p).cast("string"), F.lit(":"), p) for p in (F.coalesce(x, F.lit("")) for x in parts)])
    return F.when(F.coalesce(trimmed(provider_id), F.lit("")) != "", key(by_id)).otherwise(key(described))


def source_record(platform: Column, name: Column) -> Column:
    return F.concat(F.octet_length(platform).cast("string"), F.lit(":"), platform, name)


def recorded_name(record: Column) -> Column:
    """The name in a source record, after as many bytes as its number says; null where there is none."""
    length = F.regexp_extract(record, r"^([0-9]+):", 1).try_cast("int")
    rest = F.regexp_replace(record, r"^[^:]*:", "").cast("binary")
    name = F.when(length <= F.octet_length(rest), F.substring(rest, length + 1, F.octet_length(rest)).cast("string"))
    return F.when(trimmed(name) != "", name)


def extension(name: Column) -> Column:
    """What follows the last dot, where it looks like a file name's ending; else the empty string."""
    return F.regexp_extract(name, r"(?s)^.+\.([A-Za-z0-9]{1,5})$", 1)


MAX_CHARS, MAX_BYTES = 120, 240
_ILLEGAL = re.compile(r'[<>:"/\\|?*\x00-\x1f\x7f-\x9f]')
_DEVICE = re.compile(r"\s*(con|prn|aux|nul|com[1-9]|lpt[1-9])\s*(\..*)?", re.IGNORECASE | re.DOTALL)


def on_every_disk(name: str) -> str:
    name = _ILLEGAL.sub("-", unicodedata.normalize("NFC", name)).strip().rstrip(". ") or "_"
    if _DEVICE.fullmatch(name):
        name = "_" + name
    if len(name) > MAX_CHARS or len(name.encode()) > MAX_BYTES:
        end = m[0] if (m := re.search(r"(?<=.)\.[A-Za-z0-9]{1,5}$", name, re.DOTALL)) else ""
        stem = name[: len(name) - len(end)][: MAX_CHARS - len(end)].encode()[: MAX_BYTES - len(end)]
        name = stem.decode(errors="ignore").rstrip(". ") + end
    return name


@F.pandas_udf(StringType())
def safe_name(names: pd.Series) -> pd.Series:
    """One file or folder name on every file system: in Unicode's composed form, which Spark has no
    function for, illegal and control characters as dashes, no dots and spaces at the end, no device's
    name, at most 120 characters and 240 bytes with its ending."""
    return names.map({x: on_every_disk(x) for x in names.dropna().unique()})


def thumbnail_name(title: Column) -> Column:
    """A title as thumbnail folders write it."""
    return F.regexp_replace(title, r'[&*/:"<>?\\|`]', "_")


def url_is_safe(url: Column) -> Column:
    """An absolute address without user, query or fragment."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    return F.coalesce(part("PROTOCOL").isNotNull() & part("HOST").isNotNull() & part("USERINFO").isNull() & part("QUERY").isNull() & part("REF").isNull(), F.lit(False))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))
