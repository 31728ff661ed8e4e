"""The library: summaries, nested entries, search, pages, facets, exports."""

from __future__ import annotations

from lodestack.functions import dims
from lodestack.functions.text import ascii_lower, described_name, digest, extension, listed_languages, name_key, normalised, on_every_disk, recorded_name, safe_name, trimmed
from lodestack.operators.ranks import ranked
from lodestack.operators.rounds import written
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SORT = ["title", "platform", "region", "edition"]


def summaries(releases: DataFrame, assets: DataFrame, assertions: DataFrame) -> DataFrame:
    """One narrow row per release: its types in order of retention, its sources by name, its titles."""
    first = assets.groupBy("release_id", "asset_type").agg(F.min(F.struct("k1", "k2", "k3")).alias("at"))
    types = first.groupBy("release_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "asset_type"))), lambda x: x["asset_type"]).alias("asset_types"))
    claimed = assertions.select("release_id", "source_id")
    sources = assets.select("release_id", "source_id").unionByName(claimed).distinct().groupBy("release_id").agg(F.sort_array(F.collect_list("source_id")).alias("sources"))
    empty = F.array().cast("array<string>")
    out = releases.join(types, releases["id"] == types["release_id"], "left").drop("release_id").join(sources, releases["id"] == sources["release_id"], "left").drop("release_id")
    return out.withColumns({"asset_types": F.coalesce("asset_types", empty), "sources": F.coalesce("sources", empty)})


def entries(releases: DataFrame, assets: DataFrame) -> DataFrame:
    """Whole entries: each release with its assets as an array of structs in order of retention."""
    row = F.struct("k1", "k2", "k3", "asset_type", "object_hash", "byte_len")
    nested = assets.groupBy("release_id").agg(F.array_sort(F.collect_list(row)).alias("assets"))
    return releases.join(nested, releases["id"] == nested["release_id"], "left").drop("release_id")


def whole_entries(releases: DataFrame, assets: DataFrame, provenance: DataFrame, claims: DataFrame, derived: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Releases, all or those of `ids` (id), with their claims in order of observation and their assets in
    order of retention, each with its provenance and what was derived of its object. assets: release_id,
    asset_id, asset_type, object_hash. provenance: asset_id, at, source_id, location. claims: release_id,
    at, source_id, field, value. derived: object_hash, recipe, output."""
    wanted = releases if ids is None else releases.join(ids.select("id").distinct(), "id", "left_semi")
    own = assets.join(wanted.select(F.col("id").alias("release_id")), "release_id", "left_semi")
    nested = lambda rows, key, cols, name: rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    from_where = nested(provenance, ["asset_id"], ["at", "source_id", "location"], "provenance")
    made = nested(derived, ["object_hash"], ["recipe", "output"], "derived")
    rows = own.join(from_where, "asset_id", "left").join(made, "object_hash", "left")
    rows = rows.withColumns({"provenance": F.coalesce("provenance", F.array().cast(dict(from_where.dtypes)["provenance"])), "derived": F.coalesce("derived", F.array().cast(dict(made.dtypes)["derived"]))})
    held = nested(rows, ["release_id"], ["asset_id", "asset_type", "object_hash", "provenance", "derived"], "assets").withColumnRenamed("release_id", "id")
    said = nested(claims, ["release_id"], ["at", "source_id", "field", "value"], "claims").withColumnRenamed("release_id", "id")
    out = wanted.join(held, "id", "left").join(said, "id", "left")
    return out.withColumns({n: F.coalesce(n, F.array().cast(dict(out.dtypes)[n])) for n in ("assets", "claims")})


def release_names(releases: DataFrame, claims: DataFrame, datafile_sources: list[str]) -> DataFrame:
    """id and the name that sources know a release by: that of its first datafile record, else title and tags."""
    rows = claims.where((F.col("field") == "identifier") & (F.col("qualifier") == "source_record") & F.col("source_id").isin(*datafile_sources))
    named = rows.select("release_id", "seq", recorded_name(F.col("value")).alias("recorded")).where("recorded is not null")
    first = named.groupBy(F.col("release_id").alias("id")).agg(F.min_by("recorded", "seq").alias("recorded"))
    return releases.join(first, "id", "left").select("id", F.coalesce("recorded", described_name(F.col("title"), F.col("region"), F.col("edition"))).alias("name"))


def search(releases: DataFrame, text: str = "", platforms: list[str] | None = None, regions: list[str] | None = None, asset_types: list[str] | None = None) -> DataFrame:
    """Facets: any of a facet's values, all facets; no values, no restriction."""
    keep: Column = F.lit(True)
    if needle := text.strip().lower():
        keep = keep & F.contains(F.lower("title"), F.lit(needle))
    if platforms:
        keep = keep & name_key(F.col("platform")).isin(*["".join(c for c in p.lower() if c.isalnum()) for p in platforms])
    if regions:
        keep = keep & F.exists(F.split("region", ","), lambda r: F.lower(F.trim(r)).isin(*[x.lower() for x in regions]))
    if asset_types:
        keep = keep & F.arrays_overlap("asset_types", F.array(*[F.lit(t) for t in asset_types]))
    return releases.where(keep)


def _key() -> Column:
    return F.struct(*[F.lower(c).alias(c) for c in SORT], F.col("id").alias("id"))


def page(found: DataFrame, size: int = 50, after: DataFrame | None = None) -> DataFrame:
    """The next `size` rows by lower-cased title, platform, region, edition and id, after the one row
    of `after`. The limit is the feature: a page is taken with a bounded heap per task."""
    rows = found.withColumn("_key", _key())
    if after is not None:
        rows = rows.join(F.broadcast(after.select(_key().alias("_after"))), F.col("_key") > F.col("_after")).drop("_after")  # one row
    return rows.orderBy("_key").limit(min(size, 500)).drop("_key")


def platforms_with_media(releases: DataFrame, assets: DataFrame) -> DataFrame:
    """One spelling of each platform that has assets."""
    with_media = releases.join(assets.select(F.col("release_id").alias("id")).distinct(), "id", "left_semi")
    return with_media.groupBy(name_key(F.col("platform")).alias("platform_key")).agg(F.min(trimmed(F.col("platform"))).alias("platform"))


def latest_media(releases: DataFrame, assets: DataFrame, n: int = 24) -> DataFrame:
    """The n assets retained last; the limit comes before the join."""
    last = assets.orderBy(F.desc("k1"), F.desc("k2"), F.desc("release_id"), F.desc("k3")).limit(n)
    return releases.join(F.broadcast(last), releases["id"] == last["release_id"]).select("release_id", "title", "asset_type", "k1", "k2", "k3")  # n rows


def file_name(original: Column, media_type: Column) -> Column:
    """The original's name made safe, with the ending of its media type where it has none."""
    name, usual = safe_name(original), dims.lookup(dims.EXTENSIONS, media_type)
    return F.when((extension(name) == "") & usual.isNotNull(), F.concat(name, F.lit("."), usual)).otherwise(name)


def export_paths(releases: DataFrame, assets: DataFrame, platforms: list[str] | None = None) -> DataFrame:
    """platform / release / type / file of every original; each of those that share a path, case aside,
    gets the start of its object's hash, so the result doesn't depend on order."""
    rows = releases
    if platforms:
        rows = rows.where(ascii_lower(trimmed(F.col("platform"))).isin(*[p.strip().lower() for p in platforms]))
    # names are made once for each release, each label and each distinct file, not for each asset
    release = rows.select(F.col("id").alias("release_id"), F.concat_ws("/", safe_name(F.col("platform")), safe_name(described_name(F.col("title"), F.col("region"), F.col("edition")))).alias("folder"))
    label = dims.lookup({t: on_every_disk(x) for t, x in dims.LABELS.items()}, F.col("asset_type"))
    files = assets.select("original_filename", "media_type").distinct().withColumn("file", file_name(F.col("original_filename"), F.col("media_type")))
    files = written(files, "file-names")  # with its true size the planner sees whether tasks can have it whole
    on = F.col("a.original_filename").eqNullSafe(F.col("f.original_filename")) & F.col("a.media_type").eqNullSafe(F.col("f.media_type"))
    own = ["release_id", "asset_type", "object_hash", "byte_len", *[k for k in ("k1", "k2", "k3") if k in assets.columns]]
    rows = assets.alias("a").join(files.alias("f"), on).select(*[f"a.{c}" for c in own], "f.file").join(release, "release_id")
    # Rows that share a path meet by its digest, as they are; only they are told apart.
    rows = rows.withColumn("path_key", digest(F.lower(F.concat_ws("/", "folder", label, "file")))).withColumn("holders", F.count("*").over(Window.partitionBy("path_key")))
    end = F.when(extension(F.col("file")) != "", F.concat(F.lit("."), extension(F.col("file")))).otherwise("")
    stem = F.substring(F.col("file"), F.lit(1), F.length("file") - F.length(end))
    told = F.concat(stem, F.lit(" ("), F.substring("object_hash", 1, 8), F.lit(")"), end)
    file = F.when(F.col("holders") > 1, told).otherwise(F.col("file"))
    return rows.withColumn("path", F.concat_ws("/", "folder", label, file)).drop("path_key", "holders", "folder", "file")


def first_games(names: DataFrame, n: int | None = None, percent: int | None = None) -> DataFrame:
    """Per platform the first n games, or the first per cent rounded up, by lower-cased title; equal
    titles (case aside) are one game."""
    games = names.groupBy(name_key(F.col("platform")).alias("platform_key"), F.lower(trimmed(F.col("title"))).alias("name")).agg(F.min("title").alias("title"))
    rows = ranked(games, ["platform_key"], ["name"], "rn", "cnt")
    most = F.lit(n if n is not None else 1 << 30).cast("long")
    if percent is not None:
        most = F.least(most, F.expr(f"(cnt * {percent} + 99) div 100"))
    return rows.where(F.col("rn") <= most).select("platform_key", "title", F.col("rn").cast("int").alias("rn"))


def _regions(c: Column) -> Column:
    return F.transform(F.split(c, ","), lambda r: ascii_lower(trimmed(r)))


def in_regions(releases: DataFrame, regions: list[str]) -> DataFrame:
    """Releases of one of the regions, worldwide ones always; without regions, all."""
    wanted = sorted({"world", *(r.strip().lower() for r in regions)})
    return releases.where(F.arrays_overlap(_regions(F.col("region")), F.array(*[F.lit(r) for r in wanted]))) if regions else releases


def speaking(releases: DataFrame, languages: list[str]) -> DataFrame:
    """Releases that list one of the languages in their `name`, or list none and one of whose regions
    implies one; without languages, all."""
    if not languages:
        return releases
    implied = {r.lower(): lang for r, lang in dims.LANGUAGE_OF_REGION.items()}
    by_region = F.array_compact(F.transform(_regions(F.col("region")), lambda r: dims.lookup(implied, r)))
    spoken = F.transform(F.coalesce(listed_languages(F.col("name")), by_region), ascii_lower)
    return releases.where(F.arrays_overlap(spoken, F.array(*[F.lit(x.strip().lower()) for x in languages])))


def unique_titles(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """Wanted titles with the one listed row of the same key; none where no row or several have it."""
    key = normalised(F.col("title"))
    only = listed.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("listed_id")).where("n = 1").drop("n")
    return wanted.withColumn("key", key).join(only, "key").select("id", "title", "listed_id")


def own_or_general(rows: DataFrame, own: Column, by: list[str]) -> DataFrame:
    """Rows marked `own` where a group has any, else all its rows."""
    has = rows.withColumn("_own", own).groupBy(*by).agg(F.bool_or("_own").alias("_any"))
    return rows.withColumn("_own", own).join(has, by).where(F.col("_own") | ~F.col("_any")).drop("_own", "_any")
