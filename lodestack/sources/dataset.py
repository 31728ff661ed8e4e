"""A metadata dataset of games and their images in one XML file, read once for each kind of record."""

from __future__ import annotations

from lodestack.functions import text
from lodestack.sources.answers import CANDIDATE
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GAME = ["DatabaseID", "Name", "Platform"]
IMAGE = ["DatabaseID", "FileName", "Type", "Region"]
#: Regions by other names than the catalog's, in lower case (fixed values).
REGIONS = {"north america": "USA", "united states": "USA", "united kingdom": "UK", "the netherlands": "Netherlands"}


def records(spark: SparkSession, path: str, tag: str, fields: list[str]) -> DataFrame:
    """The named fields of every record of a kind, trimmed; fields that are missing or blank are null,
    and the texts of one that is repeated follow one another."""
    schema = ", ".join(f"{f} array<string>" for f in fields)
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return rows.select(*[F.nullif(text.trimmed(F.array_join(f, "")), F.lit("")).alias(f) for f in fields])


def _table(rows: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in rows.items() for x in pair])


def catalog_region(region: Column) -> Column:
    """The catalog's name of a region, that of the dataset where it has no other; Unknown for none."""
    own = text.trimmed(region)
    return F.coalesce(F.try_element_at(_table(REGIONS), text.ascii_lower(own)), own, F.lit("Unknown"))


def candidates(
    games: DataFrame, images: DataFrame, wanted: DataFrame, platforms: dict[str, str], types: dict[str, str], base: str, regions: list[str] | None = None
) -> DataFrame:
    """Images of wanted games (title, platform): `platforms` gives the dataset's name of a platform,
    `types` the asset type of a kind of image. A null title wants every game of its platform, under
    the title that release lists file it by. Files whose names could address anything else are left out."""
    theirs = wanted.select("title", "platform", F.try_element_at(_table({k.lower(): v for k, v in platforms.items()}), text.ascii_lower(text.trimmed(F.col("platform")))).alias("Platform_"), text.title_key(F.col("title")).alias("key")).where("Platform_ is not null")
    held = games.where("DatabaseID is not null and Name is not null").select("DatabaseID", "Name", F.col("Platform").alias("Platform_"), text.title_key(F.col("Name")).alias("key"))
    titled = held.join(theirs.where("title is not null").groupBy("Platform_", "key").agg(F.min(F.struct("title", "platform")).alias("w")), ["Platform_", "key"])
    whole = theirs.where("title is null").groupBy("Platform_").agg(F.min("platform").alias("platform"))
    every = held.join(F.broadcast(whole), "Platform_").withColumn("w", F.struct(text.filed_title(F.col("Name")).alias("title"), "platform"))
    # a game is wanted once: by its title, else with its platform; one id is one game
    found = titled.select("DatabaseID", F.lit(0).alias("by"), "w").unionByName(every.select("DatabaseID", F.lit(1).alias("by"), "w"))
    found = found.groupBy("DatabaseID").agg(F.min(F.struct("by", "w")).alias("f")).select("DatabaseID", "f.w.*")
    kind = F.try_element_at(_table(types), F.col("Type"))
    kept = images.where(F.col("DatabaseID").isNotNull() & kind.isNotNull() & ~F.col("FileName").rlike(r"[/\\\\]") & ~F.col("FileName").isin(".", ".."))
    rows = kept.withColumns({"asset_type": kind, "region": catalog_region(F.col("Region"))})
    if regions:
        rows = rows.where(text.normalised(F.col("region")).isin(*[r.strip().lower() for r in regions]))
    url = F.concat(F.lit(base), F.replace(F.url_encode("FileName"), F.lit("+"), F.lit("%20")))
    return rows.join(found, "DatabaseID").select(
        F.concat_ws("/", "DatabaseID", "FileName").alias("candidate_id"), "title", "platform", "region", F.lit("Unspecified").alias("edition"), "asset_type", F.col("Type").alias("label"), url.alias("source_url"), F.col("FileName").alias("filename"),
    ).select(*CANDIDATE)
