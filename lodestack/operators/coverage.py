"""Coverage of releases by profile of their packaging family."""

from __future__ import annotations

from lodestack.functions import dims
from lodestack.functions.text import ascii_lower, trimmed
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def family(platform: Column) -> Column:
    """Digital suffixes first, as written, then the platform, ASCII case aside; null for unknown platforms."""
    p = trimmed(platform)
    known = {x.lower(): f for f, names in dims.PLATFORMS.items() for x in names}
    return F.when(p.rlike("(" + "|".join(x.replace("(", r"\(").replace(")", r"\)") for x in dims.DIGITAL_SUFFIXES) + ")$"), "digital_only").otherwise(dims.lookup(known, ascii_lower(p)))


def by_profile(releases: DataFrame, assets: DataFrame) -> DataFrame:
    """Per release and profile: how many types it asks for with those before it, and how many are missing."""
    spark = releases.sparkSession
    have = assets.select("release_id", "asset_type").distinct().withColumn("there", F.lit(1))
    asked = releases.select("id", family(F.col("platform")).alias("family")).join(F.broadcast(dims.profiles(spark)), "family")  # 40 rows
    met = asked.join(have, (asked["id"] == have["release_id"]) & (asked["asset_type"] == have["asset_type"]), "left")
    return met.groupBy("id", "family", "profile", "position").agg(F.count("*").alias("required"), F.count(F.when(F.col("there").isNull(), 1)).alias("missing"))


def status(releases: DataFrame, assets: DataFrame) -> DataFrame:
    """The last profile that is complete with all before it; none, and null for unknown families."""
    last = by_profile(releases, assets).groupBy("id").agg(F.max_by("profile", F.when(F.col("missing") == 0, F.col("position"))).alias("last"))
    kind = family(F.col("platform"))
    return releases.join(last, "id", "left").select("id", kind.alias("family"), F.when(kind.isNotNull(), F.coalesce("last", F.lit("none"))).alias("status"))
