"""What sources can serve of what is asked for."""

from __future__ import annotations

from lodestack.functions.text import thumbnail_name
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covered(asked: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Per asked selector (a type, or `any`) the sources that serve it, in name order; a family is
    never covered."""
    one = asked.join(capabilities, F.col("selector") == F.col("asset_type")).select("selector", "source_id")
    every = asked.where("selector = 'any'").join(capabilities.select("source_id").distinct()).select("selector", "source_id")  # one asked row
    have = one.unionByName(every).distinct().groupBy("selector").agg(F.array_join(F.sort_array(F.collect_list("source_id")), ",").alias("sources"))
    return asked.join(have, "selector", "left").select("selector", F.coalesce("sources", F.lit("")).alias("sources"), F.col("sources").isNotNull().alias("covered"))


def targets(releases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Platform and title pairs of the wanted titles, narrowed to wanted platforms where given."""
    rows = releases.select("platform", "title").distinct().join(wanted, "title")
    return rows.where(F.col("only_platform").isNull() | (F.col("only_platform") == F.col("platform"))).select("platform", "title")


def thumbnails(wanted: DataFrame, repositories: DataFrame, listings: DataFrame, folders: dict[str, str]) -> DataFrame:
    """wanted: platform, title. repositories: platform, repository. listings: platform, folder and files, the
    names in a listing that could be read. folders: the folder of each asset type asked for. One row per
    title and folder whose listing has its file, and for every folder without a listing, as it may have it:
    candidate_id, platform, title, asset_type, folder, file_name. A platform without a repository is an error."""
    rows = wanted.select("platform", "title").distinct().join(repositories.dropDuplicates(["platform"]), "platform", "left")
    missing = F.raise_error(F.concat(F.lit("no repository is declared for the platform "), F.col("platform")))
    rows = rows.withColumn("repository", F.coalesce("repository", missing.cast("string"))).withColumn("file_name", F.concat(thumbnail_name(F.col("title")), F.lit(".png")))
    asked = F.explode(F.array(*[F.struct(F.lit(t).alias("asset_type"), F.lit(f).alias("folder")) for t, f in folders.items()]))
    rows = rows.select("*", asked.alias("a")).select("platform", "title", "repository", "file_name", "a.*")
    read = listings.select("platform", "folder").distinct().withColumn("read", F.lit(True))
    held = listings.select("platform", "folder", F.explode("files").alias("file_name")).distinct().withColumn("held", F.lit(True))
    found = rows.join(read, ["platform", "folder"], "left").join(held, ["platform", "folder", "file_name"], "left").where("read is null or held")
    return found.select(F.concat_ws("/", "repository", "folder", "title").alias("candidate_id"), "platform", "title", "asset_type", "folder", "file_name")
