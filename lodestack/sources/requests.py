"""Acquisition requests as documents: versioned JSON without unknown keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
#: The keys of a request (fixed values).
KEYS = ["sources", "platforms", "games", "regions", "languages", "asset_types", "quality", "retention", "limits"]


def documents(spark: SparkSession, path: str) -> DataFrame:
    """file and request (JSON) of each document. One that is no JSON object, has another version, or has
    keys that are not known is an error that names its file."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    version, request = F.get_json_object("value", "$.format_version"), F.get_json_object("value", "$.request")
    outer, inner = (F.json_object_keys(c) for c in (F.col("value"), request))
    extra = F.concat(F.array_except(outer, F.array(F.lit("format_version"), F.lit("request"))), F.array_except(inner, F.array(*[F.lit(k) for k in KEYS])))
    told = F.when(outer.isNull() | inner.isNull() | version.isNull(), "is no request document")
    told = told.when(version != str(VERSION), F.concat(F.lit("has the version "), version, F.lit(f" and not {VERSION}"))).when(F.size(extra) > 0, F.concat(F.lit("has unknown keys: "), F.array_join(F.array_sort(extra), ", ")))
    refused = F.raise_error(F.concat(F.lit("the document "), F.col("file"), F.lit(" "), told)).cast("string")
    return rows.select("file", F.when(told.isNotNull(), refused).otherwise(request).alias("request"))
