"""Rounds to a fixed point over tables that are written after each round."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, in local mode else a new one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The table as written to the shared folder: what was before is not run again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fixed_point(start: DataFrame, step: Callable[[DataFrame], DataFrame], name: str, most: int | None = None, by: list[str] | None = None) -> DataFrame:
    """`step` applied to its own results until no row changes, in the columns `by` where some are named, all
    that it asks for; an error after `most` rounds. Rows are compared as a bag, by the number of rows and sums
    over their hashes, which are taken as they are written."""
    from pyspark.sql import functions as F

    def told(df: DataFrame) -> tuple[DataFrame, tuple]:
        own = [F.xxhash64(*(by or df.columns), F.lit(salt)).cast("decimal(38,0)") for salt in (0, 1)]
        sums = Observation()
        out = written(df.observe(sums, F.count("*").alias("n"), *[F.sum(h).alias(f"h{k}") for k, h in enumerate(own)]), name)
        return out, tuple(sums.get[c] for c in ("n", "h0", "h1"))

    now, seen = told(start)
    for _ in count() if most is None else range(most):
        now, found = told(step(now))
        if found == seen:
            return now
        seen = found
    raise ValueError(f"{name} is not settled after {most} rounds")
