"""Connected components of edge tables, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import materialise


def _state(edges: DataFrame):
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame) -> DataFrame:
    """`edges` has long columns a and b; gives node and comp, the smallest node that it reaches,
    for each node that has an edge. Loops (a = b) and repeated edges change nothing. Each round
    is written to the shared folder; a star's centre may be as hot as it likes, as its rows meet
    in sums and in joins that can be split only."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e, "edges")
    now = _state(e)
    while now[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        before, now = now, _state(e)
        if before == now:
            break
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
