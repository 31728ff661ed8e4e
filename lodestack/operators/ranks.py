"""Ranks within groups of any size, without a task that holds a group."""

from __future__ import annotations

from lodestack.operators.rounds import written
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, by: list[str], order: list[str], rank: str = "rank", total: str | None = None, parts: int | None = None) -> DataFrame:
    """Adds the place of each row (from 1) within its group `by`, in the order `order`, which must tell its
    rows apart, and the size of its group. Rows are dealt by ranges of both, shuffled this once, and numbered
    as they are written; the sizes of the ranges before, a row per group and range, are added."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    # Numbers go up by one within a range.
    dealt = written(dealt.withColumns({"_range": F.spark_partition_id(), "_own": F.monotonically_increasing_id()}), "ranges")
    sizes = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.min("_own").alias("_least"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(by)], F.col("_range").alias("_at"), (before - F.col("_least") + 1).alias("_before"), F.sum("_n").over(group).alias("_total"))
    sizes = written(sizes, "range-sizes")  # with its true size the planner sees whether tasks can have it whole
    same = F.col("_range") == F.col("_at")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_{k}"))
    out = dealt.join(sizes, same)
    return out.select(*rows.columns, (F.col("_before") + F.col("_own")).alias(rank), *([F.col("_total").alias(total)] if total else []))
