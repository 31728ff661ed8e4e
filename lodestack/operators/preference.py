"""Preferred assets, why others rank below them, retention, and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = ["release_id", "asset_type"]
ORDER = ["k1", "k2", "k3"]  # the order of retention


def pixels() -> Column:
    """Null unless both sides are known."""
    return F.col("width") * F.col("height")


def _best_first() -> list[Column]:
    return [F.col("pixels").desc_nulls_last(), F.col("byte_len").desc(), *[F.col(k).asc() for k in ORDER]]


def ranked(assets: DataFrame) -> DataFrame:
    """Assets with pixels and position, 1 for the preferred one of each release and type."""
    return assets.withColumn("pixels", pixels()).withColumn("position", F.row_number().over(Window.partitionBy(*SLOT).orderBy(*_best_first())))


def preferred(assets: DataFrame) -> DataFrame:
    """One row per release and type. An aggregate with partial results instead of a window: no
    group is ever sorted, and the columns needed are known before the shuffle."""
    best = F.max_by(F.struct("object_hash", "byte_len", "width", "height", *ORDER), F.struct(F.coalesce(pixels(), F.lit(-1)), "byte_len", *[(-F.col(k)).alias(k) for k in ORDER]))
    return assets.groupBy(*SLOT).agg(best.alias("best"), F.count("*").alias("n_assets")).select(*SLOT, "n_assets", "best.*")


def reasons(assets: DataFrame) -> DataFrame:
    """For each asset below the preferred one, what decided: more_pixels, more_bytes or acquired_first."""
    w = Window.partitionBy(*SLOT).orderBy(*_best_first())
    top = ranked(assets).withColumn("top_pixels", F.first("pixels").over(w)).withColumn("top_bytes", F.first("byte_len").over(w))
    why = F.when(~F.col("pixels").eqNullSafe(F.col("top_pixels")), "more_pixels").when(F.col("byte_len") != F.col("top_bytes"), "more_bytes").otherwise("acquired_first")
    return top.where("position > 1").select(*SLOT, *ORDER, why.alias("reason"), F.when(F.col("reason") == "more_pixels", F.col("pixels")).otherwise(F.col("byte_len")).alias("other"))


def outranked(retained: DataFrame, newcomers: DataFrame, k: int) -> DataFrame:
    """Newcomers that at least k retained assets of their release and type rank above, with the
    k-th of these. A newcomer ties below what is retained; known bytes are never outranked."""
    known = retained.select(*SLOT, "object_hash").distinct()
    new = newcomers.join(known, [*SLOT, "object_hash"], "left_anti").withColumn("new_pixels", F.coalesce(pixels(), F.lit(-1)))
    new = new.select(*SLOT, *[F.col(c).alias(f"new_{c}") for c in ORDER], "new_pixels", F.col("byte_len").alias("new_bytes"))
    # The k best retained assets decide; nothing below them is joined.
    kept = ranked(retained).where(F.col("position") == max(k, 1)).select(*SLOT, F.col("object_hash").alias("outranker"), F.coalesce("pixels", F.lit(-1)).alias("p"), F.col("byte_len").alias("b"))
    above = (F.col("p") > F.col("new_pixels")) | ((F.col("p") == F.col("new_pixels")) & (F.col("b") >= F.col("new_bytes")))
    return new.join(kept, SLOT).where(above).select(*SLOT, *[f"new_{c}" for c in ORDER], "outranker")


def shortfalls(assets: DataFrame, min_width: int | None = None, min_height: int | None = None, min_pixels: int | None = None, min_bytes: int | None = None, longest_edge: int | None = None) -> DataFrame:
    """One row per asset and requirement not met; an unknown size meets none that is about size."""
    edge = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.greatest("width", "height"))
    checks = [("width", F.col("width"), min_width), ("height", F.col("height"), min_height), ("pixels", pixels(), min_pixels), ("bytes", F.col("byte_len"), min_bytes), ("longest_edge", edge, longest_edge)]
    found = [F.when(~F.coalesce(have >= need, F.lit(False)), F.struct(F.lit(name).alias("requirement"), F.lit(need).cast("long").alias("required"), have.cast("long").alias("found"))) for name, have, need in checks if need is not None]
    return assets.select(*SLOT, *ORDER, F.inline(F.array_compact(F.array(*found))))
