"""Counts of what a job did, and choices of what it has to do."""

from __future__ import annotations

from lodestack.functions import dims
from lodestack.functions.text import ascii_lower, maker_and_name, normalised, trimmed
from lodestack.operators.ranks import ranked
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_outcome(rows: DataFrame, outcomes: list[str]) -> DataFrame:
    """One row with a count per outcome: derivations, models, imports, exports, repairs."""
    return rows.agg(*[F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in outcomes])


def is_retail(title: Column, edition: Column) -> Column:
    """Neither firmware nor of an edition with a tag that begins with a word for what was not sold."""
    marked = F.exists(F.split(edition, " · "), lambda t: F.lower(trimmed(t)).rlike(rf"^({'|'.join(dims.NOT_RETAIL)})"))
    return ~F.startswith(title, F.lit("[BIOS]")) & ~marked


def carry_regions(names: DataFrame, regions: list[str]) -> DataFrame:
    """Whether every name has a tag with one of the regions; one row."""
    tags = F.split(F.regexp_extract("name", r"((?:\s*\([^()]*\))*)\s*$", 1), r"[(),]")
    has = F.exists(tags, lambda t: ascii_lower(trimmed(t)).isin(*[r.lower() for r in regions]))
    return names.agg(F.coalesce(F.bool_and(has), F.lit(True)).alias("all_carry"))


def distinct_games(selection: DataFrame) -> DataFrame:
    """How many games a selection names, case and outer white space aside; one row."""
    return selection.agg(F.count_distinct(normalised(F.col("title"))).alias("games"))


def consoles(platforms: DataFrame, words: str = "") -> DataFrame:
    """maker and consoles in name order, of platforms that hold all words."""
    rows = platforms.select("platform").distinct()
    for w in words.lower().split():
        rows = rows.where(F.contains(F.lower("platform"), F.lit(w)))
    named = rows.select(maker_and_name(F.col("platform")).alias("m")).select(F.coalesce("m.maker", F.lit("")).alias("maker"), "m.name")
    return named.groupBy("maker").agg(F.sort_array(F.collect_set("name")).alias("consoles"))


def described_sources(sources: DataFrame, fields: DataFrame, disabled: DataFrame) -> DataFrame:
    """source_id, enabled and credential (not_needed, unreadable, missing or stored); fields: source_id,
    optional and state of each credential field."""
    per = fields.groupBy("source_id").agg(
        F.bool_or(F.col("state") == "unreadable").alias("unreadable"), F.bool_or(~F.col("optional") & (F.col("state") == "missing")).alias("missing")
    )
    credential = F.when(F.col("unreadable").isNull(), "not_needed").when(F.col("unreadable"), "unreadable").when(F.col("missing"), "missing").otherwise("stored")
    off = disabled.select("source_id").distinct().withColumn("off", F.lit(True))
    return sources.select("source_id").join(per, "source_id", "left").join(off, "source_id", "left").select("source_id", F.col("off").isNull().alias("enabled"), credential.alias("credential"))


def capable(sources: DataFrame, asked: list[str]) -> DataFrame:
    """sources: source_id, enabled, direct, asset_types. The asked types that each can serve, or why none."""
    served = F.array_intersect("asset_types", F.array(*[F.lit(t) for t in asked]))
    why = F.when(~F.col("enabled"), "disabled").when(~F.col("direct"), "cannot download media directly").when(F.size(served) == 0, "acquires none of the requested asset types")
    return sources.select("source_id", F.when(why.isNull(), served).alias("asset_types"), why.alias("excluded"))


def discoveries(planned: DataFrame, complete: DataFrame, batches: DataFrame) -> DataFrame:
    """Planned sources of each run in plan order: whether discovery is complete and how far it is."""
    rows = planned.select("run_id", F.posexplode("sources").alias("pos", "source_id"))
    done = complete.select("run_id", "source_id").distinct().withColumn("complete", F.lit(True))
    rows = rows.join(done, ["run_id", "source_id"], "left").join(batches.select("run_id", "source_id", "games"), ["run_id", "source_id"], "left")
    return rows.select("run_id", "pos", "source_id", F.coalesce("complete", F.lit(False)).alias("complete"), F.coalesce("games", F.lit(0)).alias("games"))


def first_seen(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """One row per key, the first in `order`."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key.alias("_key")).agg(F.min_by(row, F.col(order)).alias("r")).select("r.*")


def derived_by_original(derivatives: DataFrame) -> DataFrame:
    """Outputs of each original in the order of recipes."""
    return derivatives.groupBy("object_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("recipe", "output"))), lambda x: x["output"]).alias("outputs"))


def originals_by_hash(assets: DataFrame) -> DataFrame:
    return assets.groupBy("object_hash").agg(F.sort_array(F.collect_set("media_type")).alias("media_types"))


def packaging_slots(preferred: DataFrame) -> DataFrame:
    """front, back and spine of each release that has a front; preferred: release_id, asset_type, object_hash."""
    slot = lambda t: F.max(F.when(F.col("asset_type") == t, F.col("object_hash")))
    return preferred.groupBy("release_id").agg(slot("box_front").alias("front"), slot("box_back").alias("back"), slot("spine").alias("spine")).where("front is not null")


def fit_within(width: Column, height: Column, edge: int) -> tuple[Column, Column]:
    """Size of a picture that fits a square of `edge`, never larger than it is, at least 1 by 1."""
    scale = F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest(width, height))
    return tuple(F.greatest(F.lit(1), F.round(x * scale).cast("int")) for x in (width, height))


def healthy(findings: DataFrame) -> DataFrame:
    """Whether a check found nothing; one row."""
    return findings.agg((F.count("*") == 0).alias("healthy"))


def unsupported_requirement(requests: DataFrame) -> DataFrame:
    """Adds the first requirement of quality that can't be applied, null where all can. requests: request_id,
    max_compression_ratio, min_bitrate_kbps, preferred_scan_type, preferred_sources and best_available."""
    why = F.when(F.col("max_compression_ratio").isNotNull(), "compression ratios cannot be measured yet").when(F.col("min_bitrate_kbps").isNotNull(), "bitrates cannot be measured yet")
    asks = F.col("preferred_scan_type").isNotNull() | (F.coalesce(F.size("preferred_sources"), F.lit(0)) > 0)
    scoring = "need a configurable scoring policy, which is not supported yet"
    why = why.when(asks, f"scan type and source preferences {scoring}").when(F.col("best_available"), f"best-available mode {scoring.replace('need', 'needs', 1)}")
    return requests.withColumn("unsupported", why)


def drawn_size(width: Column, height: Column, edge: int) -> tuple[Column, Column]:
    """Size of a page drawn with its longest edge at `edge`, also when it is smaller, at least 1 by 1."""
    scale = F.lit(float(edge)) / F.greatest(width, height)
    return tuple(F.greatest(F.lit(1), F.round(x * scale).cast("int")) for x in (width, height))


def in_media_order(assets: DataFrame) -> DataFrame:
    """A release's assets as they are shown: by the order of types, then in order of retention. Adds place."""
    ranks = F.create_map(*[F.lit(x) for n, (t, _) in enumerate(dims.ASSET_TYPES) for x in (t, n)])
    return ranked(assets.withColumn("_type", F.try_element_at(ranks, F.col("asset_type"))), ["release_id"], ["_type", "k1", "k2", "k3"], "place").drop("_type")
