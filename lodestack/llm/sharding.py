"""Sharding by fixed virtual slots.

A record's doc_id is hashed into one of 4,096 virtual slots, for ever. Bytes per slot are one
aggregate of fixed size. A versioned slot-to-shard map, stored as a table, says where each slot
lives: version 0 deals slots out in turn, and each rebalancing is an edit of single slots that
makes the next version, so records move only with the slots that were edited. A later run that is
given the map's folder starts from its last version and adds the next one; without edits it adds
none. Balancing by bytes follows the law `bytes`: shards' sizes end up as near equal as slots allow.

Cases. Null text: size 1, checksum of the empty text. A row with a null doc_id hashes by its size
and checksum. Rows of one doc_id share a virtual slot and get places of their own, equal rows in any
order. An empty table gives no rows.
Other columns of the input take no part.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm.common import materialise, new_path, table

SLOTS = 4096
MAP_SCHEMA = "virtual_slot int, shard int, bytes long"


def first_map(n_shards: int, slots: int = SLOTS) -> list[int]:
    return [s % n_shards for s in range(slots)]


def rebalance(shards: list[int], sizes: list[int], n_shards: int) -> list[int]:
    """Edit a map for `n_shards` shards (more or fewer than before) until no single move or swap
    of slots between the fullest and the emptiest shard narrows the gap. Work and memory depend
    on the fixed number of slots only."""
    where = list(shards)
    load = [0] * n_shards
    for s, shard in enumerate(where):
        if shard < n_shards:
            load[shard] += sizes[s]
    heap = [(v, k) for k, v in enumerate(load)]
    heapq.heapify(heap)
    for s in sorted((s for s, shard in enumerate(where) if shard >= n_shards), key=lambda s: -sizes[s]):
        v, k = heapq.heappop(heap)
        where[s], load[k] = k, v + sizes[s]
        heapq.heappush(heap, (load[k], k))
    held: list[set[int]] = [set() for _ in range(n_shards)]
    for s, shard in enumerate(where):
        held[shard].add(s)
    for _ in range(8 * len(where)):
        hi, lo = max(range(n_shards), key=load.__getitem__), min(range(n_shards), key=load.__getitem__)
        gap = load[hi] - load[lo]
        move = min((s for s in held[hi] if 0 < sizes[s] < gap), key=lambda s: (abs(gap - 2 * sizes[s]), s), default=None)
        best = abs(gap - 2 * sizes[move]) if move is not None else gap
        swap = None
        if 4 * best > (sum(sizes) // max(1, n_shards)) // 2000:  # a swap is worth its search only while the gap is visible
            small = sorted(held[lo], key=sizes.__getitem__)
            values = [sizes[s] for s in small]
            import bisect

            for s in held[hi]:
                i = bisect.bisect_left(values, sizes[s] - gap // 2)
                for j in (i - 1, i):
                    if 0 <= j < len(small) and (d := sizes[s] - values[j]) > 0 and abs(gap - 2 * d) < best:
                        best, swap = abs(gap - 2 * d), (s, small[j])
        if swap:
            a, b = swap
        elif move is not None:
            a, b = move, None
        else:
            break
        if best >= gap:
            break
        for s, src, dst in ((a, hi, lo), (b, lo, hi)):
            if s is not None:
                held[src].remove(s)
                held[dst].add(s)
                where[s] = dst
                load[src] -= sizes[s]
                load[dst] += sizes[s]
    return where


def slot_sizes(sized: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes per virtual slot: `slots` numbers, whatever the data."""
    sizes = [0] * slots
    for r in sized.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect():
        sizes[r["virtual_slot"]] = r["b"]
    return sizes


def store_version(spark: SparkSession, path: str, version: int, shards: list[int], sizes: list[int]) -> None:
    """Write one version of the map, a row per slot, beside those before it. A version is written
    once: two runs that make the same one don't both succeed."""
    rows = [(s, shard, sizes[s]) for s, shard in enumerate(shards)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]] | None:
    """A version of a stored map, the last one by default, and the shard of each slot; None where
    nothing is stored."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        return None
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    rows = stored.where(F.col("version") == version).select("virtual_slot", "shard").collect()  # one per slot
    return version, [shard for _, shard in sorted((r[0], r[1]) for r in rows)]


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    hashed = F.when(F.col("doc_id").isNull(), F.xxhash64("size", "text_crc32")).otherwise(F.xxhash64("doc_id"))
    return sized.withColumn("virtual_slot", F.pmod(hashed, F.lit(slots)).cast("int"))


def shard(docs: DataFrame, n_shards: int = 16, map_path: str | None = None, rows_per_group: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and slot, the gapless place in the shard. The map
    in `map_path` (a new one by default) is loaded, edited for what `docs` weigh, and stored."""
    spark = docs.sparkSession
    path = map_path or new_path(spark, "slot-map")
    sized = materialise(with_slots(docs).withColumn("_told", F.monotonically_increasing_id()), "sharding-sizes")
    sizes = slot_sizes(sized)
    if (stored := load_map(spark, path)) is None:
        stored = 0, first_map(n_shards)
        store_version(spark, path, *stored, sizes)
    version, before = stored
    edited = rebalance(before, sizes, n_shards)
    if edited != before:
        version += 1
        store_version(spark, path, version, edited, sizes)
    current = spark.read.parquet(path).where(F.col("version") == version).select("virtual_slot", "shard")
    # Places: virtual slots are split into groups small enough for one task, groups are numbered by sums.
    split = F.greatest(F.lit(1), F.ceil(F.col("_rows") / rows_per_group))
    parts = sized.groupBy("virtual_slot").agg(F.count("*").alias("_rows")).select("virtual_slot", split.alias("_parts"))
    known = current.join(parts, "virtual_slot")
    placed = sized.join(F.broadcast(known), "virtual_slot")  # a row per slot: SLOTS at most
    placed = placed.withColumn("_group", F.pmod(F.xxhash64("doc_id", "_told"), F.col("_parts"))).drop("_parts")
    counts = placed.groupBy("shard", "virtual_slot", "_group").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("shard").orderBy("virtual_slot", "_group").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("virtual_slot", "_group", F.coalesce(ahead, F.lit(0)).alias("_first"))
    inside = Window.partitionBy("virtual_slot", "_group").orderBy("doc_id", "size", "text_crc32", "_told")
    return (
        placed.withColumn("_place", F.row_number().over(inside) - 1)
        .join(firsts, ["virtual_slot", "_group"])
        .withColumn("slot", (F.col("_first") + F.col("_place")).cast("long"))
        .drop("_group", "_first", "_place", "_told")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
