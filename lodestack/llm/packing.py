"""Best-fit packing after Martello-Toth dominance reduction.

Packing depends on lengths alone and there are at most `capacity` of them, so the instance is a
table of counts per length, of bounded size whatever the corpus. On it the reduction fixes sets
that provably dominate every alternative: a pair that fills a sequence exactly; an item that no
other fits; an item that at most one other fits, with the longest that does; and a pair at least
as long as the best triple where no fourth item fits. Best fit, longest first, packs the rest,
many equal sequences at a time. The plan is a list of runs: "the r-th to s-th piece of length L
go to sequences b, b+1, ... at offset o". Pieces are numbered within their length by sums over
groups that fit one task and look their run up; a group is a share of the rows of one length by a
number that rows were given when they were written, so equal rows don't meet in one either.

Cases. Null or empty text: one piece with the end id only. Only texts longer than the capacity
are cut; the first piece takes what is left over. Rows of one doc_id are packed each for itself.
A null doc_id is packed like any other. An empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm import tokens
from lodestack.llm.common import column, lean, materialise, table

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
TEXTS_AT_ONCE = 512


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = 0
        for batch in (b.slice(at, TEXTS_AT_ONCE) for b in batches for at in range(0, b.num_rows, TEXTS_AT_ONCE)):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.ids_of(batch.column(1), path)):
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append((doc, k, a, b - a, tokens.crc32_of(ids[a:b]), told))
                    told += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([column([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "told"])

    return run


class Plan:
    """Runs of placements for a table of counts per length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {k: v for k, v in counts.items() if v}
        self.used = dict.fromkeys(self.left, 0)
        self.sequences, self.fixed = 0, 0
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first sequence, offset

    def _place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.used[length], count, sequence, offset))
        self.used[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def _open(self, lengths: list[int], count: int) -> int:
        first, offset = self.sequences, 0
        for length in lengths:
            self._place(length, count, first, offset)
            offset += length
        self.sequences += count
        return first

    def reduce(self) -> None:
        c, left = self.capacity, self.left
        for length in sorted(left, reverse=True):
            other = c - length
            if length == c:
                self._open([length], left[length])
            elif length in left and other in left and other <= length:
                n = left[length] // 2 if other == length else min(left[length], left[other])
                if n:
                    self._open([length, other], n)
        self.fixed, found = self.sequences, True
        while found and left:  # until a whole pass fixes nothing
            found = False
            for length in sorted(left, reverse=True):
                while length in left and (chosen := self._dominating(length)):
                    self._open(*chosen)
                    self.fixed, found = self.sequences, True

    def _dominating(self, big: int) -> tuple[list[int], int] | None:
        """The sequence that dominates every other one with an item of length `big`, and how often it
        can be made; None where more than two others fit beside it or none dominates."""
        left, order, room = self.left, sorted(self.left), self.capacity - big
        small: list[int] = []
        for length in order:  # the smallest three items besides this one
            small += [length] * min(3, left[length] - (length == big))
            if len(small) >= 3:
                break
        if not small or small[0] > room:
            return [big], 1 if not small else left[big]
        if len(small) >= 3 and sum(small[:3]) <= room:
            return None
        fits = [x for x in order[: bisect.bisect_right(order, room)] if x != big or left[big] > 1]
        one = fits[-1]
        if len(small) >= 2 and small[0] + small[1] <= room:  # two may fit beside it
            two = 0
            for a in fits:
                i = bisect.bisect_right(fits, room - a) - 1
                spare = left[a] - (a == big) > 1
                if i >= 0 and fits[i] == a and not spare:
                    i -= 1
                if i >= 0:
                    two = max(two, a + fits[i])
            if one < two:
                return None
        return [big, one], left[big] // 2 if one == big else min(left[big], left[one])

    def best_fit(self) -> None:
        rooms: list[int] = []  # sorted spaces that some sequence has left
        held: dict[int, list[tuple[int, int]]] = {}  # space -> runs of sequences

        def keep(space: int, first: int, n: int) -> None:
            if n and space:
                if space not in held:
                    bisect.insort(rooms, space)
                    held[space] = []
                held[space].append((first, n))

        for length in sorted(self.left, reverse=True):
            while length in self.left:
                want, i = self.left[length], bisect.bisect_left(rooms, length)
                if i == len(rooms):
                    each = self.capacity // length
                    space, n = self.capacity, max(1, want // each)
                    first = self.sequences
                    self.sequences += n
                else:
                    space = rooms[i]
                    first, n = held[space].pop()
                    if not held[space]:
                        del held[space], rooms[i]
                    each = space // length
                take = min(n, want // each) if want >= each else 1
                each = each if want >= each else want
                for k in range(each):
                    self._place(length, take, first, self.capacity - space + k * length)
                keep(space - each * length, first, take)
                keep(space, first + take, n - take)

    def solve(self) -> Plan:
        self.reduce()
        self.best_fit()
        return self


def _lookup(runs: list[tuple[int, int, int, int, int]]):
    runs = sorted(runs)
    at = np.array([(r[0] << 48) + r[1] for r in runs], np.int64)
    first, sequence, offset = (np.array([r[i] for r in runs], np.int64) for i in (1, 3, 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            i = np.searchsorted(at, (length << 48) + rank, "right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            out = [batch.column(n) for n in names]
            if batch.num_rows:
                out += [column(sequence[i] + rank - first[i], pa.int64()), column(offset[i], pa.int64())]
            else:
                out += [column([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays(out, [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, rows_per_group: int = 50_000) -> DataFrame:
    """One row per piece with its sequence and place."""
    vocabulary = vocabulary or tokens.vocabulary_path()
    spark = docs.sparkSession
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(_pieces(vocabulary, capacity), "encoders"), PIECES + ", told long")
    pieces = materialise(made, "packing-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    plan = Plan(counts, capacity).solve()
    parts = spark.createDataFrame([(k, -(-n // rows_per_group)) for k, n in counts.items()], "length long, _parts long")
    grouped = pieces.join(F.broadcast(parts), "length")  # a row per length
    grouped = grouped.withColumn("_group", F.pmod(F.xxhash64("doc_id", "told"), F.col("_parts"))).drop("_parts")
    per = grouped.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))
    firsts = per.select("length", "_group", F.coalesce(ahead, F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "start", "ids_crc32", "told")
    ranked = (
        grouped.withColumn("_place", F.row_number().over(inside) - 1)
        .join(firsts, ["length", "_group"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_place")).cast("long").alias("rank"))
    )
    return ranked.mapInArrow(lean(_lookup(plan.runs), "encoders"), PIECES + ", sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
