"""Bloom filters of bounded size over 64-bit keys, for sparing shuffles rows that a join would drop.

A filter never denies a key it holds; a key it wrongly admits costs work and changes no result, as
the join itself follows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestack.llm.common import column, lean, mix, writing

EACH, LEAST, MOST = 16, 1 << 16, 1 << 26  # bits for a key; bits of a filter, 8 MB at most
PAGE = 4096


class Bloom:
    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys)
        top = np.uint64(size - 1)
        return tuple((x & top).astype(np.int64) for x in (h, h >> np.uint64(29), mix(h + np.uint64(1))))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be one of the filter's."""
        found = np.ones(len(keys), bool)
        for at in self.places(keys.view(np.uint64), 8 * len(self.bits)):
            found &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return found


def build(keys: DataFrame, n: int, most: int = MOST) -> Bloom:
    """The filter of the one long column of `keys`, about n of them, of at most `most` bits (2**27 or
    fewer); nulls are left out. Each task packs the pages it has bits in, so a task of few keys sends
    little; pages are joined on the executors, and what reaches the driver is one filter."""
    size = LEAST
    while size < most and size < EACH * n:
        size *= 2

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for at in Bloom.places(batch.column(0).drop_null().to_numpy().view(np.uint64), size):
                np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        pages = bits.reshape(-1, PAGE)
        used = np.flatnonzero(pages.any(1))
        yield pa.RecordBatch.from_arrays([column(used, pa.int32()), column([zlib.compress(pages[k].tobytes(), 1) for k in used], pa.binary())], ["at", "bits"])

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = np.frombuffer(zlib.decompress(bits), np.uint8)
                held[at] = held[at] | page if at in held else page
        yield pa.RecordBatch.from_arrays([column(list(held), pa.int32()), column([b.tobytes() for b in held.values()], pa.binary())], ["at", "bits"])

    with writing(keys.sparkSession):  # the pages' shuffle files go with the job
        parts = keys.mapInArrow(lean(part), "at int, bits binary").repartition("at").mapInArrow(lean(union), "at int, bits binary").toArrow()
    bits = np.zeros((size // 8 // PAGE, PAGE), np.uint8)
    for at, page in zip(parts.column("at").to_pylist(), parts.column("bits").to_pylist()):
        bits[at] = np.frombuffer(page, np.uint8)
    return Bloom(bits.ravel())


def sift(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose long column `key` may be among the one column of `keys`, and rows where it is not
    (nulls too). A join of the first with `keys` settles what is left; the others need none, so long
    texts of rows that don't matter are never shuffled."""
    held = rows.sparkSession.sparkContext.broadcast(build(keys, keys.count()))

    def part(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(key)
                found = held.value.holds(ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(found == wanted))

        return rows.mapInArrow(lean(run), rows.schema)

    return part(True), part(False)


def among(rows: DataFrame, key: str, keys: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Rows whose long column `key` is among the one column of `keys` (distinct, not null). Up to
    `most` keys (16 MB) go to the tasks as they are and no row is shuffled; beyond, rows are sifted
    by a Bloom filter and joined."""
    if keys.count() > most:
        return sift(rows, key, keys)[0].join(keys, key, "left_semi")
    known = np.sort(keys.toArrow().column(0).to_numpy())
    held = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(key)
            values = ids.fill_null(0).to_numpy()
            at = np.minimum(np.searchsorted(held.value, values), max(len(held.value) - 1, 0))
            found = held.value[at] == values if len(held.value) else np.zeros(len(values), bool)
            yield batch.filter(pa.array(found & ids.is_valid().to_numpy(zero_copy_only=False)))

    return rows.mapInArrow(lean(run), rows.schema)
