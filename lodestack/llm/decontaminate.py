"""Benchmark decontamination by greedy string tiling.

Every run of SEED words of every benchmark item is a seed. Documents that hold a seed of an item
are tiled against it: matches of at least SEED words are found with Karp-Rabin hashes, the longest is
marked so that no word of either side serves twice, and so on; passages that were reordered or split
are covered by several tiles. An item whose tiles cover THRESHOLD of its words is a leak. An item is
not tiled only where its words in seeds that the document holds, which bound any tiling, are too few.

The benchmark is a stated query set and measured first. Up to BLOCK_BYTES of text it is sent to the
tasks and held against all documents in one pass; a larger one meets the documents in a shuffle join
on seeds, and nothing of it is sent anywhere whole.

Cases. Null or empty documents and items without words give no rows. An item shorter than a seed
is its own seed. Rows of one doc_id (or item_id) are tiled each for itself; repeated rows that
agree in ids and figures are kept. Null ids are carried. An empty benchmark or document table gives
no rows. Other columns take no part.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import bloom
from lodestack.llm.common import column, fresh, hashed_texts, lean, materialise, mix, shingle_hashes, signed, table, word_hashes

SEED, THRESHOLD, BLOCK_BYTES = 5, 0.5, 8 << 20
HITS = 1 << 16  # places of equal seeds looked at at a time
LEAKS = "doc_id long, item_id long, coverage double, n_tiles int, tiled_words long, item_words long, tiles array<struct<item_at:int,doc_at:int,n:int>>"


def _diagonals(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Maximal matches (-n, item_at, doc_at) of at least `least` words, by Karp-Rabin hashes of that
    many words: places of equal hashes that follow each other on a diagonal are one match."""
    if least > min(len(item), len(doc)):
        return []
    ours, theirs = shingle_hashes(item, least), shingle_hashes(doc, least)
    order = np.argsort(ours, kind="stable")
    lo, hi = np.searchsorted(ours[order], theirs, "left"), np.searchsorted(ours[order], theirs, "right")
    upto = np.cumsum(hi - lo)
    out: list[tuple[int, int, int]] = []
    running: dict[int, int] = {}  # diagonal -> where its match began, for matches that reach the end of a slice
    at = 0
    while at < len(theirs):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + HITS, "right")))
        n = (hi - lo)[at:end]
        j = np.repeat(np.arange(at, end), n)
        i = order[np.repeat(lo[at:end] - np.cumsum(n) + n, n) + np.arange(len(j))]
        by = np.lexsort((j, j - i))
        i, j = i[by], j[by]
        first = np.flatnonzero(np.append(True, (j[1:] - i[1:] != j[:-1] - i[:-1]) | (j[1:] != j[:-1] + 1))) if len(j) else np.zeros(0, int)
        before, running = running, {}
        for s, e in zip(first.tolist(), [*first[1:].tolist(), len(j)]):
            diagonal, start = int(j[s] - i[s]), int(j[s])
            if start == at and diagonal in before:
                start = before.pop(diagonal)
            if j[e - 1] == end - 1:
                running[diagonal] = start
            else:
                out.append((start - int(j[e - 1]) - least, start - diagonal, start))
        out += [(start - at - least + 1, start - d, start) for d, start in before.items()]
        at = end
    return out + [(start - len(theirs) - least + 1, start - d, start) for d, start in running.items()]


def greedy_tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (item_at, doc_at, n) of two sequences of word hashes: the longest match of free words is
    marked, again and again, ties by place. A match that others partly cover goes back as its free runs."""
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    waiting, tiles, left = _diagonals(item, doc, least), [], len(item)
    heapq.heapify(waiting)
    while waiting and left >= least:
        n, i, j = heapq.heappop(waiting)
        n = -n
        free = free_item[i : i + n] & free_doc[j : j + n]
        if free.all():
            free_item[i : i + n] = free_doc[j : j + n] = False
            left -= n
            tiles.append((i, j, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s >= least:
                heapq.heappush(waiting, (s - e, i + s, j + s))
    return tiles


def judged(item: np.ndarray, doc: np.ndarray, places: np.ndarray, grams: np.ndarray, k: int, threshold: float):
    """(coverage, tiles) where `doc`, which holds seeds of the item at `places`, gives the item away, else None."""
    ours = shingle_hashes(item, k)
    reach = np.zeros(len(item) + 1, np.int64)
    held = np.isin(ours, grams[places])
    np.add.at(reach, np.flatnonzero(held), 1)
    np.add.at(reach, np.flatnonzero(held) + k, -1)
    if (np.cumsum(reach)[:-1] > 0).sum() < threshold * len(item):
        return None  # words outside seeds that the document holds are in no tile
    inside = np.zeros(len(doc), bool)
    for n in range(k):
        inside[places + n] = True
    place = np.flatnonzero(inside)
    gaps = np.flatnonzero(np.diff(place) > 1) + 1
    # Between runs of the document stands a number that is no word of the item.
    wall = np.uint64(0)
    while (item == wall).any():
        wall += np.uint64(1)
    text, back = np.insert(doc[place], gaps, wall), np.insert(place, gaps, -1)
    tiles = [(i, int(back[j]), m) for i, j, m in greedy_tiles(item, text, k)]
    covered = sum(m for _, _, m in tiles)
    return (covered / len(item), tiles) if covered >= threshold * len(item) else None


class Block:
    """A block of benchmark items, ready to be held against documents."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.items = [(k, h) for (k, _), h in zip(rows, word_hashes([t for _, t in rows])) if len(h)]
        self.seeds = {}
        for k in sorted({min(SEED, len(h)) for _, h in self.items}):
            pairs = [(s, n) for n, (_, h) in enumerate(self.items) if min(SEED, len(h)) == k for s in np.unique(shingle_hashes(h, k)).tolist()]
            pairs.sort()
            seeds = np.array([p[0] for p in pairs], np.uint64)
            some = np.zeros(1 << 20, bool)  # most runs of words are told apart from all seeds by this alone
            some[seeds & np.uint64(len(some) - 1)] = True
            self.seeds[k] = seeds, np.array([p[1] for p in pairs], np.int64), some

    def leaks(self, doc: np.ndarray, threshold: float):
        """(item_id, coverage, tiles, words of the item) for each item that `doc` gives away."""
        for k, (seeds, owners, some) in self.seeds.items():
            if len(doc) < k:
                continue
            grams = shingle_hashes(doc, k)
            hit = np.flatnonzero(some[grams & np.uint64(len(some) - 1)])
            if not len(hit):
                continue
            lo, hi = np.searchsorted(seeds, grams[hit], "left"), np.searchsorted(seeds, grams[hit], "right")
            where = defaultdict(list)
            for at, a, b in zip(hit.tolist(), lo.tolist(), hi.tolist()):
                for n in owners[a:b].tolist():
                    where[n].append(at)
            for n, places in sorted(where.items()):
                item_id, item = self.items[n]
                if found := judged(item, doc, np.array(places), grams, k, threshold):
                    yield item_id, *found, len(item)


def _leak_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "item_id", "coverage", "n_tiles", "tiled_words", "item_words", "tiles"]
    spans = pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("n", pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), spans]
    full = []
    for doc_id, item_id, coverage, tiles, n in rows:
        spelt = [{"item_at": i, "doc_at": j, "n": m} for i, j, m in tiles]
        full.append((doc_id, item_id, coverage, len(tiles), sum(m for _, _, m in tiles), n, spelt))
    return pa.RecordBatch.from_arrays([column([r[i] for r in full], t) for i, t in enumerate(kinds)], names)


def _held_against(block, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in hashed_texts(batches):
            yield _leak_rows([(doc_id, *found) for doc_id, doc in zip(batch.column("doc_id").to_pylist(), texts) for found in block.value.leaks(doc, threshold)])

    return run


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The items that have a text, and their size in bytes."""
    items = materialise(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null"), "benchmark")
    return items, items.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _block(items: DataFrame):
    """All items as one broadcast block; asked for only where they are no more than BLOCK_BYTES."""
    return items.sparkSession.sparkContext.broadcast(Block([(r["item_id"], r["text"]) for r in items.collect()]))


def _seeds(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...], seen=None) -> Iterator[pa.RecordBatch]:
    """seed, row of the distinct seeds of each row; of items only those of the item's own seed length."""
    for batch, texts in hashed_texts(batches):
        seeds, rows = [], []
        for row, h in zip(batch.column("row").to_pylist(), texts):
            for k in lengths if seen is not None else [min(SEED, len(h))]:
                if 0 < k <= len(h):
                    own = np.unique(mix(shingle_hashes(h, k) + np.uint64(k)))
                    own = own if seen is None else own[seen.value.holds(own)]
                    seeds.append(own)
                    rows.append(np.full(len(own), row))
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (seeds, rows)]
        yield pa.RecordBatch.from_arrays([column(signed(flat[0]), pa.int64()), column(flat[1], pa.int64())], ["seed", "row"])


def _joined(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The leaks of benchmarks larger than a block, with `row` of the documents: documents and items
    meet by their seeds in a shuffle, and each pair that shares one is tiled. A Bloom filter of bounded
    size spares most seeds of documents the way."""
    items = materialise(items.withColumn("row", F.monotonically_increasing_id()), "benchmark-rows")
    ours = materialise(items.mapInArrow(lean(lambda b: _seeds(b, ())), "seed long, row long"), "benchmark-seeds")
    seen = items.sparkSession.sparkContext.broadcast(bloom.build(ours.select("seed"), ours.count()))
    theirs = docs.mapInArrow(lean(lambda b: _seeds(b, tuple(range(1, SEED + 1)), seen)), "seed long, row long")
    pairs = theirs.withColumnRenamed("row", "doc").join(ours, "seed").select("doc", "row").distinct()
    texts = pairs.join(items.withColumnRenamed("text", "item"), "row").drop("row").join(docs.withColumnRenamed("row", "doc"), "doc")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            rows, owners = [], []
            named = zip(*(batch.column(c).to_pylist() for c in ("doc", "doc_id", "item_id")), word_hashes(batch.column("text").to_pylist()), word_hashes(batch.column("item").to_pylist()))
            for row, doc_id, item_id, doc, item in named:
                k = min(SEED, len(item))
                grams = shingle_hashes(doc, k) if len(doc) >= k else doc[:0]
                places = np.flatnonzero(np.isin(grams, shingle_hashes(item, k)))
                if len(places) and (found := judged(item, doc, places, grams, k, threshold)):
                    rows.append((doc_id, item_id, *found, len(item)))
                    owners.append(row)
            made = _leak_rows(rows)
            yield pa.RecordBatch.from_arrays([*made.columns, column(owners, pa.int64())], [*made.schema.names, "row"])

    return texts.mapInArrow(lean(tile), LEAKS + ", row long")


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row and benchmark item whose tiles cover `threshold` of the item."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items, size = _items(benchmark)
    if size <= BLOCK_BYTES:
        return docs.mapInArrow(lean(_held_against(_block(items), threshold)), LEAKS)
    docs = materialise(docs.withColumn("row", F.monotonically_increasing_id()), "numbered-documents")
    return _joined(docs, items, threshold).drop("row")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows that give a benchmark item away; every row is judged by its own text."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    items, size = _items(benchmark)
    if size <= BLOCK_BYTES:
        block = _block(items)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece, texts in hashed_texts(batches):
                yield piece.filter(pa.array([next(block.value.leaks(t, threshold), None) is None for t in texts], pa.bool_()))

        return docs.mapInArrow(lean(clean), docs.schema)
    name = fresh(docs, "row")
    rows = materialise(docs.withColumn(name, F.monotonically_increasing_id()), "numbered-documents")
    found = _joined(rows.select(F.col(name).alias("row"), F.lit(None).cast("long").alias("doc_id"), "text"), items, threshold)
    lost = materialise(found.select(F.col("row").alias(name)).distinct(), "leaking-rows")
    maybe, others = bloom.sift(rows, name, lost)
    return others.unionByName(maybe.join(lost, name, "left_anti")).select(*docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and item_id of every leak, with its coverage and tiles."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tiles")
