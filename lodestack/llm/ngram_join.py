"""N-gram Jaccard join with count-vector R-trees.

A text's set is its distinct word shingles, hashed to 64 bits. Equal sets become one node. Shingles
are also hashed into groups, and a set's group counts are a point in an R-tree, which bounds what
two sets share by summed coordinate minima. An R-tree over a whole corpus can't prune (the corner of
a page of unrelated texts covers everything), so trees grow in cells. Sets that are similar enough
share one of their first n - ceil(t n) + 1 shingles in any fixed order; a cell holds the nodes
that have one shingle among these. The order puts widely shared shingles last, so that cells of
common passages stay small; it is an order only, and any list of such shingles gives the same result.

Cells of two or more nodes are joined by their trees, in blocks where a cell is large. What the
bounds leave makes clusters of nodes (components of the surviving pairs), and only nodes in a
cluster get their full sets back: each cluster, in blocks where it is large, is joined by a tree
again and every surviving pair is verified exactly. Verified links make the components.

Cases. Null, empty or blank text: no shingles, linked with nothing. Fewer words than a shingle:
the whole sequence is the one shingle. Rows of one doc_id are rows of their own; they carry the
component of their own text. A null doc_id is never a component's name unless it has no other.
An empty table gives no rows. Other columns take no part. Two different sets get one node with
probability below nodes**2 / 2**65.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import bloom, rtree
from lodestack.llm.common import column, hashed_texts, in_blocks, lean, materialise, shingle_hashes, signed, table, units, word_hashes
from lodestack.llm.graph import components

BLOCK = 1024  # members of a cell or cluster that one task joins with as many others
HEAVY = 512  # shingles; a larger set counts as several members of its cluster
COMMON = 500_000  # shingles put last in the order, at most
_PROBED = np.uint64(1 << 63)  # shingles below this are counted for the order; prefixes rarely reach beyond
SETS = "doc_id long, node long, n int, keys array<bigint>, point binary"


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles."""
    return np.unique(shingle_hashes(word_hashes([text])[0], k))


def node_of(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    import xxhash

    return int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "little", signed=True)


def _common(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, seen = Counter(), [], 0

        def count() -> None:
            nonlocal waiting, seen
            values, times = np.unique(np.concatenate(waiting), return_counts=True)
            held.update(dict(zip(values[times > 1].tolist(), times[times > 1].tolist())))
            waiting, seen = [], 0

        for _, texts in hashed_texts(batches):
            for h in texts:
                s = np.unique(shingle_hashes(h, k))
                s = s[s < _PROBED]
                waiting.append(s)
                seen += len(s)
                if seen > 200_000:
                    count()
                    if len(held) > 120_000:  # forget the rarest; an order is all that depends on it
                        for h in [h for h, c in held.items() if c < 4]:
                            del held[h]
        if waiting:
            count()
        h = np.fromiter(held, np.uint64, len(held))
        yield pa.RecordBatch.from_arrays([column(signed(h), pa.int64()), column(list(held.values()), pa.int64())], ["h", "c"])

    return run


def common_shingles(texts: DataFrame, k: int) -> np.ndarray:
    """Shingles that many texts share: all that were counted more than 32 times, or, where these
    are more than COMMON, the most frequent of them, as many whole counts as stay within COMMON."""
    counted = materialise(texts.mapInArrow(lean(_common(k)), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 32"), "shingle-counts")
    # Counts in steps of a sixteenth of a power of two: at most a thousand rows, whatever the corpus.
    step = F.floor(F.log2("c") * 16)
    least, total = None, 0
    for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        total += r["n"]
        if total > COMMON:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, np.uint64)
    found = counted.where(step >= least).select("h").toArrow().column("h").to_numpy()
    return np.sort(found.view(np.uint64))


def _sets(k: int, num: int, den: int, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = common.value
        for piece, texts in hashed_texts(batches):
            nodes, sizes, keys, points = [], [], [], []
            for h in texts:
                s = np.unique(shingle_hashes(h, k))
                n = len(s)
                sizes.append(n)
                if not n:
                    nodes.append(None)
                    keys.append(None)
                    points.append(None)
                    continue
                first = n + num * n // -den + 1  # n - ceil(n * num / den) + 1
                ordered = s
                if len(late):
                    common_here = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
                    ordered = np.concatenate([s[~common_here], s[common_here]])
                nodes.append(node_of(s))
                keys.append(signed(ordered[:first]))
                points.append(rtree.point(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), column(nodes, pa.int64()), column(sizes, pa.int32()), column(keys, pa.list_(pa.int64())), column(points, pa.binary())],
                ["doc_id", "node", "n", "keys", "point"],
            )

    return run


def _stars(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    root = rtree.forest(len(nodes), i, j)
    at = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[at], nodes[root[at]]


def _edges_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([column(a, pa.int64()), column(b, pa.int64())], ["a", "b"])


def _join_cells(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in units(batches, ["key", "bi", "bj"]):
            nodes, n, block, bi, bj = (t.column(c).to_numpy() for c in ("node", "n", "block", "bi", "bj"))
            points, ends, found = rtree.Points(t.column("point").to_pylist(), n), np.append(at[1:], len(nodes)), []
            n = points.sizes
            size = ends - at
            unit = np.repeat(np.arange(len(at)), size)
            for lag in range(1, 8):  # cells no larger than a page: every pair, all cells at once
                i = np.flatnonzero((unit[lag:] == unit[:-lag]) & (size[unit[lag:]] <= 8))
                if not len(i):
                    break
                i = i[rtree.may_link(points.base, n, n, i, i + lag, num, den)]
                ok = points.refine(i, i + lag, num, den)
                found.append((nodes[i[ok]], nodes[i[ok] + lag]))
            for s, e in zip(at[size > 8], ends[size > 8]):
                across = block[s:e] if bi[s] != bj[s] else None
                found.append(_stars(nodes[s:e], *rtree.join(points, slice(s, e), num, den, across)))
            a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield _edges_batch([(pair[:, 0], pair[:, 1])])

    return run


def _overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of pairs of sorted distinct arrays."""
    if len(i) < 32:
        return np.array([np.intersect1d(sets[a], sets[b], assume_unique=True).size for a, b in zip(i, j)], np.int64)
    used = np.unique(np.concatenate([i, j]))
    place = np.zeros(len(sets), np.int64)
    place[used] = np.arange(len(used))
    everything = np.concatenate([sets[u] for u in used])
    values, which, times = np.unique(everything, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    shared = times[which] > 1
    column_of = np.cumsum(times > 1) - 1
    owner, which = owner[shared], column_of[which[shared]]
    out = np.zeros(len(i), np.int64)
    a, b = place[i], place[j]
    width = max(256, 2_000_000 // len(used))
    for s in range(0, int((times > 1).sum()), width):
        here = (which >= s) & (which < s + width)
        x = np.zeros((len(used), width), np.float32)
        x[owner[here], which[here] - s] = 1
        if len(i) * 8 > len(used) ** 2:
            out += (x @ x.T)[a, b].astype(np.int64)
        else:
            for k in range(0, len(i), 2048):
                out[k : k + 2048] += np.einsum("ij,ij->i", x[a[k : k + 2048]], x[b[k : k + 2048]]).astype(np.int64)
    return out


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in units(batches, ["cluster", "bi", "bj"], 1_000):
            nodes, block, bi, bj = (t.column(c).to_numpy() for c in ("node", "block", "bi", "bj"))
            blobs, found = t.column("set"), []
            for s, e in zip(at, [*at[1:], len(nodes)]):
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in blobs.slice(s, e - s)]
                n = np.array([len(x) for x in sets], np.int64)
                points = rtree.Points([rtree.point(x).tobytes() for x in sets], n)
                across = block[s:e] if bi[s] != bj[s] else None
                i, j = rtree.join(points, slice(0, len(n)), num, den, across)
                shared = _overlaps(sets, i, j)
                ok = shared * (num + den) >= num * (n[i] + n[j])
                found.append(_stars(nodes[s:e], i[ok], j[ok]))
            yield _edges_batch(found)

    return run


def _full_sets(k: int, wanted, nameless: bool):
    """node and set of the rows whose doc_id may be wanted, and of rows without one if any is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chosen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id")
                keep = wanted.value.holds(ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(keep | (ids.is_null().to_numpy(zero_copy_only=False) & nameless)))

        for _, texts in hashed_texts(chosen()):
            made = [s for h in texts if len(s := np.unique(shingle_hashes(h, k)))]
            yield pa.RecordBatch.from_arrays([column([node_of(s) for s in made], pa.int64()), column([s.tobytes() for s in made], pa.binary())], ["node", "set"])

    return run


def links(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """sets: doc_id, node, n per row of `docs`. edges: a, b, verified links between nodes, enough
    to connect every two nodes that a chain of links connects."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    late = spark.sparkContext.broadcast(common_shingles(docs.select("text"), k))  # at most COMMON numbers
    sets = materialise(docs.mapInArrow(lean(_sets(k, num, den, late)), SETS), "shingle-sets")
    real = sets.where("node is not null")
    reps = real.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    keyed = reps.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    cells = materialise(keyed.join(shared, "key").select("key", "node", "m"), "cells")
    inside = cells.select("node").distinct()
    points = real.join(inside, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("point").alias("point"))
    large = F.col("m") > BLOCK
    small_cells = cells.where(~large).select("key", "node", F.lit(0).alias("block"), F.lit(0).alias("bi"), F.lit(0).alias("bj"))
    large_cells = in_blocks(cells.where(large).select("key", "node"), ["key"], cells.where(large).select("key", "m").distinct(), BLOCK)
    dealt = small_cells.unionByName(large_cells).join(points, "node").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    near = dealt.select("key", "bi", "bj", "block", "node", "n", "point").mapInArrow(lean(_join_cells(num, den)), "a long, b long")
    clusters = components(near).select("node", F.col("comp").alias("cluster"))
    clusters = materialise(clusters, "clusters")
    named = real.join(clusters, "node").groupBy("cluster", "node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    named = materialise(named, "cluster-members")
    counts = named.groupBy("cluster").agg(F.sum(F.ceil(F.col("n") / HEAVY)).alias("m"))
    ids = named.agg(F.count("*").alias("n"), F.count("doc_id").alias("named")).first()
    wanted = spark.sparkContext.broadcast(bloom.build(named.select("doc_id"), ids["n"]))
    full = docs.mapInArrow(lean(_full_sets(k, wanted, ids["n"] > ids["named"])), "node long, set binary")
    members = in_blocks(clusters, ["cluster"], counts, BLOCK).join(full, "node").repartition("cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj")
    edges = members.select("cluster", "bi", "bj", "block", "node", "set").mapInArrow(lean(_verify(num, den)), "a long, b long")
    return sets.select("doc_id", "node", "n"), edges


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: texts link when their sets' Jaccard
    similarity is num/den or more."""
    sets, edges = links(docs, k, num, den)
    named = components(edges)
    rows = sets.join(named, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "comp", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, similarity of 85/100 or more, over all documents."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), 4, 85, 100)


ORACLE = r"""
WITH ws AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s
  FROM ws),
reps AS (SELECT min(doc_id) AS node, any_value(s) AS s, list_sort(s) AS k FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
e AS (SELECT node, len(s) AS n, unnest(s) AS g FROM reps),
pairs AS (
  SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.g = b.g AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
walk AS (
  WITH RECURSIVE r(node, seen) AS (
    SELECT node, node FROM reps UNION SELECT r.node, x.b FROM r JOIN both_ways x ON x.a = r.seen)
  SELECT node, min(seen) AS comp FROM r GROUP BY node)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(w.comp, s.doc_id) AS component_id
FROM sets s LEFT JOIN reps ON len(s.s) > 0 AND list_sort(s.s) = reps.k LEFT JOIN walk w ON w.node = reps.node
"""
