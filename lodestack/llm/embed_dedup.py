"""Embedding near-duplicates by collision counting over one-dimensional projections.

Each of M tables sorts the vectors by a random projection, inside buckets of K random sign bits
that keep what is compared in step with the number of vectors. Two vectors collide in a table if
they share its bucket and lie within WINDOW of each other on its projection. Pairs that collide
COUNT times or more are verified by their cosine. K follows the number of vectors, and M follows
from K so that a pair at the threshold itself reaches the count with probability RECALL; closer
pairs do so more often.

Equal vectors become one node first. A task that meets a pair in one bucket works out the pair's
collisions in all tables and keeps it only in the first of them, so no pair is sent anywhere: what
leaves a task is each node's number of links and star edges of what is connected. Buckets of more
than BLOCK nodes are joined in pairs of blocks by as many tasks. Vectors of single precision travel
as such and are compared in double precision; the few large buckets are known before the vectors
are dealt, so each copy of a vector is shuffled once.

Cases. Vectors that are null, zero, or hold nulls, NaN or infinities: no links, a component of
their own. Vectors of different lengths never link. Rows of one vec_id count as vectors of their
own. A null vec_id is never a component's name unless it has no other. An empty table gives no
rows. Other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import column, lean, materialise, table, units
from lodestack.llm.graph import components
from lodestack.llm.rtree import forest

LEAST, RECALL, COUNT, BUCKET, BLOCK = 0.95, 0.98, 2, 64, 2048


def calibrated(n: int, least: float = LEAST) -> tuple[int, int, float]:
    """Sign bits, tables and window for n vectors."""
    bits = max(0, min(30, math.ceil(math.log2(max(n, 1) / BUCKET))))
    sd = math.sqrt(2 - 2 * least)
    window = 2 * sd
    p = (1 - math.acos(least) / math.pi) ** bits * math.erf(2 / math.sqrt(2))
    tables = COUNT
    while sum(math.comb(tables, k) * p**k * (1 - p) ** (tables - k) for k in range(COUNT)) > 1 - RECALL:
        tables += 1
    return bits, tables, window


class Projections:
    def __init__(self, dim: int, bits: int, tables: int):
        rng = np.random.default_rng([dim, 20_011])
        self.lines = rng.standard_normal((dim, tables))
        self.planes = rng.standard_normal((dim, tables * bits))
        self.bits, self.tables = bits, tables

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and places of unit vectors in each table."""
        weight = (1 << np.arange(self.bits, dtype=np.int64))
        signs = (x @ self.planes > 0).reshape(len(x), self.tables, self.bits)
        return signs @ weight, x @ self.lines


def unit_vectors(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for v in batch.column(1):
                x = v.as_py()
                x = np.array(x, np.float64) if x and None not in x else None
                packed.append((x + 0.0).astype(kind).tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), column(packed, pa.binary())], ["vec_id", "vector"])

    return run


def _buckets(bits: int, tables: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Projections] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                vectors = piece.column("vector").to_pylist()
                dims = np.array([len(v) for v in vectors]) // np.dtype(kind).itemsize
                for dim in np.unique(dims).tolist():
                    rows = np.flatnonzero(dims == dim)
                    if dim not in held:
                        held[dim] = Projections(dim, bits, tables)
                    codes, _ = held[dim].of(unit_vectors([vectors[r] for r in rows], kind))
                    own = piece.take(pa.array(rows.repeat(tables)))
                    yield pa.RecordBatch.from_arrays(
                        [column(np.tile(np.arange(tables), len(rows)), pa.int32()), column((codes * 65_536 + dim % 65_536).ravel(), pa.int64()), *own.columns],
                        ["t", "code", *own.schema.names],
                    )

    return run


def _collide(bits: int, tables: int, window: float, least: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Projections] = {}
        for t, at in units(batches, ["t", "code", "bi", "bj"], 4_000):
            nodes, copies, which, block, bi, bj = (t.column(c).to_numpy() for c in ("node", "copies", "t", "block", "bi", "bj"))
            vectors, out = t.column("vector"), [[], [], []]
            for s, e in zip(at, [*at[1:], len(nodes)]):
                if e - s < 2:
                    continue
                raw = vectors.slice(s, e - s).to_pylist()
                dim = len(raw[0]) // np.dtype(kind).itemsize
                if any(len(v) != len(raw[0]) for v in raw):
                    raise ValueError("vectors of 65,536 numbers or more are not supported")
                if dim not in held:
                    held[dim] = Projections(dim, bits, tables)
                x = unit_vectors(raw, kind)
                code, place = held[dim].of(x)
                own, n, k = nodes[s:e], copies[s:e], int(which[s])
                order = np.argsort(place[:, k], kind="stable")
                line = place[order, k]
                reach = np.searchsorted(line, line + window, "right")
                links, ends = np.zeros(e - s, np.int64), []
                for a in range(0, e - s, 256):  # query-centred windows, 256 queries at a time
                    b = min(a + 256, e - s)
                    width = reach[a:b] - np.arange(a, b) - 1
                    i = np.repeat(np.arange(a, b), width)
                    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width)
                    i, j = order[i], order[j]
                    if bi[s] != bj[s]:
                        across = block[s:e][i] != block[s:e][j]
                        i, j = i[across], j[across]
                    hit = np.zeros(len(i), np.int64)
                    first = np.full(len(i), tables)
                    for m in range(tables - 1, -1, -1):
                        same = (code[i, m] == code[j, m]) & (np.abs(place[i, m] - place[j, m]) <= window)
                        hit += same
                        first[same] = m
                    ok = (first == k) & (hit >= COUNT)
                    i, j = i[ok], j[ok]
                    ok = np.einsum("ij,ij->i", x[i], x[j]) >= least
                    i, j = i[ok], j[ok]
                    np.add.at(links, i, n[j])
                    np.add.at(links, j, n[i])
                    ends.append((i, j))
                i, j = (np.concatenate([p[q] for p in ends]) for q in (0, 1))
                root = forest(e - s, i, j)
                linked = np.flatnonzero(links)
                out[0].append(own[linked])
                out[1].append(own[root[linked]])
                out[2].append(links[linked])
            node, other, links = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)
            yield pa.RecordBatch.from_arrays([column(v, pa.int64()) for v in (node, other, links)], ["node", "other", "links"])

    return run


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of `vectors` (vec_id, embedding)."""
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialise(rows.mapInArrow(lean(_valid(kind)), "vec_id long, vector binary"), "vectors")
    classes = rows.where("vector is not null").groupBy("vector").agg(F.count("*").alias("copies"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    n = classes.count()
    bits, tables, window = calibrated(n, least)
    spread = classes.select("node", "copies", "vector").mapInArrow(lean(_buckets(bits, tables, kind)), "t int, code long, node long, copies long, vector binary")
    large = materialise(spread.groupBy("t", "code").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK), "large-buckets")
    parts = F.coalesce(F.ceil(F.col("m") / BLOCK).cast("int"), F.lit(1))
    blocks = spread.join(large, ["t", "code"], "left").withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))
    pairs = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
    dealt = pairs.repartition("t", "code", "bi", "bj").sortWithinPartitions("t", "code", "bi", "bj")
    dealt = dealt.select("t", "code", "bi", "bj", "block", "node", "copies", "vector")
    found = materialise(dealt.mapInArrow(lean(_collide(bits, tables, window, least, kind)), "node long, other long, links long"), "collisions")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = classes.join(links, "node", "left").join(named, "node", "left")
    placed = placed.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp"))
    joined = rows.where("vector is not null").join(placed, "vector").select("vec_id", "n_links", "comp")
    least_id = joined.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    good = joined.join(least_id, "comp").select("vec_id", "n_links", "component_id")
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs, for data as small as the correctness check's; every pair there is far from the threshold.
ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
walk AS (
  WITH RECURSIVE r(node, seen) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT r.node, p.b FROM r JOIN pairs p ON p.a = r.seen)
  SELECT node, min(seen) AS comp FROM r GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, w.comp AS component_id, v.vec_id = w.comp AS kept
FROM v LEFT JOIN walk w ON w.node = v.vec_id LEFT JOIN degree d ON d.a = v.vec_id
"""
