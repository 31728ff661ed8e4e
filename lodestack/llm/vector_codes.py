"""Product codes of vectors: four codebooks of 256 entries, refined by integer k-means.

A component x counts as the integer floor(1024 * x). In each round the driver builds a kd-tree over
every codebook and broadcasts the four (4 * 256 entries, whatever the number of vectors); tasks find
each part's nearest entry by branch and bound and add the parts up per entry, so what leaves a task
is one row per used entry. Spark adds those rows up, and the driver sets the entries anew. Sums,
distances and bounds are whole numbers, so results don't depend on how rows are dealt out.

A search takes many parts at once: each goes down to the leaf whose box is nearest, and then every
node whose bound is not above the best distance so far is visited. Equal bounds are visited, as
such a node may hold an entry of lower index at the same distance.

Cases. Vectors that are null, empty, or hold nulls, NaN or infinities are dropped. Rows of one vec_id
are vectors of their own; among the first 256 they are ordered by their components. A null vec_id
comes last. With fewer than 256 vectors there are as many entries. Without any there are no rows.
Null labels are one label. Other columns take no part. Errors: vectors of different lengths, lengths
that 4 does not divide, and components so large that whole numbers of 64 bits can't hold a distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import column, lean, materialise, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries in a leaf of a tree; labels that go to the tasks as they are; rows of a label from which on it is dealt into groups.
LEAF, LABELS, HOT, SALT = 8, 500_000, 100_000, 64


class KdTree:
    """Nearest entry of a codebook by squared distance, the lower index at equal ones."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self.children: list[tuple[int, int] | None] = []
        self.members: list[np.ndarray] = []
        if len(entries):
            self._grow(np.arange(len(entries)))

    def _grow(self, own: np.ndarray) -> int:
        at, points = len(self.boxes), self.entries[own]
        low, high = points.min(0), points.max(0)
        self.boxes.append((low, high))
        self.children.append(None)
        self.members.append(own)
        axis = int(np.argmax(high - low))
        if len(own) > LEAF and high[axis] > low[axis]:
            order = own[np.argsort(points[:, axis], kind="stable")]
            half = len(order) // 2
            self.children[at] = (self._grow(np.sort(order[:half])), self._grow(np.sort(order[half:])))
        return at

    def _bound(self, node: int, q: np.ndarray) -> np.ndarray:
        low, high = self.boxes[node]
        away = np.maximum(np.maximum(low - q, q - high), 0)
        return (away * away).sum(1)

    def _leaf(self, node: int, rows: np.ndarray, q: np.ndarray, best: np.ndarray, who: np.ndarray) -> None:
        own = self.members[node]
        away = squares(q[rows], self.entries[own])
        at = away.argmin(1)  # the first of equal ones, and members ascend
        found, index = away[np.arange(len(rows)), at], own[at]
        better = (found < best[rows]) | (found == best[rows]) & (index < who[rows])
        best[rows[better]], who[rows[better]] = found[better], index[better]

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry to each row of q."""
        best, who = np.full(len(q), np.iinfo(np.int64).max), np.full(len(q), len(self.entries))
        descent = [(0, np.arange(len(q)))]
        while descent:
            node, rows = descent.pop()
            if self.children[node] is None:
                self._leaf(node, rows, q, best, who)
                continue
            left, right = self.children[node]
            nearer = self._bound(left, q[rows]) <= self._bound(right, q[rows])
            descent += [(n, r) for n, r in ((left, rows[nearer]), (right, rows[~nearer])) if len(r)]
        visit = [(0, np.arange(len(q)))]
        while visit:
            node, rows = visit.pop()
            rows = rows[self._bound(node, q[rows]) <= best[rows]]
            if not len(rows):
                continue
            if self.children[node] is None:
                self._leaf(node, rows, q, best, who)
            else:
                visit += [(n, rows) for n in self.children[node]]
        return who, best


def squares(q: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of whole-number rows, exactly."""
    if not q.size or not entries.size:
        return np.zeros((len(q), len(entries)), np.int64)
    most = 2 * max(int(np.abs(q).max()), int(np.abs(entries).max()))
    if most * most * q.shape[1] < 1 << 52:  # doubles hold all terms
        a, b = q.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    away = q[:, None, :] - entries[None, :, :]
    return (away * away).sum(2)


def whole_vectors(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors that are kept, and their components as integers."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy()
    flat = vectors.flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(x)  # a null is NaN here
    spoilt = np.add.reduceat(np.append(bad, False), np.append(0, np.cumsum(lengths))[:-1].clip(max=len(bad))) if len(lengths) else lengths
    kept = np.flatnonzero((lengths > 0) & (spoilt == 0))
    dims = np.unique(lengths[kept])
    if len(dims) > 1 or len(dims) and dims[0] % PARTS:
        raise ValueError(f"vectors have to be of one length that {PARTS} divides, not {dims.tolist()}")
    x = x[np.repeat((lengths > 0) & (spoilt == 0), lengths)].reshape(len(kept), dims[0] if len(dims) else PARTS)
    whole = np.floor(x * SCALE)
    if whole.size and 4 * np.abs(whole).max() ** 2 * whole.shape[1] >= 2.0**63:
        raise ValueError("components are too large for squared distances of 64 bits")
    return kept, whole.astype(np.int64)


def _first(entries: int):
    """The first rows of a task by vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            kept, whole = whole_vectors(batch.column("embedding"))
            ids = batch.column("vec_id").take(pa.array(kept)).to_pylist()
            last = held[-1][:2] if len(held) == entries else (True, 0)
            near = [(v is None, v or 0, x) for v, x in zip(ids, whole) if (v is None, v or 0) <= last]
            held = sorted(held + [(none, v, tuple(x.tolist())) for none, v, x in near])[:entries]
        out = [column([h[i] for h in held], t) for i, t in enumerate((pa.bool_(), pa.int64(), pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays(out, ["last", "vec_id", "whole"])

    return run


def _sums(trees):
    """Per part and used entry of a task the number of its vectors and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            _, whole = whole_vectors(batch.column("embedding"))
            if not len(whole):
                continue
            width = whole.shape[1] // PARTS
            if total is None:
                total = np.zeros((PARTS, ENTRIES, 1 + width), np.int64)
            for part, tree in enumerate(trees.value):
                own = whole[:, part * width : (part + 1) * width]
                who, _ = tree.nearest(own)
                np.add.at(total[part], who, np.column_stack([np.ones(len(own), np.int64), own]))
        if total is not None:
            part, entry = np.nonzero(total[:, :, 0])
            rows = [part, entry, list(total[part, entry])]
            yield pa.RecordBatch.from_arrays([column(r, t) for r, t in zip(rows, (pa.int32(), pa.int32(), pa.list_(pa.int64())))], ["part", "entry", "sums"])

    return run


def _codes(trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, whole = whole_vectors(batch.column("embedding"))
            if not len(kept):
                continue
            width, error, codes = whole.shape[1] // PARTS, np.zeros(len(kept), np.int64), []
            for part, tree in enumerate(trees.value):
                who, away = tree.nearest(whole[:, part * width : (part + 1) * width])
                error += away
                codes.append(who)
            code = [row.tobytes().hex() for row in np.column_stack(codes).astype(np.uint8)]
            own = [batch.column(c).take(pa.array(kept)) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*own, column(code, pa.string()), column(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def codebooks(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The entries (part, entry, position) after `rounds` rounds over the vectors of `rows`."""
    spark = rows.sparkSession
    vectors = rows.select("vec_id", "embedding")
    first = vectors.mapInArrow(lean(_first(ENTRIES)), "last boolean, vec_id long, whole array<long>")
    start = [r["whole"] for r in first.orderBy("last", "vec_id", "whole").limit(ENTRIES).collect()]
    if not start:
        return np.zeros((PARTS, 0, 0), np.int64)
    if len({len(x) for x in start}) > 1:
        raise ValueError("vectors have to be of one length")
    books = np.array(start, np.int64).reshape(len(start), PARTS, -1).swapaxes(0, 1).copy()
    vectors = rows.select("embedding")
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([KdTree(b) for b in books])
        sums = vectors.mapInArrow(lean(_sums(trees)), "part int, entry int, sums array<long>")
        wide = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(1 + books.shape[2])]
        for part, entry, n, *total in sums.groupBy("part", "entry").agg(*wide).collect():  # a row per entry
            books[part, entry] = np.array(total, np.int64) // n
        trees.unpersist()
    return books


def product_codes(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each vector of `rows` (vec_id,
    embedding, label) that is kept."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    books = codebooks(rows)
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    trees = rows.sparkSession.sparkContext.broadcast([KdTree(b) for b in books])
    kind = rows.schema["label"].dataType.simpleString()
    coded = rows.mapInArrow(lean(_codes(trees)), f"vec_id long, label {kind}, code string, error long")
    coded = materialise(coded, "vector-codes")
    labels = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("m")), "label-errors")
    own = coded.alias("c")
    if labels.count() <= LABELS:  # a checked number of rows, some 16 MB
        joined = own.join(F.broadcast(labels).alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    else:  # a label of many rows is dealt into groups on both sides
        hot = labels.where(F.col("m") >= HOT).select("label", F.lit(SALT).alias("n"))  # a HOT-th of all rows at most
        own = coded.join(hot.hint("shuffle_hash") if hot.count() > LABELS else F.broadcast(hot), coded["label"].eqNullSafe(hot["label"]), "left")
        own = own.select(coded["*"], F.coalesce(F.pmod(F.xxhash64("vec_id", "code"), F.col("n")), F.lit(0)).alias("g")).alias("c")
        groups = F.explode(F.sequence(F.lit(0), F.when(F.col("m") >= HOT, SALT - 1).otherwise(0)))
        dealt = labels.withColumn("g", groups).alias("l")
        joined = own.join(dealt, F.col("c.label").eqNullSafe(F.col("l.label")) & (F.col("c.g") == F.col("l.g")))
    return joined.select("c.vec_id", "c.code", "c.error", "l.label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Each round as two tables: places a<k> of all parts by the entries c<k>, and the entries after it."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(
            f"a{k} AS (SELECT p.vec_id, p.part, min((p.sq - 2 * list_dot_product(p.q, c.q) + c.sq)::BIGINT * {ENTRIES} + c.entry) AS near\n"
            f"  FROM p JOIN c{k} c ON c.part = p.part GROUP BY ALL)"
        )
        if k < ROUNDS:
            steps.append(
                f"m{k} AS (SELECT p.part, a.near % {ENTRIES} AS entry, u.pos, floor(sum(p.q[u.pos])::DECIMAL(38, 0)::DOUBLE / count(*)) AS x\n"
                f"  FROM p JOIN a{k} a USING (vec_id, part), (SELECT unnest(range(1, (SELECT w + 1 FROM dim))) AS pos) u GROUP BY ALL),\n"
                f"n{k} AS (SELECT part, entry, list(x ORDER BY pos) AS q FROM m{k} GROUP BY ALL),\n"
                f"c{k + 1} AS (SELECT c.part, c.entry, coalesce(n.q, c.q) AS q, list_dot_product(coalesce(n.q, c.q), coalesce(n.q, c.q)) AS sq\n"
                f"  FROM c{k} c LEFT JOIN n{k} n USING (part, entry))"
            )
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
dim AS (SELECT max(len(e)) // {PARTS} AS w FROM v),
cut AS (
  SELECT v.vec_id, s.part, list_slice(v.e, s.part * dim.w + 1, (s.part + 1) * dim.w) AS q
  FROM v, dim, (SELECT unnest(range({PARTS})) AS part) s),
p AS (SELECT *, list_dot_product(q, q) AS sq FROM cut),
c0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, q, sq FROM p
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {ENTRIES}),
{(","+chr(10)).join(steps)},
code AS (
  SELECT vec_id, string_agg(printf('%02x', near % {ENTRIES}), '' ORDER BY part) AS code, sum(near // {ENTRIES})::BIGINT AS error
  FROM a{ROUNDS} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(q, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS h FROM c{ROUNDS})
SELECT v.vec_id, code.code, code.error, sum(code.error) OVER (PARTITION BY v.label)::BIGINT AS label_error, book.h AS codebooks_sha256
FROM v JOIN code USING (vec_id), book
"""


#: All parts against all entries.
ORACLE = _oracle()
