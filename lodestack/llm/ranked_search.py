"""The best documents for each query text: a clustered index in an order that keeps like documents together.

Documents are reordered by recursive graph bisection: a set is halved, and documents are swapped
between the halves while that shortens the postings' gaps. The upper halvings are fitted on a
documented sample of at most SAMPLE documents, and all documents go down them by what their terms
would cost on either side; the leaves are dealt into segments of about SEGMENT documents, and every
segment is bisected in full down to clusters of CLUSTER documents, by one task each. All documents
are in the index, which holds the postings of the query terms.

A cluster's bound for a query is the sum of its largest scores per query term; a segment's bound is
that of its best cluster. A query visits the segments of highest bounds first, in WAVES, and then all
whose bound is not below its tenth score so far; inside a segment it visits clusters alike.
Stopping is exact: what is left out cannot reach the tenth score, not even as a tie. Places in the
new order are mapped back to doc_id before ties are broken.

Queries are taken in blocks of BLOCK_BYTES of text, which bounds what goes to tasks and driver: a
block's terms, thresholds and first segments. Nothing that grows with the documents is broadcast.

Cases. A null or empty text has no terms: such a document is not counted, such a query has no rows.
Rows of one doc_id are documents of their own, and rows of one item_id queries of their own; a null
doc_id comes last among equal scores. Empty tables give no rows. Other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm.common import column, discard, fresh, lean, materialise, numbered, raw, table, units

TOP, WAVES = 10, (4, 32)
SAMPLE, SEGMENT, CLUSTER, ROUNDS = 8192, 4096, 128, 8
BLOCK_BYTES, ITEM_BYTES = 8 << 20, 2048  # of query texts in a block; what each query counts besides

_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all that is beyond ASCII, A-Z lower-cased."""
    return raw(text).translate(_TERMS).split()


def bits(a: np.ndarray, b: np.ndarray, m: int, n: int) -> np.ndarray:
    """What the gaps of postings cost that number a among m documents and b among n others."""
    a, b = np.maximum(a, 0), np.maximum(b, 0)
    return a * np.log2(m / (a + 1)) + b * np.log2(n / (b + 1))


def halves(doc: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Halve n documents, given as postings (doc, term): which go right, and the distinct terms with
    their numbers of documents on the left and on the right."""
    known, own = np.unique(term, return_inverse=True)
    right = np.arange(n) >= (n + 1) // 2
    m, k = int((~right).sum()), int(right.sum())
    total = np.bincount(own, minlength=len(known))
    there = np.bincount(own, right[doc], len(known))
    for _ in range(ROUNDS):
        here = total - there
        now = bits(here, there, m, k)
        gain = np.where(right[doc], (now - bits(here + 1, there - 1, m, k))[own], (now - bits(here - 1, there + 1, m, k))[own])
        gain = np.bincount(doc, gain, n)
        left_ids, right_ids = np.flatnonzero(~right), np.flatnonzero(right)
        left_ids = left_ids[np.argsort(-gain[left_ids], kind="stable")]
        right_ids = right_ids[np.argsort(-gain[right_ids], kind="stable")]
        pairs = min(m, k)
        swap = gain[left_ids[:pairs]] + gain[right_ids[:pairs]] > 1e-9
        if not swap.any():
            break
        right[left_ids[:pairs][swap]] = True
        right[right_ids[:pairs][swap]] = False
        there = np.bincount(own, right[doc], len(known))
    return right, known, total - there, there


def bisected(doc: np.ndarray, term: np.ndarray, n: int, least: int = CLUSTER) -> np.ndarray:
    """The documents in the order that recursive bisection gives them."""
    if n <= least:
        return np.arange(n)
    right, *_ = halves(doc, term, n)
    order = []
    for side in (False, True):
        ids = np.flatnonzero(right == side)
        place = np.full(n, -1)
        place[ids] = np.arange(len(ids))
        own = right[doc] == side
        order.append(ids[bisected(place[doc[own]], term[own], len(ids), least)])
    return np.concatenate(order)


class Halvings:
    """The upper halvings: per level the weights of (node, term) for going right."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, n: int, depth: int, n_terms: int):
        self.n_terms, self.levels = max(n_terms, 1), []
        node = np.ones(n, np.int64)
        for _ in range(depth):
            keys, weights, after = [], [], node * 2
            for at in np.unique(node):
                ids = np.flatnonzero(node == at)
                if len(ids) < 2:
                    continue
                place = np.full(n, -1)
                place[ids] = np.arange(len(ids))
                own = place[doc] >= 0
                right, known, here, there = halves(place[doc[own]], term[own], len(ids))
                m, k = int((~right).sum()), int(right.sum())
                keys.append(at * self.n_terms + known)
                weights.append(bits(here + 1, there, m, k) - bits(here, there + 1, m, k))
                after[ids] += right
            self.levels.append([np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.int64), (weights, np.float64))])
            node = after

    def leaves(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        node = np.ones(n, np.int64)
        for keys, weights in self.levels:
            wanted = node[doc] * self.n_terms + term
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            own = np.where(keys[at] == wanted, weights[at], 0.0) if len(keys) else np.zeros(len(wanted))
            node = node * 2 + (np.bincount(doc, own, n) > 0)
        return node


def postings(batch, name: str = "terms") -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each element of a list column."""
    lists = batch.column(name)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy()), lists.flatten().to_numpy()


_MATCHED = "doc_id long, n long, terms array<int>, tfs array<int>, docs long"


def _match(vocabulary):
    """Documents with query terms; and for each task a row with the number of its documents that have
    terms, and with the number of all those terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, length = vocabulary.value, 0, 0
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())
        names = ["doc_id", "n", "terms", "tfs", "docs"]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(text.as_py())
                docs += bool(found)
                length += len(found)
                counts: dict[int, int] = {}
                for t in found:
                    if (k := known.get(t)) is not None:
                        counts[k] = counts.get(k, 0) + 1
                if counts:
                    own = sorted(counts)
                    rows.append((doc_id, len(found), own, [counts[k] for k in own], None))
            yield pa.RecordBatch.from_arrays([column([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)
        yield pa.RecordBatch.from_arrays([column([x], t) for x, t in zip((None, length, None, None, docs), kinds)], names)

    return run


def _leaves(halvings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, term = postings(batch)
            leaf = halvings.value.leaves(doc, term, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, column(leaf, pa.int64())], [*batch.schema.names, "leaf"])

    return run


_SEGMENT = "segment long, ids binary, group_term binary, group_cluster binary, group_most binary, group_start binary, place binary, impact binary"


def _segments(weights, n_docs: int, length: int):
    """One row per segment: the doc_ids in their new order, and its postings by term and cluster with
    the score that each adds. A null doc_id is the largest number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.binary()] * 7]
        names = [f.split()[0] for f in _SEGMENT.split(", ")]
        for t, at in units(batches, ["segment"], 2 * SEGMENT, 16 << 20):
            for s, e in zip(at, [*at[1:], t.num_rows]):
                own = t.slice(s, e - s)
                doc, term = postings(own)
                _, tf = postings(own, "tfs")
                order = bisected(doc, term, e - s)
                place = np.empty(e - s, np.int64)
                place[order] = np.arange(e - s)
                n = own.column("n").to_numpy()
                if 90 * int(n.max()) * n_docs < 1 << 63:
                    m = 10 + 90 * n * n_docs // length
                else:
                    m = np.array([10 + 90 * int(x) * n_docs // length for x in n])
                tf = tf.astype(np.int64)
                impact = weights.value[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                at_place = place[doc]
                by = np.lexsort((at_place, term))
                term, at_place, impact = term[by], at_place[by], impact[by]
                cluster = at_place // CLUSTER
                start = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (cluster[1:] != cluster[:-1])))
                most = np.maximum.reduceat(impact, start)
                ids = own.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()[order]
                parts = [ids, term[start].astype(np.int32), cluster[start].astype(np.int32), most, np.append(start, len(term)).astype(np.int32), at_place.astype(np.int32), impact]
                row = [int(own.column("segment")[0].as_py()), *(np.ascontiguousarray(p).tobytes() for p in parts)]
                yield pa.RecordBatch.from_arrays([column([x], k) for x, k in zip(row, kinds)], names)

    return run


class Segment:
    """A segment as its queries see it."""

    def __init__(self, row: dict):
        self.number = row["segment"]
        self.term, self.cluster = (np.frombuffer(row[c], np.int32) for c in ("group_term", "group_cluster"))
        self.most = np.frombuffer(row["group_most"], np.int64)
        self.clusters = int(self.cluster.max()) + 1
        if "place" in row:
            self.start, self.place = (np.frombuffer(row[c], np.int32) for c in ("group_start", "place"))
            self.impact, self.ids = (np.frombuffer(row[c], np.int64) for c in ("impact", "ids"))

    def bounds(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups of these terms and the bound of each cluster."""
        a, b = np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, "right")
        groups = np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
        return groups, np.bincount(self.cluster[groups], self.most[groups], self.clusters).astype(np.int64)

    def best(self, terms: np.ndarray, least: int) -> list[tuple[int, int]]:
        """(-score, doc_id) of the TOP best documents of `least` or more, clusters of highest bounds first."""
        groups, bound = self.bounds(terms)
        order = np.argsort(-bound, kind="stable")
        found: list[tuple[int, int]] = []
        for a, b in ((0, 4), (4, 16), (16, len(order))):
            wanted = order[a:b][bound[order[a:b]] >= max(least, 1)]
            if not len(wanted):
                break
            chosen = np.zeros(self.clusters, bool)
            chosen[wanted] = True
            own = groups[chosen[self.cluster[groups]]]
            width = self.start[own + 1] - self.start[own]
            at = np.repeat(self.start[own], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            score = np.bincount(self.place[at], self.impact[at], len(self.ids)).astype(np.int64)
            hit = np.flatnonzero(score >= max(least, 1))
            hit = hit[np.lexsort((self.ids[hit], -score[hit]))[:TOP]]
            found = sorted(found + list(zip((-score[hit]).tolist(), self.ids[hit].tolist())))[:TOP]
            if len(found) == TOP:
                least = max(least, -found[-1][0])
        return found


def _bound_rows(queries):
    """(item, segment, bound) of all segments that hold a term of the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment, rows = Segment(row), []
                for item, terms in enumerate(queries.value):
                    if len(terms) and (bound := int(segment.bounds(terms)[1].max())):
                        rows.append((item, segment.number, bound))
                yield pa.RecordBatch.from_arrays([column([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "segment", "bound"])

    return run


_FOUND = "item int, segment long, doc_id long, score long"


def _visit(queries, asked, least):
    """Best documents of each item in a task's segments. `asked` has the items of each segment to visit;
    without it each segment is visited by the items whose `least` its bound reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        floor = dict(enumerate(least.value))
        for batch in batches:
            for n in range(batch.num_rows):
                number = batch.column("segment")[n].as_py()
                wanted = range(len(queries.value)) if asked is None else asked.value.get(number, ())
                segment = Segment({c: batch.column(c)[n].as_py() for c in batch.schema.names}) if len(wanted) else None
                for item in wanted:
                    if len(terms := queries.value[item]):
                        own = [(s, d, number) for s, d in segment.best(terms, floor[item])]
                        held = best[item] = sorted(best.get(item, []) + own)[:TOP]
                        if len(held) == TOP:
                            floor[item] = max(floor[item], -held[-1][0])
        rows = [(item, number, d, -s) for item, held in best.items() for s, d, number in held]
        yield pa.RecordBatch.from_arrays([column([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["item", "segment", "doc_id", "score"])

    return run


def _best(found: DataFrame) -> DataFrame:
    """The TOP best of each item, with their rank."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id", "segment")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def index_of(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[DataFrame | None, int]:
    """The clustered index of all documents for the terms of `vocabulary`, and its number of segments."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    matched = materialise(texts.mapInArrow(lean(_match(context.broadcast(vocabulary))), _MATCHED), "matched")
    n_docs, length = matched.where("docs is not null").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = matched.where("docs is null").drop("docs")
    m = rows.count()
    if not m:
        return None, 0
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in rows.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    depth = max(0, min(math.ceil(math.log2(m / SEGMENT)), int(math.log2(SAMPLE / 64))))
    doc = term = np.zeros(0, np.int64)
    n_sample = 0
    if depth:
        mixed = rows.select("terms", F.xxhash64("doc_id", "n", "terms").alias("h"), F.xxhash64("terms", F.lit(1)).alias("g"))
        sample = mixed.orderBy("h", "g").limit(SAMPLE).select("terms").toArrow()
        n_sample = sample.num_rows
        doc, term = postings(sample)
    halvings = context.broadcast(Halvings(doc, term, n_sample, depth, len(vocabulary)))
    placed = rows.mapInArrow(lean(_leaves(halvings)), "doc_id long, n long, terms array<int>, tfs array<int>, leaf long")
    counts = placed.groupBy("leaf").agg(F.ceil(F.count("*") / SEGMENT).cast("long").alias("parts"))
    sizes = counts.collect()  # a row per leaf: SAMPLE / 64 at most
    parts = F.create_map(*[F.lit(x) for r in sizes for x in (r["leaf"], r["parts"])])
    before, ahead = {}, 0
    for r in sorted(sizes):
        before[r["leaf"]], ahead = ahead, ahead + r["parts"]
    first = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    dealt = placed.withColumn("segment", F.element_at(first, F.col("leaf")) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.element_at(parts, F.col("leaf"))))
    dealt = dealt.select("segment", "doc_id", "n", "terms", "tfs").repartition("segment").sortWithinPartitions("segment")
    index = materialise(dealt.mapInArrow(lean(_segments(context.broadcast(weights), int(n_docs), int(length))), _SEGMENT), "clustered-index")
    discard(matched)
    return index, ahead


def _search_block(docs: DataFrame, items: list[tuple]) -> DataFrame:
    """The best documents for a block of items (item_id, text)."""
    spark = docs.sparkSession
    found_terms = [sorted(set(terms_of(text))) for _, text in items]
    vocabulary = {t: k for k, t in enumerate(sorted({t for own in found_terms for t in own}))}
    queries = spark.sparkContext.broadcast([np.array(sorted(vocabulary[t] for t in own), np.int64) for own in found_terms])
    index, n_segments = index_of(docs, vocabulary) if vocabulary else (None, 0)
    empty = spark.createDataFrame([], _FOUND)
    found, least, asked_before = empty, [1] * len(items), 0
    if index is not None and n_segments > WAVES[0]:
        groups = index.select("segment", "group_term", "group_cluster", "group_most")
        bounds = materialise(groups.mapInArrow(lean(_bound_rows(queries)), "item int, segment long, bound long"), "bounds")
        order = Window.partitionBy("item").orderBy(F.col("bound").desc(), "segment")
        for upto in WAVES:
            floors = F.broadcast(spark.createDataFrame(list(enumerate(least)), "item int, least long"))  # a block's items
            ranked = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= upto)
            wave = ranked.where(F.col("place") > asked_before).join(floors, "item").where("bound >= least")
            asked: dict[int, list[int]] = {}
            for item, segment in wave.select("item", "segment").toLocalIterator():  # `upto` for each item of a block at most
                asked.setdefault(segment, []).append(item)
            if asked:
                seen = index.where(F.col("segment").isin(*asked)) if len(asked) < 1000 else index
                asked, floor = spark.sparkContext.broadcast(asked), spark.sparkContext.broadcast(least)
                own = seen.mapInArrow(lean(_visit(queries, asked, floor)), _FOUND)
                found = materialise(_best(found.unionByName(own)).select("item", "segment", "doc_id", "score"), "best")
                last = found.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") == TOP)
                for item, _, s in last.toLocalIterator():
                    least[item] = s
            asked_before = upto
        discard(bounds)
    if index is not None:  # the last wave meets the first segments again, so it has all that counts
        found = index.mapInArrow(lean(_visit(queries, None, spark.sparkContext.broadcast(least))), _FOUND)
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "item int, item_id long")
    best = _best(found).join(F.broadcast(names), "item")  # a block's items
    doc_id = F.when(F.col("doc_id") < np.iinfo(np.int64).max, F.col("doc_id"))
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), doc_id.alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id and score of the TOP best documents for each row of `items` (item_id, text)."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ITEM_BYTES)
    total = items.agg(F.sum("size")).first()[0] or 0
    if total <= BLOCK_BYTES:
        return _search_block(docs, [(r["item_id"], r["text"]) for r in items.select("item_id", "text").collect()])
    ahead = fresh(items, "ahead")
    blocks = materialise(numbered(materialise(items, "items"), ["item_id", "text"], "size", ahead).withColumn("block", F.floor(F.col(ahead) / BLOCK_BYTES)), "item-blocks")
    out = None
    for block in range(math.ceil(total / BLOCK_BYTES)):
        own = [(r["item_id"], r["text"]) for r in blocks.where(F.col("block") == block).select("item_id", "text").collect()]
        part = materialise(_search_block(docs, own), "best-of-block")
        out = part if out is None else out.unionByName(part)
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH text AS (
  SELECT 0 AS item, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 1, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
term AS (SELECT item, id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM text),
tf AS (SELECT item, id, term, count(*) AS tf FROM term GROUP BY ALL),
n AS (SELECT id, sum(tf)::BIGINT AS n FROM tf WHERE item = 0 GROUP BY id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM n),
query AS (SELECT id AS item_id, term FROM tf WHERE item = 1),
df AS (SELECT term, count(*) AS df FROM tf WHERE item = 0 AND term IN (SELECT term FROM query) GROUP BY term),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, whole),
score AS (
  SELECT q.item_id, tf.id AS doc_id,
    sum(w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * n.n * docs) // length))))::BIGINT AS score
  FROM query q JOIN weight USING (term) JOIN tf ON tf.item = 0 AND tf.term = q.term JOIN n ON n.id = tf.id, whole
  GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM score WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
