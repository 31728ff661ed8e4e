"""Line dedup: lines that several documents hold stay in the first of them only.

Lines are normalised, hashed to 128 bits and reduced to one row per hash with the number of rows
that hold it and the smallest and largest doc_id (partial sums before the shuffle, so a line that a
third of all documents hold sends one row per task). Only hashes of two or more documents are
written. The HOT ones that most rows hold go to the tasks, where they need no join at all; hashes of
the others that a Bloom filter lets through meet them in a join, which has few rows for each, and
only documents that lose such a line are joined with what they lose. No other text is shuffled, and
each document is put together again by position.

Cases. Null or empty text: one empty line, kept. Lines whose key is shorter than `min_chars`
stay. Rows of one doc_id count as one document and each is returned. A null doc_id takes no
part: all its lines stay. An empty table gives an empty result. Columns of the input other than
doc_id and text take no part and pass through `dedup_lines`; those called n_lines or n_dropped
come out as n_lines_input and n_dropped_input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestack.llm import bloom
from lodestack.llm.common import column, fresh, lean, materialise, set_aside, table

HOT = 100_000  # hashes that go to the tasks, some 20 MB as a dictionary
_STRIP = b" \t\n\x0b\x0c\r"


def _chars(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "surrogatepass"))


def _keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """For each line the 16-byte hash of its key, None when it is too short to count."""
    return [
        xxhash.xxh3_128_digest(k) if len(k) >= min_chars and _chars(k) >= min_chars else None
        for k in (line.strip(_STRIP).lower() for line in text.split(b"\n"))
    ]


def _line_hashes(min_chars: int, seen=None, hot: dict | None = None):
    """h1, h2 and doc of each document's distinct keys; where `seen` is given only of those that it
    may hold, the hot ones left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            keys, docs = [], []
            for doc, text in zip(ids, texts):
                if doc is None or not (text := text.as_py()):
                    continue
                own = {k for k in _keys(text, min_chars) if k}
                if hot is not None:
                    own = [k for k in own if k not in hot.value]
                keys += own
                docs += [doc] * len(own)
            h = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
            docs = np.array(docs, np.int64)
            if seen is not None and len(h):
                found = seen.value.holds(h[:, 0].copy())
                h, docs = h[found], docs[found]
            yield pa.RecordBatch.from_arrays([column(x, pa.int64()) for x in (h[:, 0], h[:, 1], docs)], ["h1", "h2", "doc"])

    return run


def _rebuild(min_chars: int, hot, drop: str | None, names: list[str], counts: bool):
    """Documents without lines that are hot and another's, or named in the column `drop`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = hot.value
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            drops = batch.column(drop) if drop else [None] * len(texts)
            out, lines_n, lost_n = [], [], []
            for doc, text, lost in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), texts, drops):
                lines = kept = (text.as_py() or b"").split(b"\n")
                if doc is not None:
                    own = frozenset(lost.as_py() or ()) if lost is not None else ()
                    kept = [line for line, key in zip(lines, _keys(text.as_py() or b"", min_chars)) if key is None or (owner.get(key, doc) == doc and key not in own)]
                out.append(b"\n".join(kept))
                lines_n.append(len(lines))
                lost_n.append(len(lines) - len(kept))
            made = {"text": column(out, pa.binary()).cast(pa.string())}
            if counts:
                made |= {"n_lines": column(lines_n, pa.int64()), "n_dropped": column(lost_n, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names)

    return run


def _hottest(shared: DataFrame, most: int) -> int:
    """The number of rows from which on a hash is hot: no more than `most` hashes have as many."""
    step = F.floor(F.log2("n") * 16)  # at most a thousand steps, whatever the corpus
    least, total = None, 0
    for r in shared.groupBy(step.alias("step")).agg(F.count("*").alias("hashes"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():
        total += r["hashes"]
        if total > most:
            break
        least = r["n"]
    return 1 << 62 if least is None else least


def dedup_lines(docs: DataFrame, min_chars: int = 10, counts: bool = True) -> DataFrame:
    """`docs` with `text` without the lines that an earlier document holds, and n_lines, n_dropped;
    without `counts` nothing but the columns of `docs`, whatever their names."""
    spark = docs.sparkSession
    docs = (set_aside(docs, ["n_lines", "n_dropped"]) if counts else docs).withColumns({"text": F.col("text").cast("string"), "doc_id": F.col("doc_id").cast("long")})
    texts = docs.select("doc_id", "text")
    shared = texts.mapInArrow(lean(_line_hashes(min_chars)), "h1 long, h2 long, doc long").groupBy("h1", "h2")
    shared = shared.agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.count("*").alias("n")).where("owner < last").drop("last")
    shared = materialise(shared, "shared-lines")
    least = _hottest(shared, HOT)
    top = shared.where(F.col("n") >= least).toArrow()  # HOT rows at most
    keys = np.stack([top.column(c).to_numpy() for c in ("h1", "h2")], 1).astype(">i8")
    hot = spark.sparkContext.broadcast({keys[i].tobytes(): o for i, o in enumerate(top.column("owner").to_pylist())})
    schema = StructType(list(docs.schema))
    if counts:
        schema = schema.add("n_lines", "long").add("n_dropped", "long")
    cold = shared.where(F.col("n") < least)
    n_cold = cold.count()
    if not n_cold:
        return docs.mapInArrow(lean(_rebuild(min_chars, hot, None, schema.names, counts)), schema)
    seen = spark.sparkContext.broadcast(bloom.build(cold.select("h1"), n_cold))
    lines = texts.mapInArrow(lean(_line_hashes(min_chars, seen, hot)), "h1 long, h2 long, doc long")
    lost = lines.join(cold, ["h1", "h2"]).where("doc > owner")
    key = F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("h1", "h2")])
    lost = materialise(lost.groupBy("doc").agg(F.collect_set(key).alias("keys")).withColumnRenamed("doc", "doc_id"), "lost-lines")
    maybe, others = bloom.sift(docs, "doc_id", lost.select("doc_id"))
    drop = fresh(docs, "lost")
    joined = maybe.join(lost.withColumnRenamed("keys", drop), "doc_id", "left").select(*docs.columns, drop)
    rest = others.mapInArrow(lean(_rebuild(min_chars, hot, None, schema.names, counts)), schema)
    return rest.union(joined.mapInArrow(lean(_rebuild(min_chars, hot, drop, schema.names, counts)), schema))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_lines, n_dropped and the SHA-256 of the text that stays."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (
  SELECT keyed.*, owner IS NOT NULL AND doc_id <> owner AS lost FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
