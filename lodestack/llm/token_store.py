"""Content-addressed token store.

Texts become id streams; a rolling hash over the last eight ids cuts each stream into chunks at
places that depend on content only, so equal passages give equal chunks wherever they stand. A
chunk is stored once, under its BLAKE2 digest. A document is a recipe: the digests of its chunks
in order and the Merkle root over them. Recipes are written in ascending doc_id order with the
place of each document in the one long stream; a manifest holds a Merkle root per recipe file,
over doc_id, start, n and root of its recipes, and one root over all files comes from it. Reading
verifies every chunk against its digest, every recipe against its root, every recipe file against
the manifest and, where the store's root is given, the manifest against that; it gives back the
documents' checksums.

Files under the store's folder: `parts/kind=1` chunks (key, n, little-endian ids in data, of 16 bits
or, where the vocabulary is larger, 32), `recipes` (doc_id, start, n, keys, root), `manifest` (file order, first and last doc_id,
documents, root).

Cases. Null or empty text: only the end id. Very long texts are one document of many chunks.
A null doc_id comes first in the order. Rows of one doc_id are stored one after the other,
shorter ones first; equal rows in any order. An empty table gives an empty store. Other columns take no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import tokens
from lodestack.llm.common import column, lean, mix, new_path, numbered, table, writing

MEAN, LEAST, MOST, WINDOW = 512, 128, 4096, 8
MEMORY = 1_000_000  # pre-tokens remembered by a worker, some 150 MB
KEY = 16
PART = "kind int, doc_id long, route long, key binary, n long, data binary, root binary"
MANIFEST = "file string, first_start long, last_start long, documents long, root binary"
RECIPE = "doc_id long, start long, n long, keys binary, root binary"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=KEY).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of digests; an odd one out moves up as it is."""
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else digest(b"")


_MIXED = mix(np.arange(1, 65_537, dtype=np.uint64))


def marks(ids: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash of the last WINDOW ids allows a cut. Several streams may
    follow each other in `ids`: a stream's first places are never used, as chunks have LEAST ids."""
    h = _MIXED[ids] if ids.dtype.itemsize == 2 else mix(ids.astype(np.uint64) + np.uint64(1))
    roll = h.copy()
    for i in range(1, WINDOW):
        roll[i:] += h[:-i] << np.uint64(i)
    return np.flatnonzero((mix(roll) & np.uint64(MEAN - 1)) == 0) + 1


def ends(found: list[int], n: int) -> list[int]:
    """Ends of the chunks of a stream of n ids with marks `found`."""
    out, last = [], 0
    for end in [*found, n]:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST or end == n:
            if end > last:
                out.append(end)
            last = end
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    return ends(marks(ids).tolist(), len(ids)) if len(ids) > WINDOW else [len(ids)]


def _parts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows: list[tuple] = []
                seen: set[bytes] = set()
                piece = batch.slice(at, 512)
                streams = list(tokens.ids_of(piece.column(1), path, MEMORY))
                starts = np.cumsum([0, *map(len, streams)])
                allowed = marks(np.concatenate([*streams, np.zeros(WINDOW, streams[0].dtype)]))
                first = np.searchsorted(allowed, starts, "right")
                for k, (doc, ids) in enumerate(zip(piece.column(0).to_pylist(), streams)):
                    keys, start = [], 0
                    for end in ends((allowed[first[k] : first[k + 1]] - starts[k]).tolist(), len(ids)):
                        data = ids[start:end].tobytes()
                        keys.append(key := digest(data))
                        if key not in seen:
                            seen.add(key)
                            rows.append((1, None, int.from_bytes(key[:8], "little", signed=True), key, end - start, data, None))
                        start = end
                    root, told = merkle(keys), told + 1
                    route = int.from_bytes(digest(root + told.to_bytes(8, "little"))[:8], "little", signed=True)  # recipes go anywhere
                    rows.append((0, doc, route, None, len(ids), b"".join(keys), root))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
                names = ["kind", "doc_id", "route", "key", "n", "data", "root"]
                yield pa.RecordBatch.from_arrays([column([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their keys, only the first of each chunk."""
    last = None
    for batch in batches:
        keep = []
        for key in batch.column("key").to_pylist():
            keep.append(key is None or key != last)
            last = key
        yield batch.filter(pa.array(keep, pa.bool_()))


def _ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u4" if len(data) == 4 * n else "<u2")


def _chunk_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for key, n, data in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "data"))):
            ids = _ids(data, n)
            if digest(data) != key or len(ids) != n:
                raise ValueError(f"chunk {key.hex()} does not hold what its digest says")
            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), column(crcs, pa.int64())], ["key", "n", "crc"])


def _recipe_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, at, keys = [], [], []
        for start, blob, root in zip(*(batch.column(c).to_pylist() for c in ("start", "keys", "root"))):
            own = [blob[i : i + KEY] for i in range(0, len(blob), KEY)]
            if merkle(own) != root:
                raise ValueError(f"the recipe at {start} does not match its root")
            starts += [start] * len(own)
            at += range(len(own))
            keys += own
        yield pa.RecordBatch.from_arrays([column(starts, pa.int64()), column(at, pa.int32()), column(keys, pa.binary())], ["start", "at", "key"])


def _document_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [sorted((p["at"], p["n"], p["crc"]) for p in parts) for parts in batch.column("parts").to_pylist()]
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        n = np.array([p[1] for x in lists for p in x], np.int64)
        crc = np.array([p[2] for x in lists for p in x], np.uint64)
        total = np.bincount(owner, n, len(lists)).astype(np.int64)
        upto = np.cumsum(n) - np.repeat(np.cumsum(total) - total, [len(x) for x in lists])
        out = np.zeros(len(lists), np.uint64)
        np.bitwise_xor.at(out, owner, tokens.crc32_join(crc, 4 * (total[owner] - upto)))
        yield pa.RecordBatch.from_arrays([batch.column("start"), column(total, pa.int64()), column(out.astype(np.int64), pa.int64())], ["start", "n_tokens", "ids_crc32"])


def write_store(docs: DataFrame, folder: str, vocabulary: str | None = None) -> bytes:
    """Write the store under `folder`; its one root is returned."""
    spark = docs.sparkSession
    vocabulary = vocabulary or tokens.vocabulary_path()
    parts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(_parts(vocabulary), "encoders"), PART)
    schema = parts.schema
    with writing(spark):
        parts.repartition("route").sortWithinPartitions("key").mapInArrow(lean(_once, "encoders"), schema).drop("route").write.partitionBy("kind").parquet(f"{folder}/parts")
    found = spark.read.schema("doc_id long, key binary, n long, data binary, root binary, kind int").parquet(f"{folder}/parts")
    recipes = found.where("kind = 0").select("doc_id", "n", F.col("data").alias("keys"), "root")
    ordered = numbered(recipes, ["doc_id", "n", "root"], "n", "start").select("doc_id", "start", "n", "keys", "root")
    with writing(spark):
        ordered.repartitionByRange("start").sortWithinPartitions("start").write.parquet(f"{folder}/recipes")
        # Places come from written files, so the manifest describes files and not a plan.
        _manifest_of(spark, folder).write.parquet(f"{folder}/manifest")
    return store_root(spark, folder)


def _manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest that the recipe files as they are now should have."""
    stored = spark.read.schema(RECIPE).parquet(f"{folder}/recipes").select("doc_id", "start", "n", "root", F.col("_metadata.file_name").alias("file"))
    return stored.repartition("file").sortWithinPartitions("file", "start", "doc_id", "n", "root").mapInArrow(lean(_manifest_by_file, "encoders"), MANIFEST)


def _manifest_by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per recipe file, from rows in the order of file and start."""
    name, roots, first, last, rows = None, [], None, None, []

    def close() -> None:
        if roots:
            rows.append((name, first, last, len(roots), merkle(roots)))

    for batch in batches:
        for file, doc, start, n, root in zip(*(batch.column(c).to_pylist() for c in ("file", "doc_id", "start", "n", "root"))):
            if file != name:
                close()
                name, roots, first = file, [], start
            roots.append(digest(f"{doc} {start} {n} ".encode() + (root or b"")))
            last = start
    close()
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    yield pa.RecordBatch.from_arrays([column([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "first_start", "last_start", "documents", "root"])


def store_root(spark: SparkSession, folder: str) -> bytes:
    """Root over the manifest: one small row per recipe file."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("first_start", "file").collect()
    return merkle([digest(f"{r['file']} {r['first_start']} {r['last_start']} {r['documents']} ".encode() + bytes(r["root"])) for r in rows])


def verify_manifest(spark: SparkSession, folder: str, root: bytes | None = None) -> None:
    """Raise where recipe files differ from the manifest, or the manifest from the store's root."""
    if root is not None and store_root(spark, folder) != root:
        raise ValueError("the manifest does not match the store's root")
    names = ["first_start", "last_start", "documents", "root"]
    now = _manifest_of(spark, folder).select("file", F.struct(*names).alias("now"))
    then = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file", F.struct(*names).alias("then"))
    wrong = now.join(then, "file", "full_outer").where(~F.col("now").eqNullSafe(F.col("then"))).select("file").take(1)
    if wrong:
        raise ValueError(f"the recipe file {wrong[0]['file']} does not match the manifest")


def read_store(spark: SparkSession, folder: str, root: bytes | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from verified files. A chunk, recipe
    or recipe file that does not match its digest, or is missing, makes the read fail, as does a
    manifest other than that of the store's `root`, as write_store returned it."""
    recipes = spark.read.schema(RECIPE).parquet(f"{folder}/recipes")
    chunks = spark.read.schema("doc_id long, key binary, n long, data binary, root binary, kind int").parquet(f"{folder}/parts").where("kind = 1")
    sums = chunks.select("key", "n", "data").mapInArrow(lean(_chunk_sums, "encoders"), "key binary, n long, crc long")
    uses = recipes.select("start", "keys", "root").mapInArrow(lean(_recipe_keys, "encoders"), "start long, at int, key binary")
    joined = uses.join(sums, "key", "left")
    per_doc = joined.groupBy("start").agg(F.collect_list(F.struct("at", "n", "crc")).alias("parts"))
    totals = per_doc.mapInArrow(lean(_document_sums, "encoders"), "start long, n_tokens long, ids_crc32 long")
    out = recipes.select("doc_id", "start", "n").join(totals, "start")
    checked = F.when(F.col("n") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a recipe's length differs from its chunks'")).cast("long"))
    out = out.select("doc_id", "start", checked.alias("n_tokens"), "ids_crc32")
    try:
        verify_manifest(spark, folder, root)
    except AnalysisException:  # no manifest at all: damage to chunks and recipes is told first
        out.write.format("noop").mode("overwrite").save()
        raise
    return out


def read_ids(spark: SparkSession, folder: str, doc_ids: DataFrame) -> DataFrame:
    """doc_id, start and ids (array of int) of the documents named in `doc_ids`."""
    recipes = spark.read.schema(RECIPE).parquet(f"{folder}/recipes").join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    chunks = spark.read.parquet(f"{folder}/parts").where("kind = 1").select("key", "n", "data")
    uses = recipes.select("start", "keys", "root").mapInArrow(lean(_recipe_keys, "encoders"), "start long, at int, key binary")
    parts = uses.join(chunks, "key").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("at", "n", "data"))).alias("p"))

    def unpack(batches):
        for batch in batches:
            ids = [np.concatenate([_ids(x["data"], x["n"]) for x in p]).astype(np.int32) for p in batch.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("start"), pa.array(ids, pa.list_(pa.int32()))], ["start", "ids"])

    return recipes.select("doc_id", "start").join(parts.mapInArrow(lean(unpack, "encoders"), "start long, ids array<int>"), "start").select("doc_id", "start", "ids")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-store")
    root = write_store(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    return read_store(spark, folder, root)
