"""Writing: content-addressed objects, export trees and JSON documents."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from lodestack.functions.blake3 import digest
from pyarrow import fs as files
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _place(store: files.FileSystem, path: str, content: bytes) -> bool:
    """Writes a whole file under its final name; False where it is there already with this content. A task
    that is run again, or twice at once, writes beside the final name and moves the same bytes there."""
    there = store.get_file_info(path)
    if there.type == files.FileType.File and there.size == len(content):
        with store.open_input_stream(path) as f:
            if f.read() == content:
                return False
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(content)
    store.move(part, path)
    return True


def _writer(folder: str, kind: str | None):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = files.FileSystem.from_uri(folder)
        for batch in batches:
            names, contents = (c.to_pylist() for c in batch.columns)
            if kind:
                hashes = [d.hex() for d in digest(contents)] if kind == "blake3" else [hashlib.sha256(c).hexdigest() for c in contents]
                names = [f"{h[:2]}/{h[2:4]}/{h}" for h in hashes]
            fresh = [_place(store, f"{root.rstrip('/')}/{n}", c) for n, c in zip(names, contents)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(map(len, contents), pa.int64()), pa.array(fresh, pa.bool_())], ["path", "length", "written"])

    return write


def store_objects(contents: DataFrame, folder: str, kind: str = "sha256") -> DataFrame:
    """Writes each distinct `content` once at aa/bb/<SHA-256, or BLAKE3> under `folder`, an address that all
    executors reach; a damaged file there is replaced. object_hash, path, length and whether it was written now, of every object; null contents
    are none. An action on the result does the writing, and may be repeated. Equal contents meet by their
    hash, not by their bytes."""
    rows = contents.where("content is not null").select(F.sha2("content", 256).alias("h"), "content")
    once = rows.groupBy("h").agg(F.first("content").alias("content"))
    done = once.select("h", "content").mapInArrow(_writer(folder, kind), "path string, length long, written boolean")
    return done.select(F.element_at(F.split("path", "/"), -1).alias("object_hash"), "path", "length", "written")


def export_tree(exports: DataFrame, objects: DataFrame, folder: str) -> DataFrame:
    """Writes the object of every row of `exports` (path, object_hash) to its path under `folder`: path,
    length and whether it was written; files of the same content stay as they are. Paths must be distinct
    and relative, without steps upwards. Rows whose object is missing are in no result: take them by
    an anti join."""
    safe = F.when(F.col("path").rlike(r"^/|(^|/)\.\.(/|$)"), F.raise_error(F.concat(F.lit("a path outside the tree: "), F.col("path")))).otherwise(F.col("path"))
    rows = exports.select(safe.alias("path"), "object_hash").join(objects.select("object_hash", "content"), "object_hash")
    return rows.select("path", "content").mapInArrow(_writer(folder, None), "path string, length long, written boolean")


def as_documents(rows: DataFrame) -> DataFrame:
    """Every row as a JSON document in `value`, fields that are null included."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
