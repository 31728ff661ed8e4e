"""Objects of a content-addressed store: listing, checks, and what their first bytes say."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from lodestack.functions.blake3 import blake3, digest
from pyarrow import fs as files
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """object_hash, length and content of files at aa/bb/<64 hex digits> whose address is their own."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    address = F.concat_ws("/", F.substring(name, 1, 2), F.substring(name, 3, 2), name)
    return files.where(name.rlike("^[0-9a-f]{64}$") & F.endswith(F.col("path"), address)).select(name.alias("object_hash"), "length", "content")


def checked(objects: DataFrame) -> DataFrame:
    """intact or corrupt, by the SHA-256 of the content."""
    return objects.select("object_hash", "length", F.when(F.sha2("content", 256) == F.col("object_hash"), "intact").otherwise("corrupt").alias("state"))


def _digest(kind: str, content: bytes) -> str:
    return digest([content])[0].hex() if kind == "blake3" else hashlib.sha256(content).hexdigest()


def examined(spark: SparkSession, folder: str, recorded: DataFrame, kind: str = "sha256") -> DataFrame:
    """The state of each object of `recorded` (object_hash, distinct) and of each file of the store: intact,
    missing, corrupt (its content has another address, by SHA-256 or BLAKE3) or unreadable. Files are
    listed first and read in the tasks, so one that can't be read fails alone."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    listed = listed.where(name.rlike("^[0-9a-f]{64}$")).select("path", name.alias("object_hash"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, own in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    store, at = files.FileSystem.from_uri(path)
                    with store.open_input_stream(at) as f:
                        found.append("intact" if _digest(kind, f.read()) == own else "corrupt")
                except OSError:
                    found.append("unreadable")
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.string())], ["object_hash", "state"])

    states = listed.mapInArrow(read, "object_hash string, state string")
    return recorded.select("object_hash").join(states, "object_hash", "full").select("object_hash", F.coalesce("state", F.lit("missing")).alias("state"))


#: Brands of pictures in the container that they share with videos (fixed values).
HEIC_BRANDS = ["heic", "heix", "heim", "heis", "hevc", "hevx", "hevm", "hevs"]
AVIF_BRANDS = ["avif", "avis"]
HEIF_BRANDS = ["mif1", "msf1"]
#: First bytes of kinds of files, in hex (fixed values).
MAGIC = {
    "255044462D": "application/pdf", "676C5446": "model/gltf-binary", "1A45DFA3": "video/webm", "89504E47": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif",
    "49492A00": "image/tiff", "4D4D002A": "image/tiff", "424D": "image/bmp", "0000000C4A584C20": "image/jxl", "FF0A": "image/jxl", "716F6966": "image/qoi",
    "6661726266656C64": "image/x-farbfeld", "762F3101": "image/x-exr", "00000100": "image/x-icon", "233F52414449414E4345": "image/vnd.radiance",
}
_BRAND_BYTES = 4096


def _brands(content: Column) -> Column:
    """The major brand of a container, then the compatible ones up to the end of their box."""
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("long")
    wide = number(1, 4) == 1
    start = F.when(wide, 16).otherwise(8)
    end = F.least(F.when(wide, number(9, 8)).otherwise(number(1, 4)), F.octet_length(content), F.lit(_BRAND_BYTES))
    count = F.floor((end - start - 8) / 4).cast("int")
    at = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: start + 8 + 4 * i)).otherwise(F.array().cast("array<int>"))
    text = lambda i: F.hex(F.substring(content, i + 1, F.lit(4)))
    return F.concat(F.array(text(start)), F.transform(at, text))


def media_type(content: Column) -> Column:
    """The media type that the first bytes declare; null when unknown. A container is a video unless one
    of its brands is a picture's; of a picture the first brand that is not general decides."""
    head = F.hex(F.substring(content, 1, 16))
    coded = lambda names: F.array(*[F.lit(n.encode().hex().upper()) for n in names])
    brands = _brands(content)
    special = F.get(F.filter(brands, lambda x: F.array_contains(coded(HEIC_BRANDS + AVIF_BRANDS), x)), 0)
    boxed = (
        F.when(F.array_contains(coded(AVIF_BRANDS), special), "image/avif").when(special.isNotNull(), "image/heic")
        .when(F.arrays_overlap(brands, coded(HEIF_BRANDS)), "image/heif").when(brands[0] == b"qt  ".hex().upper(), "video/quicktime").otherwise("video/mp4")
    )
    found = F.when(F.substring(head, 9, 8) == "66747970", boxed).when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    for magic, kind in MAGIC.items():
        found = found.when(head.startswith(magic), kind)
    return found.when(head.rlike("^503[1-6](20|09|0A|0C|0D|23)"), "image/x-portable-anymap")


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height of a PNG, from its first chunk."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return number(17), number(21)


def local_imports(spark: SparkSession, paths: DataFrame, folder: str, kind: str = "sha256") -> DataFrame:
    """Local files as originals: paths (path, and whatever else the asset has) with original_filename,
    source_location (the absolute path), object_hash, byte_len and media_type. Only files count: a folder, or
    a path without a file, is an error. `folder` is the one all paths are in."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    place = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/+", "/"), "/(\\./)*/*", "/")
    address = blake3("content") if kind == "blake3" else F.sha2("content", 256)
    read = found.select(place(F.col("path")).alias("source_location"), address.alias("object_hash"), F.col("length").alias("byte_len"), media_type(F.col("content")).alias("media_type"))
    rows = paths.withColumn("source_location", place(F.col("path"))).join(read, "source_location", "left")
    missing = F.raise_error(F.concat(F.lit("no file to import at "), F.col("path"))).cast("string")
    name = F.element_at(F.split("source_location", "/"), -1)
    return rows.withColumns({"object_hash": F.coalesce("object_hash", missing), "original_filename": name})
