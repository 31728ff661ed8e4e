"""What several operators share: the shared folder, written tables, word handling."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Set while a table is written: its shuffle files go when it is there, as nothing reads them again;
#: and texts reach Python workers some thousands at a time, which bounds their memory.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, one of this machine's in
    local mode; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def writing(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: work before it is not run again
    when an executor is lost, and what follows sees the same rows each time."""
    path = new_path(df.sparkSession, name)
    with writing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Remove a table that `materialise` wrote, once nothing reads it again."""
    spark = written.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have (names are alike whatever their case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(df: DataFrame, names: list[str]) -> DataFrame:
    """`df` with its columns of these names called <name>_input, so that an operator can add its own."""
    for c in df.columns:
        if c.lower() in names:
            df = df.withColumnRenamed(c, fresh(df, c + "_input"))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(text: str | bytes | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""


def words(text: str | bytes | None) -> list[bytes]:
    """Runs of [^\\x20\\x09-\\x0D], A-Z lower-cased, as UTF-8; none for null."""
    return raw(text).lower().split()


def mix(h: np.ndarray) -> np.ndarray:
    """A finalising mix of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole sequence when it is shorter, none when empty."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    k = min(k, n)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i : n - k + 1 + i])
    return h


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, 1 << 18), base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = made
    return _powers[0], _powers[1]


def word_hashes(texts, lower: bool = True) -> list[np.ndarray]:
    """For each text (null: empty) the 64-bit hashes of its words, all texts at once."""
    own = [raw(t) for t in texts]
    data = b" ".join(own)
    a = np.frombuffer(data, np.uint8)
    if lower:
        a = _LOWER[a]
    blank = np.ones(len(a) + 2, bool)
    blank[1:-1] = _BLANK[a]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    power, inverse = _powers_of(len(a))
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_LETTER[a] * power[: len(a)], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)) if len(starts) else starts.astype(np.uint64)
    lengths = np.fromiter((len(t) + 1 for t in own), np.int64, len(own))
    return np.split(h, np.searchsorted(starts, np.cumsum(lengths)[:-1])) if own else []


def hashed_texts(batches, name: str = "text", most: int = 1 << 18, lower: bool = True):
    """Slices of the batches with the word hashes of their texts: about `most` bytes at a time."""
    for batch in batches:
        texts = batch.column(name).cast(pa.binary())
        held, at, size = [], 0, 0
        for n, text in enumerate(texts):
            held.append(t := text.as_py() or b"")
            size += len(t)
            if size >= most or n + 1 == len(texts):
                yield batch.slice(at, len(held)), word_hashes(held, lower)
                held, at, size = [], n + 1, 0


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def column(values, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind)


def numbered(df: DataFrame, order: list[str], weight: str, start: str, rows_a_part: int = 200_000) -> DataFrame:
    """Add `start`: the sum of `weight` over all rows before this one by `order` (nulls first). The
    rows are dealt into ranges of the whole order and of a number of their own, so that not even
    rows that agree in all of it have to meet in one task; ranges are summed while they are written
    and the sums of the few ranges are added up. `df` must be a written table."""
    from pyspark import TaskContext

    n = max(1, min(4096, df.count() // rows_a_part + 1))
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [*(F.col(c).asc_nulls_first() for c in order), F.col("_tie")]
    schema = rows.drop("_tie").schema.add("_part", "integer").add("_before", "long").add("_upto", "long")

    def sums(batches):
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            upto = total + np.cumsum(batch.column(weight).to_numpy().astype(np.int64))
            if len(upto):
                before, total = np.append(total, upto[:-1]), int(upto[-1])
            else:
                before = upto
            own = [batch.column(c) for c in schema.names[:-3]]
            yield pa.RecordBatch.from_arrays([*own, column(np.full(len(upto), part), pa.int32()), column(before, pa.int64()), column(upto, pa.int64())], schema.names)

    dealt = materialise(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(lean(sums, "*"), schema), "numbered")
    from pyspark.sql import Window

    small = dealt.groupBy("_part").agg(F.max("_upto").alias("_sum"))
    ahead = F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    small = small.select("_part", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    out = dealt.join(F.broadcast(small), "_part")  # a row per range: some 4,096 at most
    return out.withColumn(start, (F.col("_ahead") + F.col("_before")).cast("long")).drop("_part", "_before", "_upto", "_ahead")


def give_back(everything: bool) -> None:
    """Return free memory to the machine; `everything`: with what is kept between batches."""
    if everything:
        _powers.clear()
    pa.default_memory_pool().release_unused()
    if everything and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


#: What a worker keeps from task to task, by name, with what drops it.
KEPT: dict[str, Callable[[], None]] = {}


def drop_kept(but: str | None) -> None:
    for name, drop in KEPT.items():
        if but not in (name, "*"):
            drop()


def lean(run, keep: str | None = None):
    """`run` for a Python worker that gives memory back when its task is over: workers stay for further
    tasks, and allocators would keep what the largest batch took. Of what tasks before have left in the
    worker only `keep` stays, or all of it for "*"."""

    def kept_small(batches):
        drop_kept(keep)
        try:
            for out in run(batches):
                yield out
                give_back(False)
        finally:
            give_back(True)

    return kept_small


def units(batches, names: list[str], rows_at_once: int = 20_000, bytes_at_once: int = 4 << 20):
    """Tables of whole units (rows equal in the whole-number columns `names`, by which the input
    is sorted) and where each unit starts. At most one unit is held beyond `rows_at_once` rows or
    `bytes_at_once`."""
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def cut(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for n in names:
            v = t.column(n).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            size += batch.nbytes
        if rows > rows_at_once or size > bytes_at_once:
            t = pa.Table.from_batches(held).combine_chunks()
            at = cut(t)
            if at[-1]:
                yield t.slice(0, at[-1]), at[:-1]
                t = t.slice(at[-1])
                held, rows, size = t.to_batches(), t.num_rows, t.nbytes
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, cut(t)


def in_blocks(members: DataFrame, unit: list[str], counts: DataFrame, most: int) -> DataFrame:
    """Deal the rows of units into blocks of about `most` rows and each block into the pairs of
    blocks it belongs to: columns block, and bi <= bj. `counts` has the unit and its size m."""
    blocks = members.join(counts, unit).withColumn("parts", F.ceil(F.col("m") / most).cast("int")).drop("m")
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return blocks.withColumn("other", other).withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("parts", "other")
