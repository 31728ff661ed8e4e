"""Discovery of games by several sources, a slice of the games at a time, as a streaming data source.

An offset says for each source how many games it has looked up. The record of that, a small file per
source, is advanced only from the game a slice starts at, so a slice counts once whoever runs it and
however often; each micro-batch takes the next slice behind the record."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "source_id string, first_game long, position long, title string, platform string"


def batch_size(lookups: int, per_game: int = 1) -> int:
    """Games of a slice: so many lookups are made at once, and a game named without its platform takes one
    on each platform."""
    return max(lookups // max(per_game, 1), 1)


class Record:
    """How many games each source has looked up, a file each in one folder of any file system."""

    def __init__(self, folder: str):
        self.store, self.root = files.FileSystem.from_uri(folder)

    def _path(self, source: str) -> str:
        return f"{self.root.rstrip('/')}/{source}.json"

    def games(self, source: str) -> int:
        if self.store.get_file_info(self._path(source)).type != files.FileType.File:
            return 0
        with self.store.open_input_stream(self._path(source)) as f:
            return json.loads(f.read())["games"]

    def advance(self, source: str, first: int, upto: int) -> bool:
        """Whether the record stood at `first`, and now stands at `upto`."""
        if self.games(source) != first or upto <= first:
            return False
        self.store.create_dir(self.root, recursive=True)
        part = self._path(source) + uuid.uuid4().hex
        with self.store.open_output_stream(part) as f:
            f.write(json.dumps({"games": upto}).encode())
        self.store.move(part, self._path(source))
        return True


class Slice(InputPartition):
    def __init__(self, source: str, first: int, upto: int):
        self.source, self.first, self.upto = source, first, upto


def _rows(path: str, first: int, upto: int) -> Iterator[pa.RecordBatch]:
    """The games at these places of a Parquet file or a folder of them, groups of rows before them unread."""
    store, root = files.FileSystem.from_uri(path)
    own = store.get_file_info(root)
    parts = [root] if own.type == files.FileType.File else sorted(f.path for f in store.get_file_info(files.FileSelector(root)) if f.path.endswith(".parquet"))
    at = 0
    for part in parts:
        with pq.ParquetFile(store.open_input_file(part)) as f:
            for group in range(f.num_row_groups):
                n = f.metadata.row_group(group).num_rows
                if at < upto and at + n > first:
                    t = f.read_row_group(group, ["title", "platform"])
                    a, b = max(first - at, 0), min(upto - at, n)
                    for batch in t.slice(a, b - a).to_batches():
                        yield batch
                at += n


def _count(path: str) -> int:
    store, root = files.FileSystem.from_uri(path)
    own = store.get_file_info(root)
    parts = [root] if own.type == files.FileType.File else [f.path for f in store.get_file_info(files.FileSelector(root)) if f.path.endswith(".parquet")]
    return sum(pq.ParquetFile(store.open_input_file(p)).metadata.num_rows for p in parts)


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.games, self.record, self.sizes = options["games"], options["record"], json.loads(options["sizes"])
        self.count = _count(self.games)

    def initialOffset(self) -> dict:
        return {source: 0 for source in self.sizes}

    def latestOffset(self) -> dict:
        record = Record(self.record)
        return {source: min(record.games(source) + size, self.count) for source, size in self.sizes.items()}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return [Slice(s, start.get(s, 0), n) for s, n in end.items() if n > start.get(s, 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        at = partition.first
        for batch in _rows(self.games, partition.first, partition.upto):
            for title, platform in zip(*(c.to_pylist() for c in batch.columns)):
                yield partition.source, partition.first, at, title, platform
                at += 1

    def commit(self, end: dict) -> None:
        pass  # the record is advanced with the work, see `recording`


class Discovery(DataSource):
    """Options: games (a Parquet table with title and platform, in their order), record (a folder) and sizes
    (JSON: for each source the games of a slice)."""

    @classmethod
    def name(cls) -> str:
        return "discovery"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options)


def slices(spark: SparkSession, games: str, record: str, sizes: dict[str, int]) -> DataFrame:
    """The stream of slices: source_id, first_game of the slice, position, title, platform."""
    spark.dataSource.register(Discovery)
    return spark.readStream.format("discovery").options(games=games, record=record, sizes=json.dumps(sizes)).load()


def recording(record: str, work: Callable[[DataFrame, int], None]):
    """A function for foreachBatch: `work` gets the rows of the slices that the record does not have yet,
    and then the record is advanced. `work` has to replace what it wrote for the same batch."""
    book = Record(record)

    def run(rows: DataFrame, batch: int) -> None:
        found = rows.groupBy("source_id", "first_game").count().collect()  # a row per source
        new = [r for r in found if book.games(r["source_id"]) == r["first_game"]]
        if new:
            work(rows.where(rows["source_id"].isin([r["source_id"] for r in new])), batch)
        for r in new:
            book.advance(r["source_id"], r["first_game"], r["first_game"] + r["count"])

    return run
