"""Catalog datafiles: XML release lists and block-structured game lists."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from lodestack.functions import dims
from lodestack.functions.text import platform_name, software_name, source_record, trimmed
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Explicit, as inference reads all-digit checksums as numbers and a single dump as a struct.
GAME = "_name string, description string, rom array<struct<_name: string, _size: string, _crc: string, _md5: string, _sha1: string>>"
HEADER = "name string, description string, version string"
SOFTWARE = (
    "_name string, _cloneof string, description string, year string, publisher string, info array<struct<_name: string, _value: string>>, "
    "part array<struct<_name: string, dataarea: array<struct<_name: string, rom: array<struct<_name: string, _crc: string, _sha1: string>>>>>>"
)
#: The kinds of information kept of software entries (fixed values).
KEPT_INFO = ["alt_title", "barcode", "developer", "distributor", "release", "serial", "version"]


def _blank_to_null(c):
    return F.nullif(trimmed(c), F.lit(""))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """file of each XML file; an error at one that does not end with the end of its root element, as the
    rows of a file cut off would look like those of a whole one."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    bare = trimmed(F.regexp_replace("value", r"(?s)<!--.*?-->", ""))
    root = F.regexp_extract(bare, r"<([A-Za-z_][\w:.-]*)", 1)
    whole = (root != "") & (F.endswith(bare, F.concat(F.lit("</"), root, F.lit(">"))) | bare.rlike(r"^(<\?[^>]*\?>|<![^>]*>|\s)*<[^<>]*/>$"))
    return files.select(F.when(whole, F.col("file")).otherwise(F.raise_error(F.concat(F.lit("the datafile "), F.col("file"), F.lit(" ends before its end")))).alias("file"))


def releases(spark: SparkSession, path: str, max_games: int | None = None) -> DataFrame:
    """name, description, platform, version and dumps of every named game of XML datafiles, or of some
    `max_games` of them; file is the file's name, as each has its own header. A file cut off is an error."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("file", F.col("_metadata.file_name"))
    head = read("header", HEADER).select("file", platform_name(F.col("name")).alias("platform"), "version")
    games = read("game", GAME).select("file", _blank_to_null(F.col("_name")).alias("name"), "description", F.coalesce("rom", F.array()).alias("dumps"))
    named = games.where("name is not null").join(head, "file", "left").join(whole_files(spark, path), "file")
    return named if max_games is None else named.limit(max_games)


def skipped(spark: SparkSession, path: str) -> DataFrame:
    """Per file the number of games without a name."""
    games = spark.read.format("xml").option("rowTag", "game").schema(GAME).load(path).withColumn("file", F.col("_metadata.file_name"))
    return games.groupBy("file").agg(F.count(F.when(_blank_to_null(F.col("_name")).isNull(), 1)).alias("skipped"))


def identifiers(games: DataFrame) -> DataFrame:
    """One row per dump and checksum; dumps without a name say nothing."""
    dumps = games.select("file", "name", F.explode("dumps").alias("d")).where("trim(d._name) <> ''")
    values = F.inline(F.array(*[F.struct(F.lit(k).alias("qualifier"), F.lower(f"d._{k}").alias("value")) for k in ("crc", "md5", "sha1")]))
    return dumps.select("file", "name", values).where("value is not null")


def assertions(games: DataFrame, source_id: str) -> DataFrame:
    """Claims in long form: title, platform, version, and every identifier."""
    claim = lambda field, c: F.struct(F.lit(field).alias("field"), F.lit(None).cast("string").alias("qualifier"), c.alias("value"))
    own = games.select("file", "name", F.inline(F.array(claim("title", F.col("name")), claim("platform", F.col("platform")), claim("dat_version", F.col("version")))))
    ids = identifiers(games).select("file", "name", F.lit("identifier").alias("field"), "qualifier", "value")
    return own.where("value is not null").unionByName(ids).withColumn("source_id", F.lit(source_id))


def software(spark: SparkSession, path: str) -> DataFrame:
    """Entries of XML software lists that have a short name and a description."""
    rows = spark.read.format("xml").option("rowTag", "software").schema(SOFTWARE).load(path)
    kept = F.filter(F.coalesce("info", F.array()), lambda x: x["_name"].isin(*KEPT_INFO) & (F.trim(x["_value"]) != ""))
    roms = F.flatten(F.flatten(F.transform(F.coalesce("part", F.array()), lambda p: F.transform(F.coalesce(p["dataarea"], F.array()), lambda d: F.coalesce(d["rom"], F.array())))))
    named = rows.select(_blank_to_null(F.col("_name")).alias("name"), _blank_to_null(F.col("description")).alias("title"), F.col("_cloneof").alias("clone_of"), "year", "publisher", kept.alias("info"), F.filter(roms, lambda r: F.trim(r["_name"]) != "").alias("dumps"))
    return named.where("name is not null and title is not null")


def software_releases(spark: SparkSession, path: str) -> DataFrame:
    """Releases of software lists: platform (of the list's name, else its description, else its name),
    title, region, revision, edition, and identifiers as (qualifier, value) in their order. Entries without
    a short name or a description are left out."""
    head = spark.read.format("xml").option("rowTag", "softwarelist").schema("_name string, _description string").load(path)
    head = head.select(F.col("_metadata.file_name").alias("file"), F.coalesce("_name", F.lit("")).alias("list"), _blank_to_null(F.col("_description")).alias("about"))
    rows = spark.read.format("xml").option("rowTag", "software").schema(SOFTWARE).load(path).withColumn("file", F.col("_metadata.file_name"))
    rows = rows.select("file", _blank_to_null(F.col("_name")).alias("software"), _blank_to_null(F.col("description")).alias("description"), F.col("_cloneof").alias("clone_of"), "year", "publisher")
    rows = rows.where("software is not null and description is not null").join(head, "file").withColumn("n", software_name(F.col("description")))
    named = {"source_record": source_record(F.col("list"), F.col("software")), "software_list": F.col("list"), "software": F.col("software"), "clone_of": F.col("clone_of"), "year": F.col("year"), "publisher": F.col("publisher")}
    ids = F.filter(F.array(*[F.struct(F.lit(k).alias("qualifier"), _blank_to_null(v).alias("value")) for k, v in named.items()]), lambda x: x["value"].isNotNull())
    platform = F.coalesce(dims.lookup(dims.SOFTWARE_LISTS, F.col("list")), "about", "list")
    return rows.select("file", platform.alias("platform"), "n.title", "n.region", "n.revision", "n.edition", ids.alias("identifiers"))


#: A parenthesis, a quoted text, the start of one that never ends, or a word.
_TOKEN = re.compile(r'([()])|"([^"]*)"|(")|([^\s()"]+)')


def blocks(text: str | None) -> Iterator[tuple]:
    """Entries of a game list, `word ( key value key ( ... ) )`, as (entry, kind, key, value, dump); dump
    numbers the rom blocks of an entry. Errors are a quoted text, a block or an entry that doesn't end, an
    entry without a kind or without fields, a field without a value, and a block without a name."""
    entry, dump, kind = -1, -1, None
    depth, pending, names = 0, None, []  # of the block being read: the key that waits for its value; names of those around
    for bracket, quoted, cut, plain in _TOKEN.findall(text or ""):
        if cut:
            raise ValueError("ends inside a quoted text")
        word = None if bracket else plain or quoted
        if depth == 0:
            if kind is None:
                if word is None:
                    raise ValueError("has an entry without a kind")
                kind = word
            elif bracket != "(":
                raise ValueError(f"has a {kind} entry without its fields")
            else:
                entry, dump, depth = entry + 1, -1, 1
        elif word is not None and pending is None:
            pending = word
        elif word is not None:
            yield entry, kind, pending, word, dump if names else -1
            pending = None
        elif bracket == "(":
            if pending is None:
                raise ValueError("has a block without a name")
            dump += pending == "rom" and depth == 1
            names.append(pending)
            depth, pending = depth + 1, None
        else:
            if pending is not None:
                raise ValueError(f"has a field {pending} without a value")
            depth -= 1
            if depth:
                names.pop()
            else:
                kind = None
    if pending is not None:
        raise ValueError(f"has a field {pending} without a value")
    if depth:
        raise ValueError("ends inside a block")
    if kind is not None:
        raise ValueError(f"has a {kind} entry without its fields")


def _named(file: str, text: str | None) -> Iterator[tuple]:
    try:
        yield from blocks(text)
    except ValueError as wrong:
        raise ValueError(f"the game list {file} {wrong}") from None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]
    for batch in batches:
        rows = [(file, *r) for file, text in zip(*(c.to_pylist() for c in batch.columns)) for r in _named(file, text)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["file", "entry", "kind", "key", "value", "dump"])


def game_list(spark: SparkSession, path: str) -> DataFrame:
    """name and dumps (array of checksums) of the games of block-structured lists, entries of one
    name merged in the order they appear; nameless entries are left out."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    rows = files.mapInArrow(_rows, "file string, entry int, kind string, key string, value string, dump int").where("kind = 'game'")
    names = rows.where("key = 'name' and dump = -1").groupBy("file", "entry").agg(F.min("value").alias("name")).where("trim(name) <> ''")
    dumps = rows.where("dump >= 0 and key = 'sha1'").groupBy("file", "entry", "dump").agg(F.min(F.lower("value")).alias("sha1"))
    joined = names.join(dumps, ["file", "entry"], "left").groupBy("file", "name").agg(F.array_sort(F.collect_list(F.when(F.col("sha1").isNotNull(), F.struct("entry", "dump", "sha1")))).alias("d"))
    return joined.select("file", "name", F.transform("d", lambda x: x["sha1"]).alias("dumps"))


def submodules(spark: SparkSession, path: str) -> DataFrame:
    """Sections of an INI file of submodules: path, url and branch (master where none is named)."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_name")).withColumn("pos", F.monotonically_increasing_id())
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("value").rlike(r"^\s*\["), F.col("pos")), ignorenulls=True).over(w)
    pairs = lines.withColumn("section", section).select("file", "section", F.regexp_extract("value", r"^\s*(\w+)\s*=\s*(.*?)\s*$", 1).alias("k"), F.regexp_extract("value", r"^\s*(\w+)\s*=\s*(.*?)\s*$", 2).alias("v"))
    one = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    return pairs.where("section is not null and k <> ''").groupBy("file", "section").agg(one("path").alias("path"), one("url").alias("url"), F.coalesce(one("branch"), F.lit("master")).alias("branch")).drop("section")
