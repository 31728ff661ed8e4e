"""Saved answers of listings that go on from page to page, as a batch data source.

A listing is a folder of JSON files: first.json, and for each cursor that an answer names the file
<cursor>.json. A reader follows the cursors of one listing; listings are read side by side."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_PAGES = 20


class Listing(InputPartition):
    def __init__(self, name: str):
        self.name = name


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.most = options["path"], int(options.get("pages", MAX_PAGES))

    def partitions(self) -> list[Listing]:
        store, root = files.FileSystem.from_uri(self.folder)
        return [Listing(f.base_name) for f in sorted(store.get_file_info(files.FileSelector(root)), key=lambda f: f.path) if f.type == files.FileType.Directory]

    def read(self, partition: Listing) -> Iterator[tuple]:
        store, root = files.FileSystem.from_uri(self.folder)
        cursor, seen, place = "first", set(), 0
        while cursor:
            if cursor in seen:
                raise ValueError(f"the listing {partition.name} comes back to its page {cursor}")
            if len(seen) == self.most:
                raise ValueError(f"the listing {partition.name} runs past {self.most} pages")
            seen.add(cursor)
            try:
                with store.open_input_stream(f"{root.rstrip('/')}/{partition.name}/{cursor}.json") as f:
                    page = json.loads(f.read())
            except FileNotFoundError:
                raise ValueError(f"the listing {partition.name} has no page {cursor}") from None
            if not isinstance(page, dict) or not isinstance(page.get("items"), list):
                raise ValueError(f"the listing {partition.name} answered the page {cursor} without its items")
            for item in page["items"]:
                yield partition.name, len(seen), place, json.dumps(item)
                place += 1
            after = page.get("cursor")
            cursor = after if isinstance(after, str) else None


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_answers"

    def schema(self) -> str:
        return "listing string, page int, place long, item string"

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)


def paged(spark: SparkSession, folder: str, pages: int = MAX_PAGES) -> DataFrame:
    """listing, page, place in the listing and item (JSON) of every item of the listings under `folder`. A
    missing page, a page without items, cursors in a ring and more than `pages` pages are errors."""
    spark.dataSource.register(Pages)
    return spark.read.format("paged_answers").options(path=folder, pages=str(pages)).load()


def manuals(answers: DataFrame) -> DataFrame:
    """listing, place, identifier, title, platform and region of each item that lists a manual."""
    from lodestack.sources.answers import listed_manual, manual_region

    title = F.coalesce(F.get_json_object("item", "$.title[0]"), F.get_json_object("item", "$.title"))
    rows = answers.select("listing", "place", F.get_json_object("item", "$.identifier").alias("identifier"), listed_manual(title).alias("m"))
    return rows.where("identifier is not null and m is not null").select("listing", "place", "identifier", "m.title", "m.platform", manual_region(F.col("m.tags")).alias("region"))
