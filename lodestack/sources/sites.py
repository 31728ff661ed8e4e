"""Pages of sites with tables of games: their cells and links in document order, then as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from lodestack.functions import text
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ELEMENT = "page_id long, pos int, tag string, row int, class string, span string, href string, text string, nests boolean"
#: Endings of maps (fixed values).
MAP_ENDINGS = ["png", "gif", "jpg", "jpeg", "pdf"]
#: Sides and editions in the names of high-resolution scans (fixed values).
SIDES = {"F": ("box_front", "front"), "B": ("box_back", "back"), "D": ("disc", "disc")}
EDITIONS = {"ALL": "Unspecified", "GH": "Greatest Hits", "P": "Platinum"}


class _Elements(HTMLParser):
    """Cells, links and images of one page; a cell or link that is never closed ends with its row or table."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[dict] = []
        self.rows = [-1]
        self.count = -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        got = dict(attrs)
        if tag == "table":
            for e in self.open:
                e["nests"] |= e["tag"] == "td"
            self.rows.append(-1)
        elif tag == "tr":
            self._close(len(self.rows), ("td", "a"))
            self.count += 1
            self.rows[-1] = self.count
        elif tag in ("td", "a", "img"):
            if tag != "img":
                self._close(len(self.rows), (tag, "a"))
            one = {"tag": tag, "row": self.rows[-1], "class": got.get("class"), "span": got.get("colspan"), "href": got.get("src" if tag == "img" else "href"), "text": [], "nests": False, "depth": len(self.rows)}
            self.found.append(one)
            if tag != "img":
                self.open.append(one)

    def handle_endtag(self, tag: str) -> None:
        if tag == "table":
            self._close(len(self.rows), ("td", "a"))
            if len(self.rows) > 1:
                self.rows.pop()
        elif tag in ("tr", "td"):
            self._close(len(self.rows), ("td", "a"))
        elif tag == "a":
            self._close(len(self.rows), ("a",))

    def handle_data(self, data: str) -> None:
        for e in self.open:
            e["text"].append(data)

    def _close(self, depth: int, tags: tuple) -> None:
        self.open = [e for e in self.open if e["depth"] < depth or e["tag"] not in tags]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["tag", "row", "class", "span", "href", "text", "nests"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
    for batch in batches:
        for page_id, html in zip(*(c.to_pylist() for c in batch.columns)):
            parser = _Elements()
            parser.feed(html or "")
            parser.close()
            rows = [e | {"text": "".join(e["text"])} for e in parser.found]
            columns = [pa.array([page_id] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32())]
            columns += [pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "pos", *names])


def elements(pages: DataFrame) -> DataFrame:
    """The cells (td), links (a) and images (img, with their address in href) of pages (page_id, html):
    pos in the document, the row they are in, their text with white space collapsed, and whether a cell
    holds a table. A page that is null has none."""
    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(_read, ELEMENT).withColumn("text", text.cell_text(F.col("text")))


def _name(path: Column) -> Column:
    return F.nullif(F.element_at(F.split(F.regexp_replace(path, "[?#].*$", ""), "/"), -1), F.lit(""))


def atlas_maps(found: DataFrame) -> DataFrame:
    """page_id, pos, title, href, filename and label of the maps on atlas pages: a cell over four columns
    whose text ends in " Maps" names the game of all maps that follow; a map is a link to a file of
    the site itself, labelled with its row's first cell, the area, and its own text."""
    title = F.when((F.col("tag") == "td") & (F.trim("span") == "4") & ~F.col("nests") & F.col("text").endswith(" Maps"), text.trimmed(F.regexp_replace("text", " Maps$", "")))
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # a page is one document, so a window over it is bounded
    rows = found.where("tag in ('td', 'a')").withColumn("title", F.last(title, ignorenulls=True).over(w))
    area = F.min_by(F.when(F.col("tag") == "td", F.col("text")), F.when(F.col("tag") == "td", F.col("pos"))).over(Window.partitionBy("page_id", "row"))
    href = F.trim("href")
    local = ~href.contains(":") & ~href.startswith("/") & F.lower(href).rlike(rf"\.({'|'.join(MAP_ENDINGS)})$")
    maps = rows.withColumn("area", F.when(F.col("row") >= 0, area)).where((F.col("tag") == "a") & F.col("title").isNotNull() & local)
    label = F.when((F.col("area") != "") & (F.col("area") != F.col("text")), F.concat_ws(" · ", "area", "text")).otherwise(F.col("text"))
    front = F.regexp_replace("title", "^(.*), (The|A|An)$", "$2 $1")
    return maps.select("page_id", "pos", front.alias("title"), href.alias("href"), _name(href).alias("filename"), label.alias("label")).where("filename is not null")


def sole_rows(found: DataFrame) -> DataFrame:
    """page_id, key, title and href of the rows of release lists whose title no other row of the list
    has: the link is in the cell of class col1, the title in that of class col3."""
    of = lambda name: F.array_contains(F.split(F.coalesce("class", F.lit("")), r"\s+"), name)
    cells = found.where("row >= 0")
    first = F.min(F.when((F.col("tag") == "td") & of("col1"), F.col("pos")))
    third = F.min_by(F.when((F.col("tag") == "td") & of("col3"), F.col("text")), F.when((F.col("tag") == "td") & of("col3"), F.col("pos")))
    links = F.array_sort(F.collect_list(F.when((F.col("tag") == "a") & F.col("href").isNotNull(), F.struct("pos", "href"))))
    rows = cells.groupBy("page_id", "row").agg(first.alias("first"), third.alias("listed"), links.alias("links"))
    rows = rows.select("page_id", text.listed_title(F.col("listed")).alias("title"), F.get(F.filter("links", lambda x: x["pos"] > F.col("first")), 0)["href"].alias("href")).where("href is not null and title is not null")
    return rows.groupBy("page_id", text.name_key(F.col("title")).alias("key")).agg(F.count("*").alias("n"), F.min("title").alias("title"), F.min("href").alias("href")).where("n = 1").drop("n")


def scans_and_screens(found: DataFrame, letter: str) -> DataFrame:
    """page_id, candidate_id, asset_type, label, edition and path of a game page's scans and screenshots
    in the folders of one region; scans of editions of other names are left out. Paths are those on
    the site: relative addresses must have been made absolute paths."""
    scan = rf"^/images/hires/{letter}/((?:.*/)?[^/-]*-[^/-]*-([FBD])-(ALL|GH|P))\.html$"
    id_, side, edition = (F.regexp_extract("href", scan, n) for n in (1, 2, 3))
    table = lambda d, c: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])[c]
    label = table({k: v[1] for k, v in SIDES.items()}, side)
    scans = found.where((F.col("tag") == "a") & F.col("href").rlike(scan)).select(
        "page_id", F.concat(F.lit(f"{letter}/"), id_).alias("candidate_id"), table({k: v[0] for k, v in SIDES.items()}, side).alias("asset_type"),
        F.when(edition == "ALL", label).otherwise(F.concat_ws(": ", label, edition)).alias("label"), table(EDITIONS, edition).alias("edition"), F.concat(F.lit(f"/images/hires/{letter}/"), id_, F.lit(".jpg")).alias("path"),
    )
    shot = rf"^/images/(screens/{letter}/.*)\.jpg$"
    shots = found.where((F.col("tag") == "img") & F.col("href").rlike(shot)).select("page_id", F.regexp_extract("href", shot, 1).alias("candidate_id"), F.lit("screenshot").alias("asset_type"), F.lit("screenshot").alias("label"), F.lit("Unspecified").alias("edition"), F.col("href").alias("path"))
    return scans.unionByName(shots).distinct()
