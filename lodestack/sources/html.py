"""HTML pages as tables of links and listed files."""

from __future__ import annotations

from lodestack.functions.text import hrefs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos and href of every link, in document order."""
    return pages.select("page_id", F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))


def listed_files(pages: DataFrame, endings: list[str]) -> DataFrame:
    """Files of directory listings: no sort links, no parent directory, percent-encoding undone."""
    rows = links(pages).where(~F.col("href").rlike(r"^(\?|/|\.\./|#|[a-z]+:)") & ~F.col("href").endswith("/"))
    name = F.try_url_decode(F.replace("href", F.lit("+"), F.lit("%2B")))
    return rows.withColumn("name", name).where(F.lower("name").rlike(rf"\.({'|'.join(endings)})$")).select("page_id", "pos", "name")


def under_headings(cells: DataFrame) -> DataFrame:
    """cells: page_id, pos, heading (null for links), href. Every link with the last heading before it."""
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("belongs_to", F.last("heading", ignorenulls=True).over(w)).where("href is not null and belongs_to is not null")
