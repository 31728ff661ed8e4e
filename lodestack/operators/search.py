"""Search with all facets over summaries, its total and snapshot, and the page it shows."""

from __future__ import annotations

from lodestack.functions import dims
from lodestack.functions.text import ascii_lower, comparable, name_key, trimmed
from lodestack.operators import library
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_titles(assertions: DataFrame) -> DataFrame:
    """release_id and titles: of each qualifier the title that most sources' latest claims agree on,
    of equals the one observed first."""
    at = F.struct("k1", "k2", "k3", "source_id", "value")
    latest = assertions.groupBy("release_id", "qualifier", "source_id").agg(F.max_by("value", at).alias("value"), F.max(F.struct("k1", "k2", "k3")).alias("at"))
    votes = latest.groupBy("release_id", "qualifier", comparable(F.col("value")).alias("key")).agg(F.count("*").alias("n"), F.min(F.struct("at", "source_id", "value")).alias("first"))
    # The most votes, then the earliest first claim: least of (-n, first).
    best = votes.groupBy("release_id", "qualifier").agg(F.min(F.struct((-F.col("n")).alias("n"), "first")).alias("b"))
    return best.groupBy("release_id").agg(F.sort_array(F.collect_list(trimmed(F.col("b.first.value")))).alias("titles"))


def titles(assertions: DataFrame) -> DataFrame:
    """release_id and claims: every title claim of a release in the order observed."""
    row = F.struct("k1", "k2", "k3", "source_id", "value")
    return assertions.groupBy("release_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["value"]).alias("claims"))


def selected_types(selectors: list[str]) -> list[str] | None:
    """The types that selectors stand for: a type, a family, or any of them (None)."""
    if "any" in selectors:
        return None
    return sorted(t for t, f in dims.ASSET_TYPES if t in selectors or f in selectors)


def facets(sources: list[str] = (), asset_types: list[str] = (), statuses: list[str] = (), platforms: list[str] = (), regions: list[str] = (), text: str = "") -> Column:
    """The condition of a search on rows with title, titles, platform, region, sources, asset_types,
    status (of coverage) and needs_review. Any value of a facet, all facets; no value, no restriction."""
    keep = F.lit(True)
    if needle := text.strip().lower():
        keep &= F.contains(F.lower("title"), F.lit(needle)) | F.exists("titles", lambda t: F.contains(F.lower(t), F.lit(needle)))
    if platforms:
        keep &= name_key(F.col("platform")).isin(*["".join(c for c in p.lower() if c.isalnum()) for p in platforms])
    if regions:
        keep &= F.exists(F.split("region", ","), lambda r: ascii_lower(trimmed(r)).isin(*[x.strip().lower() for x in regions]))
    if sources:
        keep &= F.arrays_overlap("sources", F.array(*[F.lit(s) for s in sources]))
    if asset_types:
        types = selected_types(asset_types)
        keep &= F.size("asset_types") > 0 if types is None else F.arrays_overlap("asset_types", F.array(*[F.lit(t) for t in types]).cast("array<string>"))
    if statuses:
        known = {"complete": ~F.coalesce(F.col("status") == "none", F.lit(True)), "partial": F.coalesce(F.col("status") == "none", F.lit(False)), "needs_review": F.col("needs_review")}
        some = F.lit(False)
        for s in statuses:
            some |= known[s]
        keep &= some
    return keep


def described(releases: DataFrame, assets: DataFrame, assertions: DataFrame, status: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Summaries with all that facets ask about: status has id and status, reviewed has release_id."""
    rows = library.summaries(releases, assets, assertions).join(status.select("id", "status"), "id", "left")
    rows = rows.join(canonical_titles(assertions).withColumnRenamed("release_id", "id"), "id", "left")
    marks = reviewed.select(F.col("release_id").alias("id")).distinct().withColumn("needs_review", F.lit(True))
    return rows.join(marks, "id", "left").withColumns({"titles": F.coalesce("titles", F.array().cast("array<string>")), "needs_review": F.coalesce("needs_review", F.lit(False))})


def snapshot(releases: DataFrame) -> int:
    """The id up to which releases are there now; later ones are not part of a search that goes on."""
    return releases.agg(F.max("id")).first()[0] or 0


def result_page(found: DataFrame, as_of: int, size: int = 50, after_id: int | None = None) -> tuple[DataFrame, int]:
    """A page of `found` up to `as_of` and the number of all. A cursor that isn't there is an error."""
    found = found.where(F.col("id") <= as_of)
    total = found.count()
    after = None
    if after_id is not None:
        after = found.where(F.col("id") == after_id)
        if not after.take(1):
            raise LookupError(f"no release {after_id} to go on from")
    return library.page(found, size, after), total
