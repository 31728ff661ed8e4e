"""Resolution of records from several sources into releases: by dump sets, then by title."""

from __future__ import annotations

from lodestack.functions.text import digest, normalised
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dump_sets(dumps: DataFrame) -> DataFrame:
    """Per record its checksums in order, comma-joined; null unless every dump has a 40-digit one."""
    ok = F.coalesce(F.col("sha1").rlike("^[0-9A-Fa-f]{40}$"), F.lit(False))
    joined = F.array_join(F.array_sort(F.collect_set(F.lower("sha1"))), ",")
    return dumps.groupBy("record_id").agg(F.when(F.bool_and(ok), joined).alias("dump_set"))


def link(records: DataFrame, known: DataFrame) -> DataFrame:
    """records and known: record_id / release_id, source_id, title, platform, region, edition, dump_set.
    Dump evidence comes first and, where there is any, titles aren't asked. A release that already
    holds a record of the same source counts but can't be chosen. One release in all, and free:
    linked; no free one: unlinked; otherwise uncertain."""
    keys = [normalised(F.col(c)).alias(f"n_{c}") for c in ("platform", "region", "edition")]
    r = records.select("record_id", F.col("source_id").alias("own"), "dump_set", normalised(F.col("title")).alias("n_title"), *keys)
    k = known.select("release_id", "source_id", F.col("dump_set").alias("k_dump"), normalised(F.col("title")).alias("k_title"), *keys)
    on = ["n_platform", "n_region", "n_edition"]
    held = known.select(F.col("release_id"), F.col("source_id").alias("own")).distinct().withColumn("taken", F.lit(True))

    def found(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = a.join(b, [*on, "key"]).where("source_id <> own").select("record_id", "own", "release_id").distinct().join(held, ["release_id", "own"], "left")
        return pairs.groupBy("record_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("taken").isNull(), 1)).alias("free"), F.min(F.when(F.col("taken").isNull(), F.col("release_id"))).alias("release_id"))

    by_dump = found(r.where("dump_set is not null").withColumn("key", F.col("dump_set")), k.where("k_dump is not null").withColumn("key", F.col("k_dump")))
    rest = r.join(by_dump, "record_id", "left_anti")
    by_title = found(rest.withColumn("key", F.col("n_title")), k.withColumn("key", F.col("k_title")))
    every = by_dump.withColumn("evidence", F.lit("dumps")).unionByName(by_title.withColumn("evidence", F.lit("title")))
    outcome = F.when((F.col("n") == 1) & (F.col("free") == 1), "linked").when(F.col("free") > 0, "uncertain").otherwise("unlinked")
    out = records.select("record_id").join(every, "record_id", "left")
    return out.select("record_id", F.coalesce("evidence", F.lit("none")).alias("evidence"), F.when(F.col("n").isNull(), "unlinked").otherwise(outcome).alias("outcome"), F.when(outcome == "linked", F.col("release_id")).alias("release_id"))


def _same_place(location: Column) -> Column:
    """An absolute path without empty, `.` and `..` parts; other locations as they are."""
    parts = F.filter(F.split(location, "/"), lambda p: ~p.isin("", "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p != "..", F.concat(a, F.array(p))).otherwise(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))))
    return F.when(location.startswith("/"), F.concat(F.lit("/"), F.array_join(up, "/"))).otherwise(location)


def existing_imports(records: DataFrame, provenance: DataFrame, assets: DataFrame, editions: DataFrame) -> DataFrame:
    """The asset of lowest id that each record is an import of again: same source, type, object, size,
    title, platform, region and edition, the same place, and the game and the edition where the record
    names one. records: record_id, source_id, location, asset_type, object_hash, byte_len, title, platform,
    region, edition, game_id and release_id or null. provenance: asset_id, source_id, location. assets:
    asset_id, release_id and the object. What has to be equal goes through the joins as digests of 16 bytes,
    made before the rows are shuffled; what may be null is judged on the rows that are found."""
    place, thing = digest(F.col("source_id"), _same_place(F.col("location"))), digest(F.col("asset_type"), F.col("object_hash"), F.col("byte_len"))
    names = digest(*[normalised(F.col(c)) for c in ("title", "platform", "region", "edition")])
    whole = F.substring(F.unhex(F.sha2(F.concat("place", "thing", "names"), 256)), 1, 16)
    known = provenance.select("asset_id", place.alias("place")).join(assets.select("asset_id", F.col("release_id").alias("known_id"), thing.alias("thing")), "asset_id")
    known = known.join(editions.select(F.col("id").alias("known_id"), F.col("game_id").alias("known_game"), names.alias("names")), "known_id")
    known = known.select(whole.alias("key"), "asset_id", "known_id", "known_game")
    asked = records.select("record_id", "game_id", "release_id", place.alias("place"), thing.alias("thing"), names.alias("names")).select(whole.alias("key"), "record_id", "game_id", "release_id")
    fit = (F.col("game_id").isNull() | (F.col("game_id") == F.col("known_game"))) & (F.col("release_id").isNull() | (F.col("release_id") == F.col("known_id")))
    found = asked.join(known, "key").where(fit).groupBy("record_id").agg(F.min(F.struct("asset_id", "known_id", "known_game")).alias("k"))
    return found.select("record_id", "k.asset_id", F.col("k.known_id").alias("release_id"), F.col("k.known_game").alias("game_id"))
