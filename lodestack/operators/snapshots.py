"""Changes to the catalog as functions from old tables and what is new to new tables, each to be
written as the next snapshot. A row's `seq` is its place in the order of observation."""

from __future__ import annotations

from lodestack.operators.rounds import fixed_point
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLAIM = ["release_id", "source_id", "location", "field", "qualifier", "value"]


def observed(claims: DataFrame, seen: DataFrame) -> DataFrame:
    """Claims after an import: one that is seen again moves to the end of the order, new ones join it
    there; of repeated claims the latest counts. Both have CLAIM and seq; seq of `seen` is its own."""
    top = claims.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top"))  # one row
    later = seen.crossJoin(F.broadcast(top)).withColumn("seq", F.col("seq") + F.col("top") + 1).drop("top")
    return claims.unionByName(later).groupBy(*CLAIM).agg(F.max("seq").alias("seq"))


def retained(assets: DataFrame, provenance: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """assets: release_id, asset_type, object_hash, seq. provenance: the same key, source_id, location,
    details. An asset that is there stays; its provenance is added or keeps the details it had where the
    new ones are null. `new` has the columns of both."""
    key, where = ["release_id", "asset_type", "object_hash"], ["source_id", "location"]
    all_assets = assets.unionByName(new.select(*key, "seq")).groupBy(*key).agg(F.min("seq").alias("seq"))
    rows = provenance.withColumn("at", F.lit(0).cast("long")).unionByName(new.select(*key, *where, "details", (F.col("seq") + 1).cast("long").alias("at")))
    last = F.max_by("details", F.when(F.col("details").isNotNull(), F.col("at")))
    return all_assets, rows.groupBy(*key, *where).agg(last.alias("details"))


def merge_outcomes(merges: DataFrame, claims: DataFrame, assets: DataFrame) -> DataFrame:
    """merges: from_id, into_id, seq. Adds outcome, on the catalog as it is: not_a_candidate when a source
    has a record on both editions, which are then two releases; edition_holds_assets; else decided."""
    held = claims.where("field = 'identifier' and qualifier = 'source_record'").select("release_id", "source_id").distinct()
    ours, theirs = (held.select(F.col("release_id").alias(n), "source_id") for n in ("from_id", "into_id"))
    shared = merges.select("from_id", "into_id").join(ours, "from_id").join(theirs, ["into_id", "source_id"]).select("from_id", "into_id").distinct().withColumn("shared", F.lit(True))
    full = assets.select(F.col("release_id").alias("from_id")).distinct().withColumn("full", F.lit(True))
    outcome = F.when(F.col("shared"), "not_a_candidate").when(F.col("full"), "edition_holds_assets").otherwise("decided")
    return merges.join(shared, ["from_id", "into_id"], "left").join(full, "from_id", "left").withColumn("outcome", outcome).select(*merges.columns, "outcome")


def resolved(merges: DataFrame) -> DataFrame:
    """Merges with the edition that each one ends in, by pointer jumping: chains of n take log n rounds.
    path has the seqs of all its steps, the last one first. A ring of merges is an error."""

    def jump(now: DataFrame) -> DataFrame:
        further = now.select(F.col("from_id").alias("into_id"), F.col("into_id").alias("next_id"), F.col("path").alias("next_path"))
        path = F.concat(F.coalesce("next_path", F.array().cast("array<bigint>")), "path")
        return now.join(further, "into_id", "left").select("from_id", F.coalesce("next_id", "into_id").alias("into_id"), path.alias("path"))

    done = fixed_point(merges.select("from_id", "into_id", F.array(F.col("seq").cast("long")).alias("path")), jump, "merges", merges.count().bit_length() + 2)
    if not done.where("from_id = into_id").isEmpty():
        raise ValueError("editions are merged in a ring")
    return done


def merged(editions: DataFrame, claims: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """merges: from_id, into_id, seq. Claims move to the edition that theirs ends in. Of claims that are
    equal but for their location an edition keeps its own row, else that of the first merged in; merged
    editions go."""
    end = resolved(merges)
    moved = claims.join(end, claims["release_id"] == end["from_id"], "left")
    moved = moved.select(F.coalesce("into_id", "release_id").alias("release_id"), *CLAIM[1:], "seq", F.coalesce("path", F.array().cast("array<bigint>")).alias("path"))
    key = [c for c in CLAIM if c != "location"]
    kept = moved.groupBy(*key).agg(F.min(F.struct("path", "seq", "location")).alias("k")).select(*key, "k.location", "k.seq").select(*CLAIM, "seq")
    return editions.join(end.select(F.col("from_id").alias("id")), "id", "left_anti"), kept


def merged_sets(sets: DataFrame, merges: DataFrame) -> DataFrame:
    """Dump sets of merged editions, on the editions that these end in."""
    end = resolved(merges).select(F.col("from_id").alias("release_id"), "into_id")
    return sets.join(end, "release_id", "left").withColumn("release_id", F.coalesce("into_id", "release_id")).select(*sets.columns)


def renamed_candidates(items: DataFrame, merges: DataFrame) -> DataFrame:
    """items: item_id, candidates. Those that were not merged keep their order; what the others became
    follows in the order of the merges, each named once."""
    end = resolved(merges)
    rows = items.select("item_id", F.posexplode_outer("candidates").alias("pos", "id")).join(end, F.col("id") == F.col("from_id"), "left")
    place = F.struct(F.col("into_id").isNotNull().alias("new"), F.coalesce(F.get("path", F.lit(0)), "pos").cast("long").alias("at"))
    first = rows.groupBy("item_id", F.coalesce("into_id", "id").alias("id")).agg(F.min(place).alias("place"))
    named = F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("place", "id")))), lambda x: x["id"])
    return first.groupBy("item_id").agg(named.alias("candidates"))


def detached(provenance: DataFrame, assets: DataFrame, links: DataFrame, keep_release: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links: identity, the candidates to detach; keep_release: identity and the release to keep, if any.
    Their provenance goes on all other releases, and assets that have none left."""
    key = ["release_id", "asset_type", "object_hash"]
    wanted = links.select("identity").distinct().join(keep_release, "identity", "left")
    rows = provenance.join(wanted, "identity", "left").join(links.select("identity").distinct().withColumn("cut", F.lit(True)), "identity", "left")
    left = rows.where("cut is null or release_id <=> kept_id").select(*provenance.columns)
    return left, assets.join(left.select(*key).distinct(), key, "left_semi")


def without_orphans(games: DataFrame, editions: DataFrame) -> DataFrame:
    """Games that still have an edition."""
    return games.join(editions.select("game_id").distinct(), "game_id", "left_semi")


def recorded(derivatives: DataFrame, new: DataFrame) -> DataFrame:
    """One derivative per original and recipe: the one that was there, else the least new one."""
    rows = derivatives.withColumn("later", F.lit(0)).unionByName(new.withColumn("later", F.lit(1)))
    return rows.groupBy("object_hash", "recipe").agg(F.min_by("output", F.struct("later", "output")).alias("output"))


def forgotten(derivatives: DataFrame, gone: DataFrame) -> DataFrame:
    """Derivatives whose output isn't gone."""
    return derivatives.join(gone.select(F.col("object_hash").alias("output")), "output", "left_anti").select(*derivatives.columns)


def replaced_sets(sets: DataFrame, new: DataFrame) -> DataFrame:
    """Dump sets by source and record, new ones for old."""
    return sets.join(new.select("source_id", "record_id"), ["source_id", "record_id"], "left_anti").unionByName(new.select(*sets.columns))
