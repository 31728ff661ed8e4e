"""The object store against the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(referenced: DataFrame, stored: DataFrame) -> DataFrame:
    """Objects that the catalog names and the store lacks."""
    return referenced.select("object_hash").distinct().join(stored.select("object_hash"), "object_hash", "left_anti")


def unreferenced(referenced: DataFrame, stored: DataFrame) -> DataFrame:
    return missing(stored, referenced)


def derived_in_use(derived: DataFrame, referenced: DataFrame) -> DataFrame:
    """Derivatives (derived_hash, object_hash per original) all of whose originals are referenced."""
    there = referenced.select("object_hash").distinct().withColumn("there", F.lit(True))
    rows = derived.distinct().join(there, "object_hash", "left")
    return rows.groupBy("derived_hash").agg(F.count("*").alias("originals"), F.bool_and(F.coalesce("there", F.lit(False))).alias("in_use"))


def with_provenance(assets: DataFrame, provenance: DataFrame) -> DataFrame:
    keys = ["release_id", "k1", "k2", "k3"]
    return assets.join(provenance.select(*keys).distinct(), keys, "left_semi").select("object_hash").distinct()


def without_recipe(originals: DataFrame, derived: DataFrame) -> DataFrame:
    return originals.join(derived.select("object_hash"), "object_hash", "left_anti")


def repairs(found: DataFrame, derivatives: DataFrame, referenced: DataFrame, reset_damaged: bool = False, remove_orphaned: bool = False, collect_unreferenced: bool = False) -> DataFrame:
    """What repair does: `forget` a derivative and its recipe, `remove_derived` and `collect_original` a file.
    found: area (original, derived), object_hash and state (missing, corrupt, unreadable, orphaned,
    unreferenced) of what an examination found. derivatives: output, recipe and originals, all that it was
    made of. A damaged output is forgotten by all that record it, an orphaned one where an original is no
    longer referenced; unreadable files are left to a human."""
    if not (reset_damaged or remove_orphaned or collect_unreferenced):
        raise ValueError("no repair is asked for")
    of = lambda area, *states: found.where((F.col("area") == area) & F.col("state").isin(*states)).select("object_hash").distinct()
    damaged = of("derived", "missing", "corrupt").select(F.col("object_hash").alias("output")).withColumn("damaged", F.lit(reset_damaged))
    there = referenced.select("object_hash").distinct().withColumn("there", F.lit(True))
    each = derivatives.select("output", "recipe", F.explode("originals").alias("object_hash")).join(there, "object_hash", "left")
    lost = each.groupBy("output", "recipe").agg(F.bool_or(F.col("there").isNull()).alias("lost"))
    rows = derivatives.select("output", "recipe").join(damaged, "output", "left").join(lost, ["output", "recipe"], "left")
    forget = rows.where(F.coalesce("damaged", F.lit(False)) | (F.lit(remove_orphaned) & F.coalesce("lost", F.lit(False))))
    out = forget.select(F.lit("forget").alias("action"), F.col("output").alias("object_hash"), "recipe")
    files = of("derived", *(["corrupt"] if reset_damaged else []), *(["orphaned"] if remove_orphaned else []))
    files = files.join(of("derived", "unreadable"), "object_hash", "left_anti")
    gone = of("original", *(["unreferenced"] if collect_unreferenced else []))
    for action, part in (("remove_derived", files), ("collect_original", gone)):
        out = out.unionByName(part.select(F.lit(action).alias("action"), "object_hash", F.lit(None).cast("string").alias("recipe")))
    return out.distinct()


def models_to_build(bases: DataFrame, models: DataFrame) -> DataFrame:
    """Of the releases that share a front scan and a recipe the first one builds the model, all are up to
    date where one is there. bases: release_id, front_hash, recipe. models: object_hash, recipe."""
    there = models.select(F.col("object_hash").alias("front_hash"), "recipe").distinct().withColumn("there", F.lit(True))
    first = bases.groupBy("front_hash", "recipe").agg(F.min("release_id").alias("first")).join(there, ["front_hash", "recipe"], "left")
    state = F.when(F.col("there") | (F.col("release_id") > F.col("first")), "up_to_date").otherwise("built")
    return bases.join(first, ["front_hash", "recipe"]).select("release_id", "front_hash", "recipe", state.alias("state"))


def recipe_key(template: Column, back_hash: Column, spine_hash: Column) -> Column:
    """The name of a packaging model's recipe; its output is recorded under the front scan."""
    return F.concat(F.lit("packaging-model-"), template, F.lit("-"), back_hash, F.lit("-"), spine_hash)


def thumbnail_key(max_edge: int) -> str:
    return f"thumbnail-png-{max_edge}"


def box_geometry(front_width: Column, front_height: Column, spine_width: Column, spine_height: Column) -> Column:
    """Half the width and half the depth of a box of height 1, from the sizes of its scans."""
    return F.struct((front_width / front_height / 2).alias("half_width"), (spine_width / spine_height / 2).alias("half_depth"))
