"""Corpus pipeline: five operators in a row, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of `docs`, those that an operator uses for itself included. run() writes each result as Parquet to
the shared folder and reads it for the next.

Cases, in every stage. An empty table gives an empty one. A null doc_id is carried. Rows of one doc_id
are rows of their own but where a stage says otherwise.
"""

from __future__ import annotations

from lodestack.llm import bloom, decontaminate, line_dedup, ngram_join, packing, toxicity
from lodestack.llm.common import materialise, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, does not predict as
    toxic. Null and empty texts stay; without labels of both classes everything stays."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds, also when nothing is left of one; n_chars,
    where there is such a column, follows. A null text becomes the empty one; without a doc_id all lines stay."""
    out = line_dedup.dedup_lines(docs, counts=False)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest doc_id; rows of one doc_id are one
    document, and stay or go together. Texts without words and rows without a doc_id stay."""
    found = materialise(ngram_join.jaccard_components(docs), "near-copies")
    lost = materialise(found.where("doc_id <> component_id").select("doc_id").distinct(), "lost")
    maybe, others = bloom.sift(docs, "doc_id", lost)
    return others.unionByName(maybe.join(lost, "doc_id", "left_anti")).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not give a benchmark item away; without a benchmark all of them."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a training sequence; an empty text is one piece of the end id."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_leaks), ("best-fit packing", pack)]

#: The stages fit models and verify tokens; the tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
