"""Corpus pipeline: quality filter, line dedup, near-dedup, PII removal, packing.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame`` over everything its
predecessor kept.  ``run`` writes each result as Parquet in the shared folder and
reads it back for the next stage.  All stages but the last return the columns of
``documents``; ``n_chars`` follows the text where a stage changes it.

Defined cases, over all stages: a null or empty text is scored like any other, holds no line
and no span, links with other texts without words, and packs as the end id alone; a
very long text is read whole; rows that repeat an id are one document to the near-dedup
stage and rows of their own elsewhere; an empty table gives an empty result of the same
columns; further columns pass through every stage but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.op1_simhash import simhash_groups
from cohortlens.llm.op2_lines import delete_lines
from cohortlens.llm.op3_pii import FULL, sanitise
from cohortlens.llm.op4_classifier import fit, keep_good
from cohortlens.llm.op9_packing import pack_documents
from cohortlens.llm.queries import vocabulary
from cohortlens.llm.shipping import ship_package
from cohortlens.llm.staging import read_documents, stage


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the present text, where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.7 go."""
    ship_package(spark)
    return keep_good(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds are deleted."""
    ship_package(spark)
    return _counted(delete_lines(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document with the smallest id stays.

    Rows that repeat an id are one document and stay or go together; rows without an
    id stay when no row of their group has one.
    """
    ship_package(spark)
    stays = stage(simhash_groups(docs, shingle=3, max_bits=2)
                  .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
                  .select(F.col("doc_id").alias("_stays")).distinct(), "stays")
    # the ids that stay grow with the corpus: a merge join at every size
    return docs.join(stays.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("_stays")),
                     "left_semi")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced, at all their places."""
    ship_package(spark)
    return _counted(sanitise(docs, **FULL))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents are packed into sequences of at most 2048 tokens."""
    ship_package(spark)
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL can express the classifier, the alignment or the packing; tests/llm compares
#: every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
