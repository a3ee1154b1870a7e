"""Corpus pipeline: quality rules, quality classifier, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), gets all that its predecessor kept, and returns the columns of documents; the last
returns pieces of packed sequences. run() writes every stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, kneser_ney, neardup, packing, rule_ensemble


@common.small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text passes the word rules and lies inside its language's perplexity bands; models and bands are made from docs.

    Null and empty texts and texts of under 50 words go; a null lang is a language of its own; repeated rows stay or go each.
    """
    # Whole rows ride along in one column, so no name of theirs can clash with the operator's.
    rows = docs.select("text", "lang", F.struct("*").alias("_row"))
    return kneser_ney.judged(rows).where("quality.kept").select("_row.*")


@common.small_batches
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rule ensemble scores at its threshold or above.

    It learns from the labelled rows of all documents, rejected ones included, and scores what came in, null and empty texts
    too; a row at the threshold stays; repeated rows stay or go each. Without labels of both classes all rows score alike.
    """
    learn_from = common.table(spark, sf_dir, "documents")
    scored = rule_ensemble.scored(docs.select("text", F.struct("*").alias("_row")), common.table(spark, sf_dir, "labels"), learn_from)
    return scored.where(F.col("quality_score") >= rule_ensemble.THRESHOLD).select("_row.*")


@common.small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that similarity 0.8 on shingles of five words connects: that with the smallest doc_id.

    All texts without a word, null ones too, are one group; a null doc_id comes after all others; of repeated rows one stays.
    """
    return neardup.keep_one_of_each_group(docs)


@common.small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text holds no benchmark item, errors within its budget allowed.

    Null and empty texts stay; items without a word match nothing; repeated rows stay or go each.
    """
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


@common.small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; a null text is its end id alone, a null doc_id stays null, repeated rows are packed each."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("packing", pack),
]

#: Models, near-duplicate groups and a tokenizer: SQL cannot express the stages. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents of sf_dir; a stage's table is deleted once the next is written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.remove(spark, before)
        before = docs
    return docs
