"""A corpus pipeline of five stages over documents; every stage works on all that the one before has kept.

Every stage takes and returns the columns of documents (the last one adds its own), whatever further columns there are and
however they are called; an empty table stays empty; very long texts are texts like others. What a stage does with null
and repeated rows is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import decontaminate, jaccard_join, language_id, mixing, secret_scan
from panelforge.llm.common import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go: without a text or a letter in it, or hardly compressed by any language's tree. Repeated rows and null ids stay as they are."""
    return language_id.keep_identified(docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of similarity 0.8 and more connect, the one with the smallest id stays, then that of the smallest text code.

    Repeated rows are one document; rows without an id come last; null and blank texts are linked with nothing and stay.
    """
    return jaccard_join.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item of 24 characters and more, or nearly one, go; row by row, null texts stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found in a text are replaced by a mark; all rows stay, null texts null. n_chars stays that of the original text."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its order: the documents with size, source_size, target, taken, finish, rounds; null texts are taken 0 times, repeated rows count each.

    Where the documents have a column of such a name, it stays, and the mix's own is called mix_size and so on.
    """
    return mixing.mix(docs, carry=tuple(x for x in docs.columns if x not in ("doc_id", "source")))


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
]

#: Edit distances, the fitted language trees and components have no SQL that ends in reasonable time.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again, and deleted when the next one is written."""
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
