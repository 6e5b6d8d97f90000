"""The corpus pipeline: documents through five stages, each written and read again.

A stage takes (spark, docs, sf_dir); all but the last return the columns of
documents, whatever their names and however many. ORACLE_SQL is None, as SQL cannot express the first stage.

Defined cases: rows with a null text go in the first stage; null doc_ids and sources are values
like any other (a null doc_id comes after all others where one of several rows stays); of rows that are equal in all columns one
stays; ties go to the smallest doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kmerloom.llm import exact_dedup, language_id, mixing, packing, simhash
from kmerloom.llm.common import documents
from kmerloom.plans.storage import deleted, scratch, scratch_path

ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    return language_id.accepted(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return exact_dedup.kept_rows(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays."""
    return simhash.kept_rows(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes its words, to the nearest whole number: rows that it leaves go, others repeat."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", identify), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stores on its way, and its input, go when its output is written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        to = scratch_path(spark, name)
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(to)
        if before:
            deleted(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(to), to
    return docs
