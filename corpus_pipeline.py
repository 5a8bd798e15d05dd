"""The corpus pipeline: quality rules, one document of each near-duplicate group, decontamination, PII, packing.

All stages but the last give back the columns of documents, extra ones and those with names that operators use inside among
them. Null ids are kept as ids; repeated rows go or stay together; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmark.llm import decontamination, jaccard, packing, pii, quality
from leafmark.llm.common import short_batches, stored, table
from leafmark.llm.queries import tokenizer_path
from leafmark.plans.session import ship_package

#: Pieces of text whose ids a worker of the packing remembers, twice so many at most.
PIECES = 1 << 16

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go, null and empty texts with them (they have fewer than 50 words)."""
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: a similarity of 0.8 or more over shingles of five words. Of a group the smallest id stays; texts without
    words and rows without an id stay too. Rows that share an id go or stay by their own text."""
    ship_package(spark)
    return jaccard.one_of_each(docs, percent=80, width=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words of a benchmark item in a row go; null texts hold none."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its personal data replaced by the kind of it; null texts stay null."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; a null or empty text is its end id alone."""
    ship_package(spark)
    # an executor's heap has grown by now: few texts go to a worker at once, and it remembers few
    with short_batches(spark):
        return stored(packing.pack(docs, tokenizer_path(), entries=PIECES).drop("padded"), "pieces")


STAGES: list[tuple[str, Stage]] = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("benchmark_decontamination", benchmark_decontamination), ("personal_data", personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship_package(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


#: The tokenizer has no SQL; tests hold run() against plain Python.
ORACLE_SQL = None
