"""The corpus pipeline: documents pass the stages in order, each written as Parquet and read again for the next.

Every stage works on all that its predecessor kept and hands on the columns of documents, its decisions carried out; the
last one returns the packing. Each stage's defined results for nulls, empty and long texts, ties, repeated rows, empty
tables and further columns are stated in its operator's module.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spoor.llm import lines, neardup, packing, quality, repeats
from spoor.llm.shared import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, except in the last document that holds them."""
    return lines.drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return neardup.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 35 words and more that occur elsewhere too go."""
    return repeats.drop_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence, and the place in it, of every piece of every document."""
    return packing.pack(packing.word_lengths(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup), ("best_fit_packing", best_fit_packing)]
#: The trained classifier, near-duplicate components and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
