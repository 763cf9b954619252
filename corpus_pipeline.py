"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Every stage but the last takes and returns rows with the columns of ``documents`` (any further
columns are kept): a stage drops rows or shortens texts, and ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import line_join, minhash_forest, packing, quality, repeats
from chartloom.llm.tables import documents, fresh, labels, stored


def _measured(docs: DataFrame, changed) -> DataFrame:
    """``docs`` with ``n_chars`` of the texts that changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, labels(spark, sf_dir))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one; documents of which no line with a word is left go."""
    removed, left = fresh(docs, "lines_removed", "lines_left")
    found = line_join.deduplicated(docs, removed=removed, left=left)
    found = found.where(F.col(left).isNull() | (F.col(left) > 0))
    return _measured(found, F.col(removed) > 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return minhash_forest.one_of_each(docs, minhash_forest.near_duplicates(docs))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of earlier documents; documents left with white space alone go."""
    return repeats.shortened(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", distinct_lines),
    ("near_duplicates", one_near_duplicate),
    ("repeats", without_repeats),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: A fitted model and a tokenizer aren't SQL.
ORACLE_SQL = None
