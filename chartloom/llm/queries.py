"""The registered queries of this folder: name -> function of (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import language, line_join, line_rules, minhash_forest, ngram, packing, postings, quality, repair, repeats, segmentation, syncmers, variants
from chartloom.llm.tables import benchmark, conversations, documents, labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(run):
    QUERIES[run.__name__] = run
    return run


@_query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the documents that aren't held out."""
    return language.identified(documents(spark, sf_dir))


@_query
def op2_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line or are similar to one."""
    return line_join.line_counts(documents(spark, sf_dir), least=1)


@_query
def op3_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-syncmer fingerprints of every text and of its edited text."""
    return syncmers.fingerprints(documents(spark, sf_dir))


@_query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality score of every document."""
    return quality.scored(documents(spark, sf_dir), labels(spark, sf_dir))


@_query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, best-fit packed into sequences of 1024 tokens."""
    return packing.packed(documents(spark, sf_dir))


@_query
def op6_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents and the one that stays of each."""
    return minhash_forest.near_duplicates(documents(spark, sf_dir))


@_query
def op7_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every text: pieces, scores, digests and decoding of all."""
    return segmentation.encoded(documents(spark, sf_dir))


@_query
def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that an earlier document holds, in strings of 50."""
    found = repeats.removed(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), "kept_sha256")


@_query
def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, lines above the host limit and the verdict for every document."""
    return line_rules.judge(documents(spark, sf_dir))


@_query
def op10_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text under the trie, and under the unigram base."""
    return ngram.scored(documents(spark, sf_dir), ngram.held_out)


@_query
def op11_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of ten words of a benchmark item, and the items."""
    return postings.contamination_digest(documents(spark, sf_dir), benchmark(spark, sf_dir))


@_query
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and the cost, audit and digest of its cheapest repair."""
    original = conversations(spark, sf_dir)
    return repair.digested(repair.damaged(original), original)


@_query
def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the corpus with their near words, their more frequent form and the root of their group."""
    return variants.grouped(variants.counted(documents(spark, sf_dir)))


#: DuckDB SQL for the queries that SQL can express.
SQL: dict[str, str] = {"op11_contamination": postings.SQL, "op12_repair": repair.SQL, "op13_variants": variants.SQL}
