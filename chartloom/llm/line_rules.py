"""Quality rules with cross-document line frequency.

A line that many documents of one host share is boilerplate of that host. Lines are normalised
and hashed, the distinct documents per (host, line) counted, lines above the limit removed, and
documents that lose too much rejected. All built-in expressions: no Python on the executors.

Definitions
-----------
* A line is a ``\\n``-separated part. In its normal form each run of digits and white space is one
  space, none at the ends; lines with an empty normal form are left alone.
* A line is removed if more than ``max_documents`` documents of its host hold it, however large the
  host is.
* A document is depleted if less than ``min_kept`` of its code points are left.

Cases: null text counts as empty; null host is a host of its own; rows that repeat a ``doc_id``
count once in the line counts and give one result row each; a null id is an id of its own; an empty table gives an empty result; further columns
are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.tables import WORD, fresh, stored, words

WINDOW = 8
MAX_DOCUMENTS = 5
MIN_KEPT = 0.5


def _normal(line: Column) -> Column:
    """A line with each run of white space and digits as one space, none at the ends."""
    plain = ~line.rlike(r"[\x09-\x0D0-9]|\x20\x20")
    return F.when(plain, F.trim(line)).otherwise(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D0-9]+", " ")))


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_words", words(F.col(text)))
    # Hashes of runs of 1, 2, 4 and then 8 words, each from two of the step before; a text
    # without an equal pair of runs of 4 has none of 8.
    df = df.withColumn("_run", F.transform("_words", lambda w: F.xxhash64(w)))
    none = F.array().cast("array<bigint>")
    for width in (1, 2, 4):
        longer = F.zip_with(
            F.slice("_run", 1, F.size("_run") - width), F.slice("_run", width + 1, F.size("_run") - width), lambda a, b: F.xxhash64(a, b)
        )
        useful = F.size("_run") > width
        if width == 4:
            useful = useful & (F.size(F.array_distinct("_run")) < F.size("_run"))
        df = df.withColumn("_run", F.when(useful, longer).otherwise(none))
    df = df.withColumnRenamed("_run", "_windows")
    lines = F.transform(
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x)
    )
    df = df.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        # Nearly all texts have no repeated window: only the others are ordered.
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.col("_windows")).alias("_windows"),
    )
    pairs = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_pairs", pairs)
    n = F.size("_pairs")
    flagged = F.filter(
        F.transform(
            "_pairs",
            lambda p, k: F.when(
                ((k > 0) & (F.get(F.col("_pairs"), k - 1)["h"] == p["h"])) | ((k < n - 1) & (F.get(F.col("_pairs"), k + 1)["h"] == p["h"])),
                p["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    df = df.withColumn("_places", F.sort_array(flagged))
    steps = F.aggregate(
        F.transform("_places", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(i - F.get(F.col("_places"), k - 1), F.lit(WINDOW)))),
        F.lit(0),
        lambda a, b: a + b,
    )
    return df.select(
        *docs.columns,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(steps, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _lines(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """One row per line with more than digits and white space: document (id and hash of its text), place, host, hash, code points."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(t).alias("text_hash"),
        F.col(host).alias("host"),
        F.posexplode(F.split(t, "\n")).alias("place", "line"),
    )
    rows = rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D0-9]"))
    return rows.select("doc_id", "text_hash", "host", "place", F.xxhash64(_normal(F.col("line"))).alias("line_hash"), F.length("line").alias("chars"))


def boilerplate(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_documents: int = MAX_DOCUMENTS,
) -> DataFrame:
    """The (host, line_hash) of lines above the limit, with their count of documents.

    The distinct (host, line, document) rows are made by a partial aggregation keyed by all
    three, so neither a hot host nor a hot line meets in one task; the counts after it are
    summed on the map side as well.
    """
    return _boilerplate(_lines(docs, doc_id, text, host), max_documents)


def _boilerplate(lines: DataFrame, max_documents: int) -> DataFrame:
    seen = lines.select("host", "line_hash", "doc_id").distinct()
    return seen.groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("n_documents")).where(F.col("n_documents") > max_documents)


def _hits(lines: DataFrame, common: DataFrame) -> DataFrame:
    """The ``lines`` that ``common`` lists, each place of a document once."""
    listed = common.select(F.col("host").alias("_host"), F.col("line_hash").alias("_line"))
    hit = lines.join(listed, F.expr("host <=> _host and line_hash = _line"), "left_semi")
    return hit.groupBy("doc_id", "text_hash", "host", "place", "line_hash").agg(F.max("chars").alias("chars"))


def remove_boilerplate(docs: DataFrame, common: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` with the lines of ``common`` taken out of ``text``; other columns stay as they are."""
    i, h, s, g = fresh(docs, "_id", "_hash", "_host", "_gone")
    hits = _hits(_lines(docs, doc_id, text, host), common)
    gone = hits.groupBy(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.col("host").alias(s)).agg(F.collect_set("line_hash").alias(g))
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    on = F.col(doc_id).eqNullSafe(F.col(i)) & (own == F.col(h)) & F.col(host).eqNullSafe(F.col(s))
    left = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains(F.col(g), F.xxhash64(_normal(x))))
    clean = F.when(F.col(g).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    joined = docs.join(gone, on, "left")
    return joined.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def judge(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_documents: int = MAX_DOCUMENTS,
    min_kept: float = MIN_KEPT,
) -> DataFrame:
    """One row per document: base measures, characters and lines removed, verdict."""
    lines = stored(_lines(docs, doc_id, text, host), "lines")
    removed = (
        _hits(lines, _boilerplate(lines, max_documents))
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("host").alias("_host"))
        .agg(F.sum("chars").alias("removed_chars"), F.count(F.lit(1)).alias("removed_lines"))
    )
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        F.col(host).alias("host"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("n_chars"),
    )
    base = base_measures(slim, "text").drop("text")
    out = base.join(removed, F.expr("doc_id <=> _id and text_hash = _hash and host <=> _host"), "left")
    gone = F.coalesce(F.col("removed_chars"), F.lit(0))
    depleted = (F.col("n_chars") - gone) < min_kept * F.col("n_chars")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
        gone.cast("long").alias("removed_chars"),
        F.coalesce(F.col("removed_lines"), F.lit(0)).cast("long").alias("removed_lines"),
    )
