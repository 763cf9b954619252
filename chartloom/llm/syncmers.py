"""Document fingerprints from closed syncmers.

A text is read as a sequence of letters of a large alphabet: its words, and the code points of words
of more than ``PIECE`` of them (text without spaces), so that no cut depends on where a word begins. Of each run of ``K`` letters (a k-mer) the hashes of its inner
runs of ``S`` letters are compared; the k-mer is an anchor if the least of them lies at its left
or right edge. Whether a k-mer is one depends on its own letters only, so equal passages have
equal anchors wherever they stand, and an edit changes the anchors near it and no others.

The fingerprint of a text is the set of its anchors' hashes; two fingerprints are compared by
Jaccard similarity. Texts without such a k-mer have one anchor, their whole sequence.
All built-in expressions on arrays: no Python on the executors.

Cases: null counts as the empty text; the empty text (and one of white space) has the empty
fingerprint, and two empty fingerprints have similarity 1; long texts are arrays of one row, and
work is linear in them; rows that repeat an id are ordered by text; a null id comes after all
others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.tables import stored, words

K = 6
S = 2
PIECE = 32
#: Ids per bucket: consecutive ids share a task, and as ids are whole numbers a bucket can't hold more distinct ones.
BUCKET = 512


def letters(text: Column) -> Column:
    """Hashes of a text's words, and of the code points of words of more than ``PIECE``."""
    found = words(text)
    cut = F.flatten(F.transform(found, lambda w: F.when(F.length(w) > PIECE, F.regexp_extract_all(w, F.lit("(?s)."), F.lit(0))).otherwise(F.array(w))))
    long = F.exists(found, lambda w: F.length(w) > PIECE)
    return F.transform(F.when(long, cut).otherwise(found), lambda w: F.xxhash64(w))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the anchors of ``text`` as an array of (place, hash), places in letters from 0."""
    df = df.withColumn("_l", letters(F.col(text)))
    pairs = F.zip_with(F.slice("_l", 1, F.size("_l") - 1), F.slice("_l", 2, F.size("_l") - 1), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_s", F.when(F.size("_l") >= K, pairs))
    at = lambda i, k: F.get(F.col("_s"), i + k)
    last = K - S
    edge = lambda i: F.least(at(i, 0), at(i, last)) <= F.least(*[at(i, k) for k in range(1, last)])
    df = df.withColumn("_at", F.when(F.size("_l") >= K, F.filter(F.sequence(F.lit(0), F.size("_l") - K), edge)))
    whole = F.when(F.size("_l") > 0, F.array(F.struct(F.lit(0).alias("place"), F.xxhash64("_l").alias("hash")))).otherwise(
        F.array().cast("array<struct<place:int,hash:bigint>>")
    )
    found = F.transform("_at", lambda i: F.struct(i.alias("place"), F.xxhash64(F.slice(F.col("_l"), i + 1, F.lit(K))).alias("hash")))
    return df.withColumn(out, F.when(F.size("_at") > 0, found).otherwise(whole)).drop("_l", "_s", "_at")


def fingerprint(anchors: Column) -> Column:
    """The distinct anchor hashes in order."""
    return F.array_sort(F.array_distinct(F.transform(anchors, lambda a: a["hash"])))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def as_text(marks: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits of each hash."""
    return F.array_join(F.transform(marks, lambda h: F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def _bucket(doc_id: Column) -> Column:
    return F.floor(F.coalesce(doc_id, F.lit(-(2**63))) / F.lit(BUCKET)).cast("long")


def bucket_heads(buckets: DataFrame) -> DataFrame:
    """For each bucket the next lower one in use; the lowest gets the highest.

    A global order without one task for all: a sorted table written by ranges, neighbours inside
    a range by a window, ranges linked by their first rows (one row per range).
    """
    spark = buckets.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = buckets.repartitionByRange(n, F.desc("bucket")).select("bucket", F.spark_partition_id().alias("part"))
    ranged = stored(ranged, "bucket-order")
    inside = ranged.withColumn("next", F.lead("bucket").over(Window.partitionBy("part").orderBy(F.desc("bucket"))))
    tops = ranged.groupBy("part").agg(F.max("bucket").alias("top"), F.min("bucket").alias("last"))
    ends = F.array_sort(F.collect_list(F.struct(F.col("top"), F.col("last"))))
    ring = tops.agg(ends.alias("r")).select(
        F.inline(
            F.transform(
                "r",
                lambda x, i: F.struct(
                    x["last"].alias("last"),
                    F.when(i > 0, F.get(F.col("r"), i - 1)["top"]).otherwise(F.element_at("r", -1)["top"]).alias("linked"),
                ),
            )
        )
    )
    joined = inside.join(ring, inside["bucket"] == ring["last"], "left")
    return joined.select("bucket", F.coalesce("next", "linked").alias("next"))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, marks, next_text, next_marks): texts and fingerprints of each document and of
    the next one in descending id order, cyclic.

    One shuffle of the texts, by bucket of ids. Inside a bucket, windows find the next text and
    its fingerprint; the last document of a bucket gets the first of the next bucket, from a table
    of one row per bucket.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), _bucket(F.col(doc_id)).alias("bucket"))
    heads = bucket_heads(slim.select("bucket").distinct())
    by = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), "text")
    ordered = slim.repartition("bucket").withColumn("_before", F.lag("bucket").over(by))
    first = ordered.where(F.col("_before").isNull()).select(F.col("bucket").alias("_b"), F.col("text").alias("_first"))
    link = heads.join(first, F.col("next") == F.col("_b")).select(F.col("bucket").alias("_of"), "_first")
    link = with_anchors(link, "_first", "_first_marks").withColumn("_first_marks", fingerprint(F.col("_first_marks")))
    marked = with_anchors(ordered, "text", "marks").withColumn("marks", fingerprint(F.col("marks")))
    followed = marked.withColumns({"_next": F.lead("text").over(by), "_next_marks": F.lead("marks").over(by)})
    return followed.join(link, F.col("bucket") == F.col("_of"), "left").select(
        "doc_id",
        "text",
        "marks",
        F.coalesce("_next", "_first").alias("next_text"),
        F.coalesce("_next_marks", "_first_marks").alias("next_marks"),
    )


def edited_text(text: Column, next_text: Column) -> Column:
    """``text`` with its last third of code points replaced by as many first ones of ``next_text``."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(next_text, F.lit(1), third))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_chars, digest of the edited text, both fingerprints and their likeness."""
    df = with_next(docs, doc_id, text)
    df = df.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    df = with_anchors(df, "edited", "edited_marks").withColumn("edited_marks", fingerprint(F.col("edited_marks")))
    return df.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("marks")).alias("fingerprint"),
        as_text(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
        F.size("marks").cast("long").alias("n_anchors"),
    )
