"""Grouping rows into lists, numbering and selecting them, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.session import cut_lineage


def keep_unique_only(df: DataFrame) -> DataFrame:
    """Rows that occur exactly once; every copy of a repeated row goes."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The least row per key in a declared order; one pass with map-side partial minima."""
    rest = [c for c in df.columns if c not in set(keys)]
    ordered = list(order) + [c for c in rest if c not in set(order)]
    least = F.min(F.struct(*ordered)).alias("_r")
    return df.groupBy(*keys).agg(least).select(*keys, *[F.col("_r." + c) for c in ordered]).select(*df.columns)


def keep_top_ties(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """All rows that reach the best score of their key.

    ``rank() = 1`` is cut to the best rows before the shuffle (partial window group limit).
    """
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc())
    return df.withColumn("_rank", F.rank().over(w)).where("_rank = 1").drop("_rank")


def number_within(
    df: DataFrame, keys: Sequence[str], position: str, ties: Sequence[str], name: str = "rn", width: int = 16384
) -> DataFrame:
    """Row numbers 1, 2, … per key in the order (position, ties).

    ``position`` is a whole number. Rows are numbered inside (key, block of ``width``
    positions) and moved up by the rows of earlier blocks, which are summed on the small
    table of block counts. A key with very many rows is thus numbered by many tasks.
    """
    keys = list(keys)
    blocked = df.withColumn("_block", F.floor(F.col(position) / width))
    sizes = blocked.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_block").orderBy(position, *ties)
    numbered = blocked.withColumn("_k", F.row_number().over(inside))
    return (
        numbered.join(shift, [*keys, "_block"])
        .withColumn(name, (F.col("_k") + F.col("_shift")).cast("long"))
        .select(*df.columns, name)
    )


def number_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    """Row numbers 1, 2, … per key in the order of any columns, one row shape at every size.

    Rows are sorted by (key, order) over ranges and written; numbers are counted inside
    (key, range) and moved up by the rows of earlier ranges. A key with very many rows fills
    many ranges, so no task holds it.
    """
    keys, order = list(keys), list(order)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(tasks, *keys, *order).withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    sizes = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    same = F.lit(True)
    for k in [*keys, "_part"]:
        same = same & F.col("r." + k).eqNullSafe(F.col("s." + k))
    numbered = ranged.withColumn("_k", F.row_number().over(inside)).alias("r").join(shift.alias("s"), same)
    return numbered.select(*[F.col("r." + c) for c in df.columns], (F.col("_k") + F.col("_shift")).cast("long").alias(name))


def seeded_order(seed, *cols) -> Column:
    """First 15 hex digits of an MD5, as a number: equal on every engine that has MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sample_per_group(df: DataFrame, key: str, ids: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows per group (all, if there are fewer), drawn by hashed order of their ids.

    The limit is applied in the map tasks first (partial window group limit), so a hot group
    sends at most ``n`` rows per task.
    """
    w = Window.partitionBy(key).orderBy(seeded_order(seed, key, *ids), *ids)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def shuffle_docs(docs: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Documents in a seeded random order (range-partitioned sort)."""
    return docs.withColumn("shuffle_key", seeded_order(seed, id_col)).orderBy("shuffle_key", id_col)


def limit_docs(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    """At most ``n`` documents that are not empty; a negative ``n`` keeps all."""
    kept = docs.where(F.length(text) > 0)
    return kept if n < 0 else kept.limit(n)


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Bag union by column name; columns a source lacks are null."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def common_concepts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys both tables have."""
    return a.select(key).intersect(b.select(key))


def split_by_membership(docs: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(documents listed in ``ids``, documents not listed)."""
    wanted = ids.select(key).distinct()
    return docs.join(wanted, key, "left_semi"), docs.join(wanted, key, "left_anti")
