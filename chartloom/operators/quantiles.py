"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.session import cut_lineage


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Quantiles with linear interpolation, one row per group and probability (``prob``, ``quantile``).

    Distinct values with their counts are dealt out by ranges of (group, value), sampled from the
    data and written; the wanted ranks are located by the sums of the ranges, and only ranges that
    hold one are put in order. A group fills as many ranges as it needs, wherever its values lie,
    so an outlier changes nothing and no task sees a whole group.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(rows.repartitionByRange(tasks, *by, value).withColumn("_b", F.spark_partition_id()))
    sizes = ranged.groupBy(*by, "_b").agg(F.sum("_n").alias("_size"))
    # One row per group and range it fills.
    group = Window.partitionBy(*by)
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_total": F.sum("_size").over(group), "_before": F.coalesce(F.sum("_size").over(before), F.lit(0))})
    placed = ranged

    # Each probability asks for the values at two neighbouring ranks.
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    h = (F.col("_total") - 1) * F.col("prob")
    ranks = sizes.select("*", F.explode(wanted).alias("prob")).withColumns(
        {"_r": F.explode(F.array(F.floor(h), F.ceil(h))), "_w": h - F.floor(h)}
    )
    ranks = ranks.where((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_size")))
    ranks = ranks.select(*by, "_b", "_before", "prob", "_r", "_w", F.ceil(h).alias("_upper")).distinct()

    needed = placed.join(ranks.select(*by, "_b", "_before").distinct(), [*by, "_b"])
    inside = Window.partitionBy(*by, "_b").orderBy(value)
    needed = needed.withColumn("_last", F.col("_before") + F.sum("_n").over(inside) - 1)
    needed = needed.select(*by, "_b", F.col(value).alias("_v"), F.col("_last"), (F.col("_last") - F.col("_n") + 1).alias("_first"))
    hits = ranks.join(needed, [*by, "_b"]).where(F.col("_r").between(F.col("_first"), F.col("_last")))

    low = F.min(F.when(F.col("_r") < F.col("_upper"), F.col("_v")))
    high = F.max(F.when(F.col("_r") == F.col("_upper"), F.col("_v")))
    out = hits.groupBy(*by, "prob").agg(low.alias("_low"), high.alias("_high"), F.max("_w").alias("_w"))
    quantile = F.coalesce("_low", "_high") + F.col("_w") * (F.col("_high") - F.coalesce("_low", "_high"))
    return out.select(*by, "prob", quantile.alias("quantile"))


def box_summary(values: DataFrame, by: Sequence[str] = ("concept", "method"), value: str = "value") -> DataFrame:
    """Minimum, quartiles and maximum per group."""
    # Names of the five numbers.
    names = {0.0: "min", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "max"}
    q = exact_quantiles(values, by, value, list(names))
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in names.items()])
