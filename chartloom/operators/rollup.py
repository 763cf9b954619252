"""Patient flags, and structured against text-derived evidence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.operators.interpret import convert_units, plausible

TEXT, STRUCTURED = "NLP", "Tabular"
BENEFIT, BOTH = "NLP - Tabular", "NLP + Tabular"


def _no(c) -> Column:
    return F.coalesce(c, F.lit(False))


def _per(patient: str, *tables: DataFrame) -> list[str]:
    """The patient, and the disease where all tables have it."""
    return [*(["disease"] if all("disease" in t.columns for t in tables) else []), patient]


def patient_flags(
    df: DataFrame, concepts: Sequence[str], positive: Column | None = None, concept: str = "concept", patient: str = "patient_num"
) -> DataFrame:
    """One row per patient: has a result of each concept, and has a positive one.

    One aggregation with map-side partial results; rows without a concept keep their patient.
    Where ``df`` tells diseases apart, so do the flags.
    """
    aggs = [_no(F.bool_or(F.col(concept) == c)).alias(c) for c in concepts]
    if positive is not None:
        aggs += [_no(F.bool_or((F.col(concept) == c) & positive)).alias(f"{c} positive") for c in concepts]
    return df.groupBy(*_per(patient, df)).agg(*aggs)


def any_flag(df: DataFrame, columns: Sequence[str], name: str = "at_least_one") -> DataFrame:
    """True where one of the flags is."""
    return df.withColumn(name, reduce(lambda a, b: a | b, [_no(F.col(f"`{c}`")) for c in columns]))


def combine_flags(a: DataFrame, b: DataFrame, patient: str = "patient_num") -> DataFrame:
    """Flags of two sources, true where either is."""
    both = a.unionByName(b, allowMissingColumns=True)
    keys = _per(patient, a, b)
    flags = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(*[_no(F.bool_or(F.col(f"`{c}`"))).alias(c) for c in flags])


def join_flag_sources(
    a: DataFrame, b: DataFrame, patient: str = "patient_num", suffixes: tuple[str, str] = ("_nlp", "_tabular")
) -> DataFrame:
    """Patients of both sources with the flags of each, told apart by suffix."""

    keys = _per(patient, a, b)

    def named(df, s):
        return df.withColumnsRenamed({c: c + s for c in df.columns if c not in keys})

    return named(a, suffixes[0]).join(named(b, suffixes[1]), keys)


def source_comparison(
    text_flags: DataFrame, struct_flags: DataFrame, concepts: Sequence[str], patient: str = "patient_num"
) -> DataFrame:
    """Per concept: patients found by each source, by text only, and by either, with percentages.

    Patients are paired by id. Percentages refer to the patients of the structured source.
    """

    def cut(df, s):
        return df.select(patient, *[F.col(f"`{c}`").alias(f"{s}{i}") for i, c in enumerate(concepts)], F.lit(True).alias(s))

    j = cut(text_flags, "t").join(cut(struct_flags, "s"), patient, "full_outer")
    aggs = [F.count_if(_no(F.col("s"))).alias("n")]
    for i in range(len(concepts)):
        t, s = _no(F.col(f"t{i}")), _no(F.col(f"s{i}"))
        aggs += [
            F.count_if(s).alias(f"structured{i}"),
            F.count_if(t).alias(f"text{i}"),
            F.count_if(t & ~s & _no(F.col("s"))).alias(f"benefit{i}"),
            F.count_if(t | s).alias(f"both{i}"),
        ]
    kinds = ["structured", "text", "benefit", "both"]
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("concept"), *[F.col(f"{k}{i}").alias(k) for k in kinds])
            for i, c in enumerate(concepts)
        ]
    )
    out = j.agg(*aggs).select("n", F.explode(rows).alias("r")).select("r.*", F.col("n").alias("patients"))
    return out.withColumns({f"{k}_pct": F.round(F.col(k) / F.col("patients") * 100, 1) for k in kinds})


def set_regions(flags: DataFrame, columns: Sequence[str], patient: str = "patient_num") -> DataFrame:
    """Patients per combination of two or three flags, with totals and percentages.

    The region without any flag is left out; it counts in ``total_patients``.
    """
    if len(columns) not in (2, 3):
        raise ValueError("two or three flags")
    regions = flags.groupBy(*[_no(F.col(f"`{c}`")).alias(c) for c in columns]).agg(F.count("*").alias("n"))
    some = reduce(lambda a, b: a | b, [F.col(f"`{c}`") for c in columns])
    everything = Window.partitionBy()  # at most eight rows
    out = regions.withColumns(
        {
            "total_patients": F.sum("n").over(everything),
            "total_positive": F.sum(F.when(some, F.col("n")).otherwise(0)).over(everything),
        }
    )
    return out.where(some).withColumn("pct", F.round(F.col("n") / F.col("total_patients") * 100, 1))


def positive_share(flags: DataFrame, columns: Sequence[str], patient: str = "patient_num") -> DataFrame:
    """Patients with at least one flag, all patients, and the percentage."""
    some = reduce(lambda a, b: a | b, [_no(F.col(f"`{c}`")) for c in columns])
    out = flags.agg(
        F.count_distinct(F.when(some, F.col(patient))).alias("total_positive"), F.count_distinct(patient).alias("total_patients")
    )
    return out.withColumn("pct", F.round(F.col("total_positive") / F.col("total_patients") * 100, 1))


def source_benefit(a: DataFrame, b: DataFrame, keys: Sequence[str], method: str = BENEFIT) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks, with the name of the comparison."""
    left = a.select(*keys).distinct()
    return left.join(b.select(*keys).distinct(), list(keys), "left_anti").withColumn("method", F.lit(method))


def value_sets(text: DataFrame, struct: DataFrame, rates: DataFrame, limits: DataFrame) -> DataFrame:
    """Distinct (patient_num, concept, unit, value) per method: text, structured, text only, either.

    Inputs (patient_num, concept, unit, value). One grouping finds which sources hold a value;
    the four sets follow from it without further joins.
    """
    cols = ["patient_num", "concept", "unit", "value"]
    rows = text.select(*cols, F.lit(True).alias("t")).unionByName(struct.select(*cols, F.lit(False).alias("t")))
    rows = plausible(convert_units(rows, rates), limits)
    held = rows.groupBy(*cols).agg(F.bool_or("t").alias("in_text"), F.bool_or(~F.col("t")).alias("in_struct"))
    methods = F.array_compact(
        F.array(
            F.when(F.col("in_text"), F.lit(TEXT)),
            F.when(F.col("in_struct"), F.lit(STRUCTURED)),
            F.when(F.col("in_text") & ~F.col("in_struct"), F.lit(BENEFIT)),
            F.lit(BOTH),
        )
    )
    return held.select(*cols, F.explode(methods).alias("method"))


def value_histogram(values: DataFrame, limits: DataFrame, bins: int = 20) -> DataFrame:
    """Results per method and bin of equal width up to the concept's maximum (the last bin is closed)."""
    step = F.col("max_value") / bins
    at = F.least(F.floor(F.col("value") / step + 1e-14), F.lit(bins - 1)).cast("int")
    rows = values.join(limits, "concept").select("concept", "method", at.alias("bin"), (at * step).alias("bin_start"))
    return rows.groupBy("concept", "method", "bin", "bin_start").agg(F.count("*").alias("n"))


def value_totals(values: DataFrame) -> DataFrame:
    """Results and patients per concept and method."""
    return values.groupBy("concept", "method").agg(F.count("*").alias("n"), F.count_distinct("patient_num").alias("patients"))


def density(values: DataFrame, limits: DataFrame, points: int = 100, bandwidth_share: float = 0.02) -> DataFrame:
    """Gaussian kernel density on a grid from 0 to the concept's maximum, scaled to counts.

    The bandwidth is ``bandwidth_share`` of the maximum. Equal values are counted first; each
    distinct value then adds to the grid in the map task.
    """
    counted = values.groupBy("concept", "method", "value").agg(F.count("*").alias("n")).join(limits, "concept")
    h = F.col("max_value") * bandwidth_share
    grid = counted.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    ).withColumn("x", F.col("point") * F.col("max_value") / (points - 1))
    z = (F.col("x") - F.col("value")) / h
    kernel = F.exp(-z * z / 2) / (h * F.sqrt(F.lit(2) * F.pi()))
    return grid.groupBy("concept", "method", "point", "x").agg(F.sum(F.col("n") * kernel).alias("density"))
