"""Scores of predicted annotations and codes against gold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.text import codes_hit
from chartloom.operators.spans import containment_join, overlap_join

SPAN = ["span_start", "span_end"]
# Qualifier values that mean "nothing special".
DEFAULT_QUALIFIERS = ["Certain", "Present", "Unknown", "False", "false"]


def frequency(df: DataFrame, column: str, doc: str) -> DataFrame:
    """Rows and documents per value."""
    return df.groupBy(column).agg(F.count("*").alias("n"), F.count_distinct(doc).alias("docs"))


def _sums(df: DataFrame, keys: Sequence[str], tp: Column, fp: Column, fn: Column) -> DataFrame:
    z = F.lit(0).cast("long")
    return df.groupBy(*keys).agg(
        F.sum(F.coalesce(tp, z)).cast("long").alias("tp"),
        F.sum(F.coalesce(fp, z)).cast("long").alias("fp"),
        F.sum(F.coalesce(fn, z)).cast("long").alias("fn"),
    )


def match_counts(gold: DataFrame, pred: DataFrame, exact: bool = True, keys: Sequence[str] = ("source", "label")) -> DataFrame:
    """TP, FP and FN per document and label (and further keys, such as a model).

    Annotations are sets of rows. With ``exact`` two spans match when they are equal: one
    grouping of both tables by span counts everything. Otherwise a prediction matches the
    gold spans it contains. TP and FN count gold rows, FP counts predictions.
    """
    keys = list(keys)
    g, p = gold.distinct(), pred.distinct()
    if exact:
        rows = g.select(*keys, *SPAN, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(
            p.select(*keys, *SPAN, F.lit(0).alias("g"), F.lit(1).alias("p"))
        )
        spans = rows.groupBy(*keys, *SPAN).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
        return _sums(
            spans, keys,
            F.when(F.col("p") > 0, F.col("g")), F.when(F.col("g") == 0, F.col("p")), F.when(F.col("p") == 0, F.col("g")),
        )
    pairs = containment_join(p, g, keys, "inner", inner_suffix="_g")
    one, zero = F.lit(1), F.lit(0)

    def rows(df, names, **weights):
        return df.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *[weights.get(w, zero).alias(w) for w in ("tp", "fp", "fn")])

    hit_gold = pairs.select(*[c + "_g" for c in g.columns]).distinct()
    hit_pred = pairs.select(*p.columns).distinct()
    parts = (
        rows(g, keys, fn=one)
        .unionByName(rows(p, keys, fp=one))
        .unionByName(rows(hit_gold, [k + "_g" for k in keys], tp=one, fn=-one))
        .unionByName(rows(hit_pred, keys, fp=-one))
    )
    return _sums(parts, keys, F.col("tp"), F.col("fp"), F.col("fn"))


def qualifier_labels(df: DataFrame, qualifiers: Sequence[str]) -> DataFrame:
    """Qualifier columns as ``Name_value`` texts; default values become null."""
    return df.withColumns(
        {
            q: F.when(F.col(q).isNotNull() & ~F.col(q).isin(DEFAULT_QUALIFIERS), F.concat(F.lit(q + "_"), F.col(q)))
            for q in qualifiers
        }
    )


def qualifier_counts(
    gold: DataFrame,
    pred: DataFrame,
    qualifiers: Sequence[str] = ("Certainty", "Temporality", "Negation", "Action"),
    label: str = "Chemical_and_drugs",
    exact: bool = True,
    by_name: bool = False,
    doc: str = "source",
) -> DataFrame:
    """TP, FP and FN per document and qualifier value, for entities of one label.

    A gold qualifier is right where a matching prediction has it, wrong where one lacks it
    or none matches; a predicted qualifier no matching gold entity has is a false positive.
    ``by_name=True`` adds up the values of each qualifier.
    """
    keys = [doc]
    cols = [*keys, *SPAN, *qualifiers]
    g = qualifier_labels(gold.where(F.col("label") == label).select(*cols).distinct(), qualifiers)
    p = qualifier_labels(pred.where(F.col("label") == label).select(*cols).distinct(), qualifiers)
    if exact:
        pairs = p.join(g.withColumnsRenamed({c: c + "_g" for c in cols}), [F.col(c) == F.col(c + "_g") for c in [*keys, *SPAN]])
    else:
        pairs = containment_join(p, g, keys, "inner", inner_suffix="_g")
    z, one = F.lit(0), F.lit(1)

    def cell(name, tp=z, fp=z, fn=z):
        return F.struct(name.alias("label"), tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"))

    def long(df, key, cells):
        return df.select(F.col(key).alias(doc), F.explode(F.array(*cells)).alias("c")).where("c.label is not null").select(doc, "c.*")

    both = []
    for q in qualifiers:
        gq, pq = F.col(q + "_g"), F.col(q)
        same = gq.eqNullSafe(pq)
        both.append(cell(gq, tp=F.when(same, 1).otherwise(0), fn=F.when(same, 0).otherwise(1)))
        both.append(cell(F.when(~same, pq), fp=one))
    alone_g = g.join(pairs.select(*[F.col(c + "_g").alias(c) for c in [*keys, *SPAN]]).distinct(), [*keys, *SPAN], "left_anti")
    alone_p = p.join(pairs.select(*keys, *SPAN).distinct(), [*keys, *SPAN], "left_anti")
    rows = (
        long(pairs, doc, both)
        .unionByName(long(alone_g, doc, [cell(F.col(q), fn=one) for q in qualifiers]))
        .unionByName(long(alone_p, doc, [cell(F.col(q), fp=one) for q in qualifiers]))
    )
    out = _sums(rows, [doc, "label"], F.col("tp"), F.col("fp"), F.col("fn"))
    return by_qualifier(out, doc) if by_name else out


def by_qualifier(counts: DataFrame, doc: str = "source") -> DataFrame:
    """Counts of ``Name_value`` labels added up per ``Name``."""
    named = counts.withColumn("label", F.substring_index("label", "_", 1))
    return _sums(named, [doc, "label"], F.col("tp"), F.col("fp"), F.col("fn"))


def add_overall(counts: DataFrame, label: str = "label", name: str = "Overall") -> DataFrame:
    """Counts with the sum of all labels as one more label."""
    keys = [c for c in counts.columns if c not in (label, "tp", "fp", "fn")]
    total = _sums(counts, keys, F.col("tp"), F.col("fp"), F.col("fn")).withColumn(label, F.lit(name))
    return counts.unionByName(total)


def prf(counts: DataFrame) -> DataFrame:
    """Counts with entity number, precision, recall and F1 in percent.

    Without a denominator precision and recall are 100 if nothing was found, F1 is 0 if both are.
    """
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def share(whole):
        return F.when(whole != 0, tp / whole * 100).otherwise(F.when(tp == 0, 100.0).otherwise(0.0))

    df = counts.withColumns({"n_entity": tp + fn, "precision": share(tp + fp), "recall": share(tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", F.when(p + r != 0, 2 * (p * r) / (p + r)).otherwise(0.0))


def normalisation_counts(
    df: DataFrame, by: Sequence[str] = ("source",), hierarchical: bool = False, pred: str = "label", gold: str = "annotation"
) -> DataFrame:
    """Code scores per group: TP where the sets meet, FN the rest, FP the rest with a prediction."""
    hit = codes_hit(pred, gold, hierarchical)
    empty = F.coalesce(F.size(pred), F.lit(0)) < 1
    out = df.groupBy(*by).agg(
        F.count_if(hit).alias("tp"), F.count_if(~hit & ~empty).alias("fp"), F.count_if(~hit).alias("fn")
    )
    return out


def end_to_end_counts(
    gold: DataFrame, pred: DataFrame, hierarchical: bool = False, key: str = "source", gold_rows: bool = False
) -> DataFrame:
    """Span and code scores per document.

    A prediction at a gold span with a right code is a TP, with wrong codes both FP and FN,
    elsewhere FP; a gold span without prediction is FN. ``gold_rows`` adds the number of gold
    rows (``n_gold``).
    """
    at = [key, *SPAN]
    pairs = gold.select(*at, F.explode("annotation").alias("code")).distinct()
    spans = pairs.groupBy(*at).agg(F.collect_set("code").alias("_codes"))
    joined = pred.join(spans, at, "left")
    known = F.col("_codes").isNotNull()
    hit = known & codes_hit("label", "_codes", hierarchical)
    of_pred = joined.select(
        key,
        F.when(hit, 1).otherwise(0).alias("tp"),
        F.when(hit, 0).otherwise(1).alias("fp"),
        F.when(known & ~hit, 1).otherwise(0).alias("fn"),
        F.lit(0).alias("n_gold"),
    )
    seen = pred.select(*at, F.lit(True).alias("_seen")).distinct()
    of_gold = gold.join(seen, at, "left").select(
        key, F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("_seen"), 0).otherwise(1).alias("fn"), F.lit(1).alias("n_gold")
    )
    rows = of_pred.unionByName(of_gold)
    out = rows.groupBy(key).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "n_gold")])
    return out if gold_rows else out.drop("n_gold")


def value_counts(gold: DataFrame, pred: DataFrame, strict: bool = False, key: str = "source", value: str = "value") -> DataFrame:
    """Measurement scores per document, on overlapping spans.

    A prediction that overlaps a gold span with its value is a TP, with other values an FP;
    one that overlaps none is left out (an FP with ``strict``). A gold span no prediction
    overlaps is an FN.
    """
    cols = [key, *SPAN, value]
    g = gold.groupBy(*cols).agg(F.count("*").alias("n"))
    p = pred.groupBy(*cols).agg(F.count("*").alias("n"))
    pairs = overlap_join(p, g.drop("n"), key, b_suffix="_g")
    judged = pairs.groupBy(*cols, "n").agg(F.coalesce(F.bool_or(F.col(value) == F.col(value + "_g")), F.lit(False)).alias("hit"))
    z = F.lit(0)
    rows = judged.select(key, F.when(F.col("hit"), F.col("n")).otherwise(z).alias("tp"), F.when(F.col("hit"), z).otherwise(F.col("n")).alias("fp"), z.alias("fn"))
    found = pairs.select(*[F.col(c + "_g").alias(c) for c in cols]).distinct()

    def without(df, hits):
        same = [df[c].eqNullSafe(hits[c]) for c in cols]
        return df.join(hits, same, "left_anti")

    rows = rows.unionByName(without(g, found).select(key, z.alias("tp"), z.alias("fp"), F.col("n").alias("fn")))
    if strict:
        lonely = without(p, pairs.select(*cols).distinct())
        rows = rows.unionByName(lonely.select(key, z.alias("tp"), F.col("n").alias("fp"), z.alias("fn")))
    return _sums(rows, [key], F.col("tp"), F.col("fp"), F.col("fn"))


def error_taxonomy(annotations: DataFrame) -> DataFrame:
    """Reasons for missed results: distinct stays per (disease, concept, error type) and in total.

    annotations (disease, concept, stay, source, span, label, comment); gold entities carry
    the label ``BIO_gold``, predictions any other.
    """
    # Reviewer comments and the names of the error types.
    near, none = ["infra seuil, non significatif", "neg"], "pas de mention"
    said = F.coalesce(F.col("comment"), F.lit(""))
    a = annotations.withColumn("_said", said)
    cols = ["stay", "source", "concept", "disease"]

    def kind(df, name):
        return df.select(*cols, F.lit(name).alias("error_type"))

    open_gold = a.where((F.col("label") == "BIO_gold") & ~F.col("_said").isin([*near, none]))
    preds = a.where(F.col("label") != "BIO_gold")
    same_doc = preds.select("span", "source", "disease").distinct()
    same_any = preds.select("span", "source").distinct()
    errors = (
        kind(a.where(F.col("_said").isin(near)), "Close to threshold")
        .unionByName(kind(a.where(F.col("_said") == none), "No mention"))
        .unionByName(kind(open_gold.join(same_doc, ["span", "source", "disease"], "left_anti"), "NER fails"))
        .unionByName(kind(open_gold.join(same_any, ["span", "source"], "left_semi"), "Norm fails"))
    )
    per_type = errors.groupBy("disease", "concept", "error_type").agg(F.count_distinct("stay").alias("stays"))
    total = a.groupBy("disease", "concept").agg(F.count_distinct("stay").alias("total_stays"))
    return per_type.join(total, ["disease", "concept"])


METRICS = ("precision", "recall", "f1")


def long_scores(df: DataFrame, ids: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per metric; texts such as ``v [lo-hi]`` are read back as three numbers."""
    long = df.unpivot(list(ids), list(metrics), "metric", "summary")
    if dict(df.dtypes)[metrics[0]] != "string":
        return long
    pattern = r"^(-?[\d.]+)\s*\[(-?[\d.]+)\s*[-,]\s*(-?[\d.]+)\]$"
    parts = {n: F.regexp_extract("summary", pattern, i).try_cast("double") for i, n in enumerate(["value", "lower", "upper"], 1)}
    return long.withColumns(parts)


def wide_scores(long: DataFrame, ids: Sequence[str], column: str, values: Sequence[str], cell: str = "summary") -> DataFrame:
    """Metrics side by side, one column per (value, metric)."""
    return long.groupBy(*ids).pivot(column, list(values)).agg(F.max(cell))


def flag_best(df: DataFrame, by: Sequence[str], value: str = "value", name: str = "best") -> DataFrame:
    """True where a row reaches the greatest value of its group."""
    w = Window.partitionBy(*by)
    return df.withColumn(name, F.col(value) == F.max(value).over(w))
