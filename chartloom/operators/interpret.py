"""Clinical reading of parsed measurements: bounds, numbers, positivity, canonical text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions import labpatterns as P
from chartloom.functions.text import empty_to_null, plain_decimal
from chartloom.operators.measure import clean_value


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _number(c) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def first_number(c) -> Column:
    return _number(empty_to_null(F.regexp_extract(_col(c), P.FIRST_NUMBER, 1)))


def range_bounds(c, one_sided: bool = True) -> tuple[Column, Column]:
    """Lower and upper bound of a range text such as ``12-16``.

    ``>a`` sets a lower and ``<b`` an upper bound; ``one_sided=False`` leaves both empty then.
    """
    c = _col(c)
    parts = F.split(c, "[-–]")
    two = F.size(parts) == 2
    lower = F.when(two, _number(parts[0]))
    upper = F.when(two, _number(F.element_at(F.split(c, "[-–<>]"), -1)))
    if one_sided:
        lower = F.coalesce(lower, F.when(~two & c.contains(">"), first_number(c)))
        upper = F.coalesce(upper, F.when(~two & c.contains("<"), first_number(c)))
    return lower, upper


def out_of_range(value, lower, upper, range_text) -> Column:
    """Below the lower or above the upper bound; null without a value or a range."""
    value, known = _col(value), _col(value).isNotNull() & _col(range_text).isNotNull()
    beyond = F.coalesce(value < _col(lower), F.lit(False)) | F.coalesce(value > _col(upper), F.lit(False))
    return F.when(known, beyond)


def text_polarity(c) -> tuple[Column, Column]:
    """(positive, negative): true where a qualitative result starts that way, else null."""
    c = _col(c)

    def starts(pattern):
        return F.when(c.rlike(f"^(?:{pattern})"), F.lit(True))

    return starts(P.POSITIVE_PREFIX), starts(P.NEGATIVE_PREFIX)


def interpret(df: DataFrame, one_sided: bool = True) -> DataFrame:
    """Measurements with bounds, number, out-of-range flag and text polarity."""
    lower, upper = range_bounds("range_value", one_sided)
    positive, negative = text_polarity("non_digit_value")
    df = df.withColumns({"lower_bound": lower, "upper_bound": upper, "value_as_number": F.coalesce(_number(F.col("value_cleaned")), first_number("value_cleaned"))})
    return df.withColumns(
        {
            "positive_value": out_of_range("value_as_number", "lower_bound", "upper_bound", "range_value"),
            "positive_text": positive,
            "negative_text": negative,
        }
    )


def is_positive_text() -> Column:
    """Positive wording, a value out of range, or a result about which nothing is known."""
    unknown = F.col("negative_text").isNull() & F.col("positive_text").isNull() & F.col("positive_value").isNull()
    return F.coalesce("positive_text", F.lit(False)) | F.coalesce("positive_value", F.lit(False)) | unknown


def is_positive_structured(value: str = "nval_num", limit: str = "confidence_num", text: str = "tval_char") -> Column:
    """Above the upper limit, or a text result that says positive or present."""
    words = F.lower(text)
    said = F.coalesce(words.contains("posi") | words.contains("présence"), F.lit(False))
    return F.coalesce(F.col(value) > F.col(limit), F.lit(False)) | said


def qualifier_filter(
    df: DataFrame, min_score: float | None = 0.9, certain: bool = True, not_negated: bool = True
) -> DataFrame:
    """Mentions that are not negated, certain, and above a score. A missing negation passes."""
    if not_negated:
        df = df.where(~F.col("Negation").eqNullSafe("Neg"))
    if certain:
        df = df.where(F.col("Certainty") == "Certain")
    if min_score:
        df = df.where(F.col("score") > min_score)
    return df


def unit_table(spark: SparkSession, config: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(concept, unit, rate, final_unit) of a ``concept → unit → rate`` mapping.

    The first unit of a concept is the one values are converted to (``ratio`` for no unit). Marked for broadcast: it is as
    long as the mapping, and a join that moves all results by their concept fills a task per concept.
    """
    rows = []
    for concept, rates in config.items():
        final = "ratio" if next(iter(rates)) == "nounit" else next(iter(rates))
        rows += [(concept, unit, float(rate), final) for unit, rate in rates.items()]
    return F.broadcast(spark.createDataFrame(rows, "concept string, unit string, rate double, final_unit string"))


def limit_table(spark: SparkSession, limits: Mapping[str, float]) -> DataFrame:
    """(concept, max_value) of a mapping, marked for broadcast as ``unit_table`` is."""
    return F.broadcast(spark.createDataFrame([(k, float(v)) for k, v in limits.items()], "concept string, max_value double"))


def convert_units(df: DataFrame, rates: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose unit the concept's table knows (case ignored), in the concept's unit."""
    df = df.withColumn("unit", F.lower("unit")).join(rates, ["concept", "unit"])
    return df.withColumns({value: F.col(value) * F.col("rate"), "unit": F.col("final_unit")}).drop("rate", "final_unit")


def plausible(df: DataFrame, limits: DataFrame, value: str = "value") -> DataFrame:
    """Rows with ``0 ≤ value ≤ max`` of their concept."""
    joined = df.join(limits, "concept")
    return joined.where(F.col(value).between(F.lit(0), F.col("max_value"))).drop("max_value")


def _prefixes(words: Sequence[str]) -> list[str]:
    out = []
    for w in words:
        out += [w[:i] for i in range(min(2, len(w)), len(w) + 1)]
    return out


def _says(words: Sequence[str], signs: Sequence[str]) -> str:
    # A sign, or a word or its beginning, alone between characters that are no letters.
    return r"^[^a-zA-Z0-9]*(?:" + "|".join([*signs, *_prefixes(words)]) + r")[^a-zA-Z0-9]*$"


SAYS_POSITIVE = _says(P.POSITIVE_WORDS, P.POSITIVE_SIGNS)
SAYS_NEGATIVE = _says(P.NEGATIVE_WORDS, P.NEGATIVE_SIGNS)
SAYS_NORMAL = _prefixes(P.NORMAL_WORDS)


def canonical_measurement(value, unit, word) -> Column:
    """``value unit`` as one text, else ``0 bool`` / ``1 bool`` / ``0.5 bool`` from a word; null if neither.

    A value without a unit gets the unit ``nounit``.
    """
    number = plain_decimal(value)
    measured = F.when(number.isNotNull(), F.concat_ws(" ", number, F.coalesce(_col(unit), F.lit("nounit"))))
    w = _col(word)
    said = (
        F.when(w.rlike(SAYS_NEGATIVE), F.lit("0 bool"))
        .when(w.rlike(SAYS_POSITIVE), F.lit("1 bool"))
        .when(w.isin(SAYS_NORMAL), F.lit("0.5 bool"))
    )
    return F.coalesce(measured, said)


def canonical_annotation(c) -> Column:
    """Canonical measurement of a written annotation such as ``12 g/dl`` or ``neg``.

    The text after the last ``_`` counts; value and unit are read with the mention grammar.
    """
    text = F.lower(F.regexp_replace(F.trim(F.substring_index(_col(c), "_", -1)), P.GIGA_PER_LITRE, P.GIGA_PER_LITRE_UNIT))
    unit = empty_to_null(F.lower(F.regexp_extract(text, P.UNIT, 1)))
    rest = F.regexp_replace(text, P.UNIT, " ")
    value = clean_value(F.regexp_extract(rest, P.VALUE, 1))
    return canonical_measurement(value, unit, text)
