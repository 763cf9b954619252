"""Laboratory mentions to value, unit, range, date, specimen and name.

Each step reads ``lexical_variant_stripped`` (what is left of the mention), writes one
column and removes what it found. All steps are built-in expressions, so the whole parse
runs in one stage after the containment join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import labpatterns as P
from chartloom.functions.text import (
    beyond_ascii,
    empty_to_null,
    extract_if,
    fold_accents,
    holds,
    named,
    plain_decimal,
    replace_all,
    replace_held,
    strip_space,
    translate_beyond_ascii,
)
from chartloom.operators.spans import PLACE, containment_join

REST = "lexical_variant_stripped"

FOUND = "_found"

MEASUREMENT_COLUMNS = [
    "source",
    "span_start",
    "span_start_bio",
    "span_end",
    "span_end_bio",
    "term_biocomp",
    "term_bio",
    "lexical_variant_stripped",
    "range_value",
    "non_digit_value",
    "unit",
    "lexical_variant",
    "value_cleaned",
    "extracted_date",
    "fluid_source",
]


def split_by_label(entities: DataFrame, outer: str, inner: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Complete mentions and the mentions inside them."""
    return entities.where(F.col("label") == outer), entities.where(F.col("label").isin(list(inner)))


def link_mentions(outer: DataFrame, inner: DataFrame, placed: bool = False) -> DataFrame:
    """Complete mentions with the inner mentions they contain, cleaned of footnote marks; ``placed`` as in the join."""
    outer = outer.withColumnsRenamed({"lexical_variant": "lexical_variant_biocomp", "term": "term_biocomp"})
    linked = containment_join(outer, inner, inner_suffix="_bio", placed=placed)
    clean = [(P.FOOTNOTE, " "), (P.ELLIPSIS, " "), (P.SUPERSCRIPT, " ")]
    return linked.withColumns(
        {
            "lexical_variant_biocomp": replace_held("lexical_variant_biocomp", clean, P.NEEDED),
            "lexical_variant_bio": replace_held("lexical_variant_bio", clean, P.NEEDED),
        }
    )


def remove_inner(df: DataFrame) -> DataFrame:
    """The mention without its inner name; a mention without one keeps its text."""
    rest = F.trim(
        F.replace(F.col("lexical_variant_biocomp"), F.coalesce("lexical_variant_bio", F.lit("")), F.lit(" "))
    )
    return df.withColumn(REST, replace_held(rest, [(P.GIGA_PER_LITRE, P.GIGA_PER_LITRE_UNIT)], P.NEEDED))


def extract_date(df: DataFrame) -> DataFrame:
    """First date of the whole mention (empty text if none); dates leave the residue."""
    return df.withColumns(
        {
            "extracted_date": F.regexp_extract("lexical_variant_biocomp", P.DATE_SEARCH, 1),
            REST: F.regexp_replace(REST, P.DATE_SEARCH, ""),
        }
    )


def if_found(then, otherwise) -> Column:
    """``then`` where a step found something, what it was otherwise: no pattern here matches empty text."""
    return F.when(F.col(FOUND) == "", otherwise).otherwise(then)


def extract_range(df: DataFrame) -> DataFrame:
    """Reference range as digits, signs and separators; null if none."""
    df = df.withColumn(FOUND, extract_if(REST, holds(REST, P.RANGE_NEEDS), P.RANGE_SEARCH, 1))
    return df.withColumns(
        {
            "range_value": empty_to_null(if_found(F.regexp_replace(FOUND, P.NOT_RANGE_CHAR, ""), F.col(FOUND))),
            REST: if_found(F.regexp_replace(REST, P.RANGE_SEARCH, " "), F.col(REST)),
        }
    ).drop(FOUND)


def drop_noise(c) -> Column:
    # Beyond ASCII there are line ends that ``$`` knows and trimming does not.
    edges = lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r"))
    c = named(c, lambda x: F.when(beyond_ascii(x), strip_space(x)).otherwise(edges(x)))
    return replace_held(c, P.MENTION_NOISE, P.NEEDED)


def clean_mention(df: DataFrame) -> DataFrame:
    """Residue in lower case without accents, superscripts, colons and filler words."""
    text = replace_held(REST, [("⁹", " "), ("m²", "m2"), ("m³", "m3")], P.NEEDED)
    text = translate_beyond_ascii(F.lower(text), P.SUPERSCRIPT_DIGITS)
    text = fold_accents(replace_held(text, [("à", "="), (r"(\:)", " ")], P.NEEDED))
    return df.withColumn(REST, drop_noise(text))


def extract_qualitative(df: DataFrame, canonical: str = "none") -> DataFrame:
    """Qualitative result as written; null if none.

    ``canonical="all"`` writes every family by its own name before the match;
    ``"last"`` does so for the last family only; ``"none"`` keeps the wording.
    """
    families = {"none": [], "last": ["hemolyse"], "all": list(P.QUALITATIVE)}[canonical]
    text = replace_all(REST, [(P.QUALITATIVE[name], name) for name in families])
    df = df.withColumn(REST, text)
    may = named(F.lower(REST), lambda x: holds(x, P.QUALITATIVE_NEEDS)) | F.rlike(F.col(REST), F.lit(P.QUALITATIVE_EDGE))
    df = df.withColumn(FOUND, extract_if(REST, may, P.QUALITATIVE_SEARCH, 0))
    return df.withColumns(
        {
            "non_digit_value": empty_to_null(if_found(F.regexp_replace(FOUND, P.NOT_QUALITATIVE_CHAR, ""), F.col(FOUND))),
            REST: if_found(F.regexp_replace(REST, P.QUALITATIVE_SEARCH, " "), F.col(REST)),
        }
    ).drop(FOUND)


def qualitative_family(c) -> Column:
    """Name of the first family a qualitative result belongs to."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in P.QUALITATIVE.items():
        out = out.when(c.rlike(pattern), F.lit(name))
    return out


def extract_unit(df: DataFrame) -> DataFrame:
    """Unit in one spelling; null if none."""
    text = replace_held(REST, P.UNIT_SPELLING, P.NEEDED)
    df = df.withColumn(REST, replace_held(text, [(P.POWER_UNIT_GLUED, "$1 $2"), (P.UNIT_GLUED_SEARCH, "$1 $2")], P.NEEDED))
    df = df.withColumn(FOUND, F.regexp_extract(REST, P.UNIT_SEARCH, 1))
    unit = F.btrim(F.lower(F.replace(FOUND, F.lit(" "), F.lit(""))), F.lit(P.UNIT_EDGE))
    unit = F.when(unit.contains("%"), F.lit("%")).otherwise(unit)
    return df.withColumns(
        {"unit": empty_to_null(unit), REST: if_found(F.regexp_replace(REST, P.UNIT_SEARCH, " "), F.col(REST))}
    ).drop(FOUND)


def clean_value(c) -> Column:
    """A number as plain decimal text; comparisons and fractions as written; null if empty."""
    kept = F.regexp_replace(c, P.NOT_VALUE_CHAR, "")
    plain = lambda x: F.when(holds(x, "<>/"), x).otherwise(F.coalesce(plain_decimal(x), x))
    return empty_to_null(named(kept, plain))


def extract_value(df: DataFrame) -> DataFrame:
    """First value of the residue, raw (``value``) and cleaned (``value_cleaned``)."""
    df = df.withColumn(FOUND, F.regexp_extract(REST, P.VALUE_SEARCH, 1))
    return df.withColumns(
        {
            "value": F.col(FOUND),
            "value_cleaned": clean_value(F.col(FOUND)),
            REST: if_found(F.regexp_replace(REST, P.VALUE_SEARCH, " "), F.col(REST)),
        }
    ).drop(FOUND)


def extract_name(df: DataFrame) -> DataFrame:
    """Test name: the inner mention, else the first word of the residue."""
    inner = F.col("lexical_variant_bio")
    name = F.when(inner != "", inner).otherwise(F.regexp_extract(REST, P.FIRST_WORD, 1))
    name = replace_held(drop_noise(fold_accents(name)), [(r"\bsur\b", "/"), ("[<>-]", " ")], P.NEEDED)
    return df.withColumn("lexical_variant", F.trim(name))


def extract_specimen(df: DataFrame) -> DataFrame:
    """Specimen named in the test name (empty text if none), which then leaves the name."""
    return df.withColumns(
        {
            "fluid_source": F.regexp_extract("lexical_variant", P.SPECIMEN, 1),
            "lexical_variant": F.regexp_replace("lexical_variant", P.SPECIMEN, " "),
        }
    )


def parse_texts(texts: DataFrame, canonical: str = "none") -> DataFrame:
    """All extraction steps on (lexical_variant_biocomp, lexical_variant_bio) rows."""
    return (
        remove_inner(texts)
        .transform(extract_date)
        .transform(extract_range)
        .transform(clean_mention)
        .transform(extract_qualitative, canonical)
        .transform(extract_unit)
        .transform(extract_value)
        .transform(extract_name)
        .transform(extract_specimen)
    )


def parse_measurements(outer: DataFrame, inner: DataFrame, canonical: str = "none", placed: bool = False) -> DataFrame:
    """All steps: one row per complete mention and inner mention, fifteen columns.

    One containment join; the parse follows in the same stage, as a projection. ``placed`` adds the block of the mention
    (``spans.PLACE``), for steps that go on with rows of one mention where the join left them.
    """
    # The parsed name replaces the column of that name that the join brought.
    parsed = parse_texts(link_mentions(outer, inner, placed).drop("lexical_variant"), canonical)
    return parsed.select(*MEASUREMENT_COLUMNS, *(PLACE if placed else []))
