"""Laboratory mention parsing."""

from pyspark.sql import functions as F

from chartloom.catalog.registry import query
from chartloom.functions import labpatterns as P
from chartloom.functions.text import span_bounds, sorted_tokens
from chartloom.operators import measure as M
from chartloom.operators.spans import containment_join


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sub(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(to.replace('$', chr(92)))}, 'g')"


def chain(expr: str, rules) -> str:
    for pattern, to in rules:
        expr = sub(expr, pattern, to)
    return expr


def fold(expr: str) -> str:
    return f"translate(lower({expr}), {q(P.ACCENTS[0])}, {q(P.ACCENTS[1])})"


def plain_sql(expr: str) -> str:
    """A written number as plain decimal text, null if it is none."""
    dotted = f"case when contains({expr}, '.') then {expr} else {expr} || '.' end"
    cut = f"regexp_replace(regexp_replace({dotted}, '0+$', ''), '[.]$', '.0')"
    led = f"regexp_replace(regexp_replace({cut}, '^0+', ''), '^[.]', '0.')"
    return f"case when regexp_matches({expr}, '^[0-9]*[.]?[0-9]*$') and regexp_matches({expr}, '[0-9]') then {led} end"


def noise(expr: str) -> str:
    return chain(sub(expr, r"^\s+|\s+$", ""), P.MENTION_NOISE)


# --- the parse as a chain of check expressions -------------------------------------------------
_MARKS = [(P.FOOTNOTE, " "), (P.ELLIPSIS, " "), (P.SUPERSCRIPT, " ")]
_ANY_FAMILY = "|".join(P.QUALITATIVE.values())

LINKED = f""", outer_e as (select distinct * from entity where label = 'BIO_comp'),
inner_e as (select distinct * from entity where label in ('BIO', 'BIO_Val')),
linked as (select o.source, o.span_start, o.span_end, o.term as term_biocomp, i.term as term_bio,
   i.span_start as span_start_bio, i.span_end as span_end_bio,
   {chain('o.lexical_variant', _MARKS)} as lv, {chain('i.lexical_variant', _MARKS)} as lv_bio
   from outer_e o left join inner_e i
   on o.source = i.source and o.span_start <= i.span_start and o.span_end >= i.span_end)"""
_RENAMED = chain("trim(replace(lv, coalesce(lv_bio, ''), ' '))", [(P.GIGA_PER_LITRE, P.GIGA_PER_LITRE_UNIT)])
STRIPPED = LINKED + f""",
s2 as (select *, case when coalesce(lv_bio, '') = '' then {chain('trim(lv)', [(P.GIGA_PER_LITRE, P.GIGA_PER_LITRE_UNIT)])}
   else {_RENAMED} end as rest from linked)"""
DATED = STRIPPED + f""",
s3 as (select * exclude (rest), regexp_extract(lv, {q(P.DATE)}, 1) as extracted_date, {sub('rest', P.DATE, '')} as rest from s2)"""
RANGED = DATED + f""",
s4 as (select * exclude (rest), nullif({sub(f"regexp_extract(rest, {q(P.RANGE)}, 1)", P.NOT_RANGE_CHAR, '')}, '') as range_value,
   {sub('rest', P.RANGE, ' ')} as rest from s3)"""
_LOW = f"translate(lower({chain('rest', [('⁹', ' '), ('m²', 'm2'), ('m³', 'm3')])}), {q(P.SUPERSCRIPT_DIGITS[0])}, {q(P.SUPERSCRIPT_DIGITS[1])})"
CLEANED = RANGED + f""",
s5 as (select * exclude (rest), {noise(fold(chain(_LOW, [('à', '='), (':', ' ')])))} as rest from s4)"""
QUALIFIED = CLEANED + f""",
s6 as (select * exclude (rest), nullif({sub(f"regexp_extract(rest, {q(_ANY_FAMILY)}, 0)", P.NOT_QUALITATIVE_CHAR, '')}, '') as non_digit_value,
   {sub('rest', _ANY_FAMILY, ' ')} as rest from s5)"""
UNITED = QUALIFIED + f""",
s7a as (select * exclude (rest), {chain('rest', [*P.UNIT_SPELLING, (P.POWER_UNIT_GLUED, '$1 $2'), (P.UNIT_GLUED, '$1 $2')])} as rest from s6),
s7b as (select * exclude (rest), trim(lower(replace(regexp_extract(rest, {q(P.UNIT)}, 1), ' ', '')), {q(P.UNIT_EDGE)}) as u,
   {sub('rest', P.UNIT, ' ')} as rest from s7a),
s7 as (select * exclude (u), nullif(case when contains(u, '%') then '%' else u end, '') as unit from s7b)"""
VALUED = UNITED + f""",
s8a as (select * exclude (rest), {sub(f"regexp_extract(rest, {q(P.VALUE)}, 1)", P.NOT_VALUE_CHAR, '')} as v, {sub('rest', P.VALUE, ' ')} as rest from s7),
s8 as (select * exclude (v), nullif(case when regexp_matches(v, '[<>/]') then v
   else coalesce({plain_sql("replace(v, ',', '.')")}, v) end, '') as value_cleaned from s8a)"""
_NAME = f"case when lv_bio <> '' then lv_bio else regexp_extract(rest, {q(P.FIRST_WORD)}, 1) end"
PARSED = VALUED + f""",
s9 as (select *, trim({chain(noise(fold(_NAME)), [(r'\bsur\b', '/'), ('[<>-]', ' ')])}) as nm from s8),
parsed as (select source, span_start, span_start_bio, span_end, span_end_bio, term_biocomp, term_bio,
   rest as lexical_variant_stripped, range_value, non_digit_value, unit,
   {sub('nm', P.SPECIMEN, ' ')} as lexical_variant, value_cleaned, extracted_date,
   regexp_extract(nm, {q(P.SPECIMEN)}, 1) as fluid_source from s9)"""


def _sides(t):
    return M.split_by_label(t.entity, "BIO_comp", ["BIO", "BIO_Val"])


def _linked(t):
    return M.link_mentions(*_sides(t))


@query(
    "label_split",
    "B9",
    "entity",
    """select source, term, span_start, span_end, case label when 'BIO_comp' then 'outer' else 'inner' end as stream
       from entity where label in ('BIO_comp', 'BIO', 'BIO_Val')""",
)
def label_split(t):
    outer, inner = _sides(t)
    cols = ["source", "term", "span_start", "span_end"]
    return outer.select(*cols, F.lit("outer").alias("stream")).unionByName(
        inner.select(*cols, F.lit("inner").alias("stream"))
    )


@query(
    "containment_join",
    "C4 B18 G3",
    "mention inner_mention",
    """select o.source, o.span_start, o.span_end, o.term, i.term as term_inner, coalesce(i.span_start, -1) as span_start_inner
       from mention o left join inner_mention i
       on o.source = i.source and o.span_start <= i.span_start and o.span_end >= i.span_end""",
)
def containment(t):
    return containment_join(t.mention, t.inner_mention).select(
        "source", "span_start", "span_end", "term", "term_inner", F.coalesce("span_start_inner", F.lit(-1)).alias("span_start_inner")
    )


def _step(name, ids, ctes, cols, steps):
    """Register one parsing step: the columns it writes, next to the mention's key."""
    keys = ["source", "span_start", "span_end", "term_biocomp", "term_bio"]
    sql_cols = ", ".join(keys + [f"{s} as {c}" for s, c in cols])

    @query(name, ids, "entity", f"{ctes[0]} select {sql_cols} from {ctes[1]}")
    def build(t):
        df = _linked(t)
        for s in steps:
            df = df.transform(s)
        return df.select(*keys, *[c for _, c in cols])


_step("footnote_marks", "H1", (LINKED, "linked"), [("lv", "lexical_variant_biocomp"), ("lv_bio", "lexical_variant_bio")], [])
_ALL = [
    ("inner_name_removed", "H2", (STRIPPED, "s2"), [("rest", M.REST)], M.remove_inner),
    ("mention_dates", "H3", (DATED, "s3"), [("extracted_date", "extracted_date"), ("rest", M.REST)], M.extract_date),
    ("reference_ranges", "H4", (RANGED, "s4"), [("range_value", "range_value"), ("rest", M.REST)], M.extract_range),
    ("mention_cleaning", "H5", (CLEANED, "s5"), [("rest", M.REST)], M.clean_mention),
    ("qualitative_values", "H6", (QUALIFIED, "s6"), [("non_digit_value", "non_digit_value"), ("rest", M.REST)], M.extract_qualitative),
    ("units", "H7", (UNITED, "s7"), [("unit", "unit"), ("rest", M.REST)], M.extract_unit),
    ("numeric_values", "H8", (VALUED, "s8"), [("value_cleaned", "value_cleaned"), ("rest", M.REST)], M.extract_value),
    ("test_names_and_specimen", "H9 H10", (PARSED, "s9"), [("nm", "lexical_variant")], M.extract_name),
]
for _i, (_n, _ids, _ctes, _cols, _s) in enumerate(_ALL):
    _step(_n, _ids, _ctes, _cols, [x[4] for x in _ALL[: _i + 1]])


@query("parsed_measurements", "H11 H9 B15", "entity", PARSED
    + """ select * replace (coalesce(span_start_bio, -1) as span_start_bio, coalesce(span_end_bio, -1) as span_end_bio)
       from parsed""")
def parsed(t):
    # -1 for "no inner mention", so that the two engines print the column alike
    return M.parse_measurements(*_sides(t)).na.fill(-1, ["span_start_bio", "span_end_bio"])


_FAMILY_SQL = "case " + " ".join(f"when regexp_matches(non_digit_value, {q(p)}) then {q(name)}" for name, p in P.QUALITATIVE.items()) + " end"


@query(
    "qualitative_families",
    "H6",
    "entity",
    PARSED
    + f""" select non_digit_value, {_FAMILY_SQL} as family,
       cast(count(*) as bigint) as n from parsed where non_digit_value is not null group by 1, 2""",
)
def families(t):
    return (
        M.parse_measurements(*_sides(t))
        .where(F.col("non_digit_value").isNotNull())
        .groupBy("non_digit_value", M.qualitative_family("non_digit_value").alias("family"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "span_text_bounds",
    "B10",
    "mention",
    """select source, cast(span_start as string) || ' ' || cast(span_start + 3 as string) || ';' ||
         cast(span_start + 5 as string) || ' ' || cast(span_end as string) as span, span_start, span_end from mention""",
)
def span_text_bounds(t):
    span = F.concat_ws(
        ";",
        F.concat_ws(" ", "span_start", (F.col("span_start") + 3).cast("string")),
        F.concat_ws(" ", (F.col("span_start") + 5).cast("string"), "span_end"),
    )
    df = t.mention.select("source", span.alias("span"))
    start, end = span_bounds("span")
    return df.withColumns({"span_start": start, "span_end": end})


@query(
    "sorted_tokens",
    "H12",
    "",
    """select p_partkey, array_to_string(list_sort(string_split(p_type || ' ' || p_name, ' ')), ' ') as tokens from part""",
)
def tokens(t):
    return t.part.select("p_partkey", sorted_tokens(F.concat_ws(" ", "p_type", "p_name")).alias("tokens"))
