"""Clinical interpretation, patient flags and source comparison."""

from pyspark.sql import functions as F

from chartloom.catalog.measure_queries import PARSED, plain_sql
from chartloom.catalog.registry import query
from chartloom.functions import labpatterns as P
from chartloom.operators import interpret as I
from chartloom.operators import measure as M
from chartloom.operators import quantiles as Q
from chartloom.operators import rollup as R
from chartloom.functions.text import drop_extension, note_id_from_source

CONCEPTS = ["Hemoglobin", "CRP", "Anti-DNA"]
RATES = {"Hemoglobin": {"g/dl": 1, "mg/dl": 0.001}, "CRP": {"mg/l": 1, "mg_per_l": 1, "mg/dl": 10}}
LIMITS = {"Hemoglobin": 30, "CRP": 300}

INTERPRETED = f""", b as (select *,
    try_cast(case when len(string_split(range_value, '-')) = 2 then replace(split_part(range_value, '-', 1), ',', '.')
      when contains(range_value, '>') then replace(regexp_extract(range_value, '{P.FIRST_NUMBER}', 1), ',', '.') end as double) as lower_bound,
    try_cast(case when len(string_split(range_value, '-')) = 2 then replace(split_part(range_value, '-', 2), ',', '.')
      when contains(range_value, '<') then replace(regexp_extract(range_value, '{P.FIRST_NUMBER}', 1), ',', '.') end as double) as upper_bound,
    coalesce(try_cast(replace(value_cleaned, ',', '.') as double),
      try_cast(replace(nullif(regexp_extract(value_cleaned, '{P.FIRST_NUMBER}', 1), ''), ',', '.') as double)) as value_as_number
    from text_result),
  i as (select *, case when value_as_number is null or range_value is null then null
      else coalesce(value_as_number < lower_bound, false) or coalesce(value_as_number > upper_bound, false) end as positive_value,
    case when non_digit_value like 'posi%' then true end as positive_text,
    case when non_digit_value like 'nega%' then true end as negative_text from b),
  text_flags as (select patient_num, """ + ", ".join(
    f"""bool_or(concept = '{c}') as "{c}", bool_or(concept = '{c}' and (coalesce(positive_text, false) or coalesce(positive_value, false)
      or (positive_text is null and negative_text is null and positive_value is null))) as "{c} positive" """
    for c in CONCEPTS
) + """ from i group by patient_num)"""
STRUCT_FLAGS = """, struct_flags as (select patient_num, """ + ", ".join(
    f"""coalesce(bool_or(concept = '{c}'), false) as "{c}", coalesce(bool_or(concept = '{c}' and (coalesce(value > confidence_num, false)
      or coalesce(tval_char ilike '%posi%', false) or coalesce(tval_char ilike '%présence%', false))), false) as "{c} positive" """
    for c in CONCEPTS
) + """ from struct_result group by patient_num)"""


def text_flags(t):
    return R.patient_flags(I.interpret(t.text_result), CONCEPTS, I.is_positive_text())


def struct_flags(t):
    return R.patient_flags(t.struct_result, CONCEPTS, I.is_positive_structured("value"))


@query(
    "result_interpretation",
    "H25 H26 H27 H28",
    "text_result",
    INTERPRETED
    + """ select source, concept, coalesce(lower_bound, -1) as lower_bound, coalesce(upper_bound, -1) as upper_bound, coalesce(value_as_number, -1) as value_as_number,
       cast(positive_value as varchar) as positive_value, cast(positive_text as varchar) as positive_text, cast(negative_text as varchar) as negative_text from i""",
)
def result_interpretation(t):
    df = I.interpret(t.text_result)
    numbers = ["lower_bound", "upper_bound", "value_as_number"]
    flags = ["positive_value", "positive_text", "negative_text"]
    return df.na.fill(-1.0, numbers).select("source", "concept", *numbers, *[F.col(c).cast("string").alias(c) for c in flags])


@query("text_patient_flags", "D4 H29", "text_result", INTERPRETED + " select * from text_flags")
def text_patient_flags(t):
    return text_flags(t)


@query("structured_patient_flags", "D4 H30", "lab struct_result", STRUCT_FLAGS + " select * from struct_flags")
def structured_patient_flags(t):
    return struct_flags(t)


@query(
    "qualified_mentions",
    "B11",
    "drug_mention",
    "select source, span_start, term from drug_mention where (Negation is null or Negation <> 'Neg') and Certainty = 'Certain'",
)
def qualified_mentions(t):
    return I.qualifier_filter(t.drug_mention, min_score=None).select("source", "span_start", "term")


@query(
    "note_ids_from_sources",
    "B14",
    "text_result",
    """select source, split_part(split_part(source, '.', 1), '_', 1) as note_id, left(source, length(source) - 4) as stem from text_result""",
)
def note_ids_from_sources(t):
    return t.text_result.select("source", note_id_from_source("source").alias("note_id"), drop_extension("source").alias("stem"))


TESTS = [f"{c} positive" for c in CONCEPTS]


@query(
    "at_least_one_flag",
    "D5",
    "text_result",
    INTERPRETED + """ select patient_num, "Hemoglobin positive" or "CRP positive" or "Anti-DNA positive" as at_least_one from text_flags""",
)
def at_least_one_flag(t):
    return R.any_flag(text_flags(t), TESTS).select("patient_num", "at_least_one")


BOTH_NEEDS = "text_result lab struct_result"


@query(
    "combined_flags",
    "D6",
    BOTH_NEEDS,
    INTERPRETED
    + STRUCT_FLAGS
    + " select patient_num, "
    + ", ".join(f'bool_or("{c}") as "{c}"' for c in CONCEPTS + TESTS)
    + " from (select * from text_flags union all by name select * from struct_flags) group by patient_num",
)
def combined_flags(t):
    return R.combine_flags(text_flags(t), struct_flags(t))


@query(
    "flags_side_by_side",
    "C19 B18",
    BOTH_NEEDS,
    INTERPRETED
    + STRUCT_FLAGS
    + " select t.patient_num, "
    + ", ".join(f't."{c}" as "{c}_nlp", s."{c}" as "{c}_tabular"' for c in CONCEPTS + TESTS)
    + " from text_flags t join struct_flags s on t.patient_num = s.patient_num",
)
def flags_side_by_side(t):
    return R.join_flag_sources(text_flags(t), struct_flags(t))


def _compare_sql(c):
    return f"""select '{c}' as concept, count_if(coalesce(s."{c}", false)) as structured, count_if(coalesce(t."{c}", false)) as text,
      count_if(coalesce(t."{c}", false) and not s."{c}") as benefit, count_if(coalesce(t."{c}", false) or coalesce(s."{c}", false)) as both,
      count_if(s.patient_num is not null) as patients from text_flags t full join struct_flags s on t.patient_num = s.patient_num"""


@query(
    "source_comparison",
    "D10",
    BOTH_NEEDS,
    INTERPRETED
    + STRUCT_FLAGS
    + """, c as ("""
    + " union all ".join(_compare_sql(c) for c in TESTS)
    + """) select concept, cast(structured as bigint) as structured, cast(text as bigint) as text, cast(benefit as bigint) as benefit, cast("both" as bigint) as "both",
       cast(patients as bigint) as patients, round(structured / patients * 100, 1) as structured_pct, round(text / patients * 100, 1) as text_pct,
       round(benefit / patients * 100, 1) as benefit_pct, round("both" / patients * 100, 1) as both_pct from c""".replace('as both,', 'as "both",'),
)
def source_comparison(t):
    return R.source_comparison(text_flags(t), struct_flags(t), TESTS)


@query(
    "flag_regions",
    "D11 D30",
    "text_result",
    INTERPRETED
    + """, r as (select "Hemoglobin positive" as a, "CRP positive" as b, "Anti-DNA positive" as c, cast(count(*) as bigint) as n from text_flags group by 1, 2, 3),
       w as (select *, cast(sum(n) over () as bigint) as total_patients, cast(sum(case when a or b or c then n else 0 end) over () as bigint) as total_positive from r)
       select *, round(n / total_patients * 100, 1) as pct from w where a or b or c""",
)
def flag_regions(t):
    out = R.set_regions(text_flags(t), TESTS)
    return out.withColumnsRenamed(dict(zip(TESTS, "abc")))


@query(
    "positive_share",
    "D30",
    "text_result",
    INTERPRETED
    + """ select count(distinct case when "CRP positive" or "Anti-DNA positive" then patient_num end) as total_positive, count(distinct patient_num) as total_patients,
       round(count(distinct case when "CRP positive" or "Anti-DNA positive" then patient_num end) / count(distinct patient_num) * 100, 1) as pct from text_flags""",
)
def positive_share(t):
    return R.positive_share(text_flags(t), TESTS[1:])


VALUES = INTERPRETED + """, rates as (select * from (values ('Hemoglobin', 'g/dl', 1.0::double, 'g/dl'), ('Hemoglobin', 'mg/dl', 0.001::double, 'g/dl'),
      ('CRP', 'mg/l', 1.0::double, 'mg/l'), ('CRP', 'mg_per_l', 1.0::double, 'mg/l'), ('CRP', 'mg/dl', 10.0::double, 'mg/l')) v(concept, unit, rate, final_unit)),
  limits as (select * from (values ('Hemoglobin', 30.0::double), ('CRP', 300.0::double)) v(concept, max_value)),
  x as (select patient_num, concept, lower(unit) as unit, value_as_number as value, 'NLP' as method from i
        union all select patient_num, concept, lower(unit), value, 'Tabular' from struct_result),
  y as (select distinct x.patient_num, x.concept, r.final_unit as unit, x.value * r.rate as value, x.method
        from x join rates r on x.concept = r.concept and x.unit = r.unit join limits l on l.concept = x.concept
        where x.value * r.rate >= 0 and x.value * r.rate <= l.max_value),
  vals as (select * from y
      union all select distinct patient_num, concept, unit, value, 'NLP + Tabular' from y
      union all select patient_num, concept, unit, value, 'NLP - Tabular' from y a where method = 'NLP' and not exists (
        select 1 from y b where b.method = 'Tabular' and a.patient_num = b.patient_num and a.concept = b.concept and a.unit = b.unit and a.value = b.value))"""


def values(t):
    text = I.interpret(t.text_result).withColumnRenamed("value_as_number", "value")
    return R.value_sets(text, t.struct_result, I.unit_table(t.spark, RATES), I.limit_table(t.spark, LIMITS))


@query(
    "values_by_source",
    "C11 G4 H31 B13 B19 G3",
    BOTH_NEEDS,
    VALUES + " select patient_num, concept, unit, round(value, 9) as value, method from vals",
)
def values_by_source(t):
    return values(t).withColumn("value", F.round("value", 9))


@query(
    "source_benefit",
    "C11",
    BOTH_NEEDS,
    """select distinct patient_num, concept, 'NLP - Tabular' as method from text_result a where not exists (
       select 1 from struct_result b where a.patient_num = b.patient_num and a.concept = b.concept)""",
)
def source_benefit(t):
    return R.source_benefit(t.text_result, t.struct_result.where("concept is not null"), ["patient_num", "concept"])


@query(
    "converted_units",
    "H31 B19",
    BOTH_NEEDS,
    VALUES + " select s.instance_num, s.concept, r.final_unit as unit, round(s.value * r.rate, 9) as value from struct_result s join rates r on s.concept = r.concept and lower(s.unit) = r.unit where s.value is not null",
)
def converted_units(t):
    out = I.convert_units(t.struct_result, I.unit_table(t.spark, RATES)).where("value is not null")
    return out.select("instance_num", "concept", "unit", F.round("value", 9).alias("value"))


@query(
    "value_histogram",
    "D12",
    BOTH_NEEDS,
    VALUES
    + """ select v.concept, v.method, cast(least(floor(value / (max_value / 20) + 1e-14), 19) as int) as bin, cast(count(*) as bigint) as n
       from vals v join limits l on v.concept = l.concept group by 1, 2, 3""",
)
def value_histogram(t):
    return R.value_histogram(values(t), I.limit_table(t.spark, LIMITS)).select("concept", "method", "bin", "n")


@query(
    "value_totals",
    "D12",
    BOTH_NEEDS,
    VALUES + " select concept, method, cast(count(*) as bigint) as n, count(distinct patient_num) as patients from vals group by 1, 2",
)
def value_totals(t):
    return R.value_totals(values(t))


@query(
    "value_boxes",
    "D13",
    BOTH_NEEDS,
    VALUES
    + """ select concept, method, round(min(value), 9) as min, round(quantile_cont(value, 0.25), 9) as q1, round(median(value), 9) as median,
       round(quantile_cont(value, 0.75), 9) as q3, round(max(value), 9) as max from vals group by 1, 2""",
)
def value_boxes(t):
    out = Q.box_summary(values(t))
    return out.select("concept", "method", *[F.round(c, 9).alias(c) for c in ("min", "q1", "median", "q3", "max")])


@query(
    "value_density",
    "D14",
    BOTH_NEEDS,
    VALUES
    + """, g as (select unnest(generate_series(0, 99)) as point)
       select v.concept, v.method, cast(point as int) as point, round(sum(exp(-power((point * max_value / 99 - value) / (max_value * 0.02), 2) / 2) / (max_value * 0.02 * sqrt(2 * pi()))), 4) as density
       from vals v join limits l on v.concept = l.concept, g group by 1, 2, 3""",
)
def value_density(t):
    out = R.density(values(t), I.limit_table(t.spark, LIMITS))
    return out.select("concept", "method", "point", F.round("density", 4).alias("density"))


@query(
    "canonical_measurements",
    "H32",
    "text_result",
    f"""select source, concept, coalesce({plain_sql("replace(value_cleaned, ',', '.')")} || ' ' || coalesce(unit, 'nounit'),
       case non_digit_value when 'positif' then '1 bool' when 'negatif' then '0 bool' end, '') as found from text_result""",
)
def canonical_measurements(t):
    found = I.canonical_measurement("value_cleaned", "unit", "non_digit_value")
    return t.text_result.select("source", "concept", F.coalesce(found, F.lit("")).alias("found"))


@query(
    "patient_findings",
    "H11 H25 H29 D4",
    "entity",
    PARSED
    + f""", k as (select cast(replace(source, '.ann', '') as bigint) % 100000 as encounter_num,
        case when lexical_variant like 'hemoglobine%' then 'Hemoglobin' when lexical_variant like 'crp%' then 'CRP' when lexical_variant like 'ac anti dna%' then 'Anti-DNA' end as concept,
        try_cast(split_part(range_value, '-', 1) as double) as lo, try_cast(split_part(range_value, '-', 2) as double) as hi, range_value,
        try_cast(value_cleaned as double) as v, non_digit_value from parsed),
      f as (select o_custkey as patient_num, concept, case when v is null or range_value is null then null else coalesce(v < lo, false) or coalesce(v > hi, false) end as pv,
        regexp_matches(non_digit_value, '^(?:{P.POSITIVE_PREFIX.replace(chr(39), chr(39) * 2)})') as pt,
        regexp_matches(non_digit_value, '^(?:{P.NEGATIVE_PREFIX.replace(chr(39), chr(39) * 2)})') as nt from k join orders on o_orderkey = encounter_num)
      select patient_num, coalesce(bool_or(concept = 'Hemoglobin'), false) as hb, coalesce(bool_or(concept = 'Hemoglobin' and (coalesce(pv, false) or (pv is null and pt is null))), false) as hb_positive,
        coalesce(bool_or(concept = 'CRP'), false) as crp, coalesce(bool_or(concept = 'Anti-DNA' and (coalesce(pt, false) or coalesce(pv, false) or (not coalesce(pt, false) and not coalesce(nt, false) and pv is null))), false) as dna_positive from f group by patient_num""",
)
def patient_findings(t):
    parsed = M.parse_measurements(*M.split_by_label(t.entity, "BIO_comp", ["BIO", "BIO_Val"]))
    name = F.col("lexical_variant")
    concept = F.when(name.startswith("hemoglobine"), "Hemoglobin").when(name.startswith("crp"), "CRP").when(
        name.startswith("ac anti dna"), "Anti-DNA"
    )
    rows = parsed.withColumns({"encounter_num": note_id_from_source("source").cast("long"), "concept": concept})
    rows = I.interpret(rows).join(t.visit.select("encounter_num", "patient_num"), "encounter_num")
    flags = R.patient_flags(rows, CONCEPTS, I.is_positive_text())
    names = {"Hemoglobin": "hb", "Hemoglobin positive": "hb_positive", "CRP": "crp", "Anti-DNA positive": "dna_positive"}
    return flags.select("patient_num", *[F.col(f"`{k}`").alias(v) for k, v in names.items()])


@query(
    "discrepancy_sample",
    "K2 C19 E6",
    BOTH_NEEDS,
    INTERPRETED
    + """, tf as (select encounter_num, bool_or(concept = 'CRP' and (coalesce(positive_text, false) or coalesce(positive_value, false)
           or (positive_text is null and negative_text is null and positive_value is null))) as pos from i group by 1),
       sp as (select *, concept = 'CRP' and (coalesce(value > confidence_num, false) or coalesce(tval_char ilike '%posi%', false) or coalesce(tval_char ilike '%présence%', false)) as pos from struct_result),
       sf as (select encounter_num, bool_or(pos) as pos from sp group by 1),
       d as (select tf.encounter_num from tf join sf using (encounter_num) where not tf.pos and sf.pos),
       stays as (select encounter_num from d order by cast(concat('0x', substr(md5('42:' || cast(encounter_num as varchar)), 1, 15)) as bigint), encounter_num limit 10),
       docs as (select distinct encounter_num, split_part(split_part(source, '.', 1), '_', 1) as instance_num from text_result)
       select encounter_num, docs.instance_num, concat_ws(' | ', concept, coalesce(cast(value as varchar), ''), unit, coalesce(tval_char, '')) as evidence, 'CRP' as concept
       from sp join stays using (encounter_num) left join docs using (encounter_num) where sp.pos""",
)
def discrepancy_sample(t):
    from chartloom.operators.notes import discrepancy_sample as sample

    # Each visit stands for a patient here: every customer of the given tables is positive in both sources.
    text = t.text_result.withColumn("patient_num", F.col("encounter_num"))
    struct = t.struct_result.withColumn("patient_num", F.col("encounter_num"))
    positive = I.is_positive_structured("value")
    flags = R.join_flag_sources(
        R.patient_flags(I.interpret(text), CONCEPTS, I.is_positive_text()), R.patient_flags(struct, CONCEPTS, positive)
    )
    results = struct.withColumns({"CRP positive": F.coalesce((F.col("concept") == "CRP") & positive, F.lit(False)), "name_char": F.col("concept")})
    notes = text.select("encounter_num", note_id_from_source("source").alias("instance_num"))
    return sample(flags, results, notes, "CRP").drop("patient_num")
