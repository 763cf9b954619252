"""Cohort selection, facts and descriptive counts."""

from pyspark.sql import functions as F

from chartloom.catalog.registry import query
from chartloom.operators import cohort as C
from chartloom.functions.text import test_name
from chartloom.session import scratch
from chartloom.sources.tables import read_sink, write_sinks

DISEASES = {"lupus": ["1", "2"], "takayasu": ["2", "3"]}
COHORT = """, codes as (select * from (values ('lupus', 'CIM10:1'), ('lupus', 'CIM10:2'), ('takayasu', 'CIM10:2'),
    ('takayasu', 'CIM10:3')) v(disease, concept_cd)),
  rows_ as (select d.disease, n.instance_num, n.observation_blob, n.encounter_num, n.patient_num, n.note_date,
      v.age_visit_in_years_num, v.start_date
    from note n join (select x.encounter_num, c.disease from diagnosis x join codes c on x.concept_cd = c.concept_cd) d
      on n.encounter_num = d.encounter_num join visit v on v.encounter_num = n.encounter_num
    where n.concept_cd in ('CR:CRH-HOSPI', 'CR:CRH-S') and length(n.observation_blob) > 1000),
  cohort as (select disease, observation_blob, min(instance_num) as note_id,
      arg_min(encounter_num, instance_num) as encounter_num, arg_min(patient_num, instance_num) as patient_num,
      arg_min(age_visit_in_years_num, instance_num) as age, arg_min(start_date, instance_num) as start_date,
      cast(count(distinct instance_num) as bigint) as n_copies
    from rows_ group by disease, observation_blob)"""
NEEDS = "note diagnosis visit"


def codes(t):
    return C.disease_codes(t.spark, DISEASES)


def cohort(t):
    return C.cohort_notes(t.note, t.diagnosis, t.visit, codes(t))


def visits(t):
    """Visits of each disease, from diagnoses alone (the facts tables are wider than the notes)."""
    return t.diagnosis.join(codes(t), "concept_cd").select("disease", "encounter_num")


VISITS = """, codes as (select * from (values ('lupus', 'CIM10:1'), ('lupus', 'CIM10:2'), ('takayasu', 'CIM10:2'),
    ('takayasu', 'CIM10:3')) v(disease, concept_cd)),
  dv as (select distinct c.disease, d.encounter_num from diagnosis d join codes c on d.concept_cd = c.concept_cd)"""


@query("warehouse_scan", "A1", "", "select o_orderkey as encounter_num, o_custkey as patient_num from orders")
def warehouse_scan(t):
    from chartloom.sources.tables import load_tables

    spec = {"orders": {"encounter_num": "o_orderkey", "patient_num": "o_custkey"}}
    return load_tables(t.spark, t.sf_dir, spec)["orders"]


@query(
    "timestamps_as_text",
    "B1",
    "visit",
    "select encounter_num, patient_num, strftime(start_date, '%Y-%m-%d %H:%M:%S') as start_date, age_visit_in_years_num from visit",
)
def timestamps_as_text(t):
    return C.timestamps_to_text(t.visit)


@query(
    "report_notes",
    "B2 B4",
    "note",
    """select instance_num, cast(length(observation_blob) as bigint) as n_chars from note
       where concept_cd in ('CR:CRH-HOSPI', 'CR:CRH-S') and length(observation_blob) > 1000""",
)
def report_notes(t):
    return C.prepare_notes(t.note).select("instance_num", F.length("observation_blob").cast("long").alias("n_chars"))


@query(
    "cohort_rows",
    "C1 B2 B3",
    NEEDS,
    COHORT + " select disease, instance_num, encounter_num, patient_num, age_visit_in_years_num, md5(observation_blob) as text_md5 from rows_",
)
def cohort_rows(t):
    return C.cohort_rows(t.note, t.diagnosis, t.visit, codes(t)).select(
        "disease", "instance_num", "encounter_num", "patient_num", "age_visit_in_years_num", F.md5("observation_blob").alias("text_md5")
    )


@query(
    "cohort_notes",
    "D1 C1",
    NEEDS,
    COHORT + " select disease, note_id, encounter_num, patient_num, age, n_copies, md5(observation_blob) as text_md5 from cohort",
)
def cohort_notes(t):
    return cohort(t).select(
        "disease", "note_id", "encounter_num", "patient_num", F.col("age_visit_in_years_num").alias("age"), "n_copies",
        F.md5("observation_blob").alias("text_md5"),
    )


_SUNK = "disease, instance_num, encounter_num, patient_num, md5(observation_blob) as text_md5"


@query(
    "sinks_per_disease",
    "A11",
    NEEDS,
    COHORT + f" select 'all' as sink, {_SUNK} from rows_ union all select disease, {_SUNK} from rows_",
)
def sinks_per_disease(t):
    rows = C.cohort_rows(t.note, t.diagnosis, t.visit, codes(t))
    rows = rows.select("disease", "instance_num", "encounter_num", "patient_num", F.md5("observation_blob").alias("text_md5"))
    path = scratch(t.spark, "cohort")
    out = write_sinks(rows, path).withColumn("sink", F.lit("all"))
    for disease in DISEASES:
        out = out.unionByName(read_sink(t.spark, path, rows.schema, value=disease).withColumn("sink", F.lit(disease)))
    return out


@query(
    "note_copies",
    "D1",
    NEEDS,
    COHORT
    + """ select r.disease, r.instance_num, c.note_id from (select distinct disease, instance_num, observation_blob from rows_) r
       join cohort c on r.disease = c.disease and r.observation_blob = c.observation_blob""",
)
def note_copies(t):
    rows = C.cohort_rows(t.note, t.diagnosis, t.visit, codes(t))
    return C.note_groups(rows).select("disease", "instance_num", "note_id")


@query(
    "joined_note_ids",
    "D1",
    NEEDS,
    COHORT
    + """ select disease, md5(observation_blob) as text_md5, instance_num,
       row_number() over (partition by disease, observation_blob order by instance_num) as position
       from (select distinct disease, observation_blob, instance_num from rows_) r""",
)
def joined_note_ids(t):
    rows = C.cohort_rows(t.note, t.diagnosis, t.visit, codes(t))
    keys = rows.select(F.sha2("observation_blob", 256).alias("note_key"), F.md5("observation_blob").alias("text_md5")).distinct()
    return C.numbered_note_ids(C.note_groups(rows)).join(keys, "note_key").drop("note_key")


@query(
    "test_names",
    "B8",
    "concept",
    "select concept_cd, trim(split_part(substr(name_char, instr(name_char, ':') + 1), '_', 1)) as test from concept",
)
def test_names(t):
    return t.concept.select("concept_cd", test_name("name_char").alias("test"))


LABS = (
    VISITS
    + """, labs as (select dv.disease, l.instance_num, l.concept_cd, coalesce(l.units_cd, 'nounit') as units_cd, l.nval_num,
      l.tval_char, l.confidence_num, l.encounter_num, l.patient_num, c.name_char,
      trim(split_part(substr(c.name_char, instr(c.name_char, ':') + 1), '_', 1)) as terms_linked_to_measurement
    from lab l join dv on l.encounter_num = dv.encounter_num join concept c on l.concept_cd = c.concept_cd
    where l.nval_num is not null or l.tval_char is not null)"""
)
LAB_NEEDS = "diagnosis lab concept"
DRUGS = (
    VISITS
    + """, drugs as (select dv.disease, d.instance_num, d.concept_cd,
      case when d.concept_cd = 'MED:RED_BOLT' then 'P01BA02' else d.valueflag_cd end as valueflag_cd,
      d.encounter_num, d.patient_num, c.name_char
    from drug d join dv on d.encounter_num = dv.encounter_num join drug_concept c on d.concept_cd = c.concept_cd)"""
)
DRUG_NEEDS = "diagnosis drug drug_concept"


def labs(t):
    return C.prepare_labs(C.cohort_facts(t.lab, t.concept, visits(t)))


def drugs(t):
    return C.prepare_drugs(C.cohort_facts(t.drug, t.drug_concept, visits(t)), "MED:RED_BOLT", "P01BA02")


@query(
    "cohort_labs",
    "C2 C3 B5 B6 B8",
    LAB_NEEDS,
    LABS + " select * from labs",
)
def cohort_labs(t):
    return labs(t).drop("quantity_num", "start_date")


@query("cohort_drugs", "C2 C3 B7", DRUG_NEEDS, DRUGS + " select * from drugs")
def cohort_drugs(t):
    return drugs(t).drop("start_date")


@query(
    "gold_lists",
    "A14",
    LAB_NEEDS,
    LABS
    + """ select *, row_number() over (partition by disease, encounter_num, patient_num, terms_linked_to_measurement order by name_char, gold) as position
       from (select disease, encounter_num, patient_num, terms_linked_to_measurement, name_char,
         coalesce(cast(nval_num as varchar), tval_char) || ' ' || units_cd as gold from labs) g""",
)
def gold_lists(t):
    return C.gold_list(labs(t))


@query(
    "cohort_counts",
    "D7",
    NEEDS,
    COHORT
    + """ select disease, count(distinct note_id) as note_id, count(distinct encounter_num) as encounter_num,
       count(distinct patient_num) as patient_num from cohort group by disease""",
)
def cohort_counts(t):
    return C.cohort_counts(cohort(t), ["note_id", "encounter_num", "patient_num"])


@query(
    "lab_counts",
    "D7",
    LAB_NEEDS,
    LABS
    + """ select disease, count(distinct instance_num) as instance_num, count(distinct encounter_num) as encounter_num,
       count(distinct patient_num) as patient_num from labs group by disease""",
)
def lab_counts(t):
    return C.cohort_counts(labs(t), ["instance_num", "encounter_num", "patient_num"])


@query(
    "complete_cases",
    "C10",
    "diagnosis lab concept drug drug_concept visit",
    LABS
    + """, drugs as (select d.encounter_num, d.patient_num from drug d join dv on d.encounter_num = dv.encounter_num),
       base as (select dv.disease, v.encounter_num, v.patient_num from dv join visit v on v.encounter_num = dv.encounter_num)
       select disease, count(distinct encounter_num) as encounter_num, count(distinct patient_num) as patient_num from base b
       where exists (select 1 from labs l where l.encounter_num = b.encounter_num and l.patient_num = b.patient_num)
         and exists (select 1 from drugs d where d.encounter_num = b.encounter_num and d.patient_num = b.patient_num)
       group by disease""",
)
def complete_cases(t):
    base = visits(t).join(t.visit, "encounter_num")
    return C.cohort_counts(C.complete_cases(base, labs(t), drugs(t)), ["encounter_num", "patient_num"])


BASE_COHORT = VISITS + """, base as (select dv.disease, v.* from dv join visit v on v.encounter_num = dv.encounter_num)"""


def base_cohort(t):
    return visits(t).join(t.visit, "encounter_num")


@query(
    "age_histogram",
    "D8",
    "diagnosis visit",
    BASE_COHORT
    + """ select a.disease, age_visit_in_years_num, patient_num, total_patient, patient_num / total_patient as density
       from (select disease, age_visit_in_years_num, count(distinct patient_num) as patient_num from base group by 1, 2) a
       join (select disease, count(distinct patient_num) as total_patient from base group by 1) b on a.disease = b.disease""",
)
def age_histogram(t):
    return C.age_histogram(base_cohort(t))


@query(
    "age_histogram_rounded",
    "D8",
    "diagnosis visit",
    BASE_COHORT
    + """ select a.disease, round_age, patient_num, total_patient, patient_num / total_patient as density
       from (select disease, round_even(age_visit_in_years_num * 2 / 10.0, 0) * 10 / 2 as round_age, count(distinct patient_num) as patient_num from base group by 1, 2) a
       join (select disease, count(distinct patient_num) as total_patient from base group by 1) b on a.disease = b.disease""",
)
def age_histogram_rounded(t):
    return C.age_histogram(base_cohort(t), rounded=True)


MONTHS = (
    BASE_COHORT
    + """, months as (select a.disease, month_date, encounter_num, total_visit, encounter_num / total_visit as density
       from (select disease, strftime(start_date, '%Y-%m') as month_date, count(distinct encounter_num) as encounter_num from base group by 1, 2) a
       join (select disease, count(distinct encounter_num) as total_visit from base group by 1) b on a.disease = b.disease)"""
)


@query("monthly_visits", "D9", "diagnosis visit", MONTHS + " select * from months")
def monthly_visits(t):
    return C.monthly_visits(base_cohort(t))


@query(
    "quarterly_visits",
    "D9",
    "diagnosis visit",
    MONTHS
    + """ select disease, strftime(date_trunc('quarter', strptime(month_date || '-01', '%Y-%m-%d')), '%Y-%m') as quarter,
       cast(sum(encounter_num) as bigint) as encounter_num from months group by 1, 2""",
)
def quarterly_visits(t):
    return C.quarterly_visits(C.monthly_visits(base_cohort(t)))


@query(
    "cohort_left_results",
    "C9",
    "diagnosis drug drug_concept visit",
    DRUGS
    + """, base as (select distinct v.encounter_num, v.patient_num from dv join visit v on v.encounter_num = dv.encounter_num),
       hit as (select encounter_num, patient_num, valueflag_cd from drugs where valueflag_cd = 'P01BA02')
       select b.encounter_num, b.patient_num, h.valueflag_cd from base b left join hit h
       on b.encounter_num = h.encounter_num and b.patient_num = h.patient_num""",
)
def cohort_left_results(t):
    cohort_keys = visits(t).join(t.visit, "encounter_num").select("encounter_num", "patient_num").distinct()
    hits = drugs(t).where("valueflag_cd = 'P01BA02'").select("encounter_num", "patient_num", "valueflag_cd")
    return C.onto_cohort(hits, cohort_keys)
