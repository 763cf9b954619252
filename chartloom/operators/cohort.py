"""Cohort of notes by diagnosis, and the laboratory and drug facts of its visits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.text import override_code, test_name
from chartloom.operators.lists import number_sorted

# Report types of hospital discharge summaries.
REPORT_TYPES = ("CR:CRH-HOSPI", "CR:CRH-S")


def timestamps_to_text(df: DataFrame) -> DataFrame:
    """Every timestamp column cast to text."""
    return df.select(
        *[F.col(c).cast("string").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes]
    )


def disease_codes(spark, config: Mapping[str, Sequence[str]], prefix: str = "CIM10:") -> DataFrame:
    """(disease, concept_cd) rows of a disease → diagnosis codes mapping."""
    rows = [(d, prefix + c) for d, codes in config.items() for c in codes]
    return spark.createDataFrame(rows, "disease string, concept_cd string").distinct()


def prepare_notes(
    notes: DataFrame, types: Sequence[str] = REPORT_TYPES, min_len: int = 1000, text: str = "observation_blob"
) -> DataFrame:
    """Notes of the given types with more than ``min_len`` characters."""
    return notes.where(F.col("concept_cd").isin(list(types)) & (F.length(text) > min_len))


def cohort_rows(
    notes: DataFrame,
    diagnoses: DataFrame,
    visits: DataFrame,
    codes: DataFrame,
    min_len: int = 1000,
    types: Sequence[str] = REPORT_TYPES,
) -> DataFrame:
    """Notes of visits with a diagnosis of the cohort, one row per note and matching diagnosis.

    ``codes`` is (disease, concept_cd). The note filters reach the scan; diagnoses are cut to the cohort before they meet the notes.
    """
    wanted = diagnoses.join(codes, "concept_cd").select("encounter_num", "concept_cd", "disease")
    kept = prepare_notes(notes, types, min_len).select(
        "instance_num", "observation_blob", "encounter_num", "patient_num", "note_date"
    )
    seen = visits.select("encounter_num", "age_visit_in_years_num", "start_date")
    return kept.join(wanted, "encounter_num").join(seen, "encounter_num").na.drop("any")


def _text_key() -> Column:
    return F.sha2("observation_blob", 256)


def note_groups(rows: DataFrame) -> DataFrame:
    """Each note of a disease with the note that stands for its text.

    Columns ``disease, note_key, instance_num, note_id``: ``note_key`` is the digest of the
    text, ``note_id`` the smallest id among the notes with that text. One row per note, so a
    text with any number of copies stays spread over tasks; only digests are shuffled.
    """
    ids = rows.select("disease", _text_key().alias("note_key"), "instance_num").distinct()
    first = ids.groupBy("disease", "note_key").agg(F.min("instance_num").alias("note_id"))
    return ids.join(first, ["disease", "note_key"])


def cohort_notes(
    notes: DataFrame,
    diagnoses: DataFrame,
    visits: DataFrame,
    codes: DataFrame,
    min_len: int = 1000,
    types: Sequence[str] = REPORT_TYPES,
) -> DataFrame:
    """One row per disease and distinct note text, with the values of its smallest note id.

    The copies are listed by ``note_groups`` and, numbered, by ``numbered_note_ids``.
    """
    rows = cohort_rows(notes, diagnoses, visits, codes, min_len, types)
    values = ["encounter_num", "patient_num", "age_visit_in_years_num", "start_date", "note_date"]
    narrow = rows.select("disease", _text_key().alias("note_key"), "instance_num", *values)
    groups = narrow.groupBy("disease", "note_key").agg(
        F.min(F.struct("instance_num", *values)).alias("r"), F.count_distinct("instance_num").alias("n_copies")
    )
    first = groups.select(
        "disease", "note_key", F.col("r.instance_num").alias("note_id"), *[F.col("r." + v) for v in values], "n_copies"
    )
    # The digest decides which copy stands for a text; only then is the text itself moved, once.
    # An id may name several notes: the digest tells which of them is meant.
    texts = prepare_notes(notes, types, min_len).select(
        F.col("instance_num").alias("note_id"), _text_key().alias("note_key"), "observation_blob"
    )
    return first.join(texts.dropDuplicates(["note_id", "note_key"]), ["note_id", "note_key"])


def numbered_note_ids(groups: DataFrame) -> DataFrame:
    """The notes with one text, one row each, numbered from 1 in the order of their ids."""
    ids = groups.select("disease", "note_key", "instance_num").distinct()
    return number_sorted(ids, ["disease", "note_key"], ["instance_num"], "position")


def cohort_facts(facts: DataFrame, concepts: DataFrame, cohort: DataFrame) -> DataFrame:
    """Facts with their concept name, for the visits of each disease (``disease`` is a column)."""
    visits = cohort.select("disease", "encounter_num").distinct()
    return timestamps_to_text(facts.join(visits, "encounter_num").join(concepts, "concept_cd"))


def prepare_labs(labs: DataFrame, default_unit: str = "nounit") -> DataFrame:
    """Short test name, a unit for every row, and only rows with a number or a text result."""
    return labs.where(F.col("nval_num").isNotNull() | F.col("tval_char").isNotNull()).withColumns(
        {
            "terms_linked_to_measurement": test_name("name_char"),
            "units_cd": F.coalesce("units_cd", F.lit(default_unit)),
        }
    )


def prepare_drugs(drugs: DataFrame, concept: str = "MED:3400892640778", code: str = "P01BA02") -> DataFrame:
    """Class code corrected for one product."""
    return drugs.withColumn("valueflag_cd", override_code("valueflag_cd", "concept_cd", concept, code))


def _with_disease(keys: Sequence[str], *tables: DataFrame) -> list[str]:
    """``keys``, and ``disease`` where all tables tell diseases apart."""
    return [*(["disease"] if all("disease" in t.columns for t in tables) else []), *keys]


def onto_cohort(df: DataFrame, cohort: DataFrame, keys: Sequence[str] = ("encounter_num", "patient_num")) -> DataFrame:
    """Every cohort row with its results; visits without results stay, with nulls.

    Results of a disease meet that disease's rows only.
    """
    k = _with_disease(keys, cohort, df)
    return cohort.select(*k).join(df, k, "left")


def complete_cases(
    df: DataFrame, labs: DataFrame, drugs: DataFrame, keys: Sequence[str] = ("encounter_num", "patient_num")
) -> DataFrame:
    """Rows whose visit has both drug and laboratory facts."""
    for facts in (drugs, labs):
        k = _with_disease(keys, df, facts)
        df = df.join(facts.select(*k).distinct(), k, "left_semi")
    return df


def cohort_counts(df: DataFrame, columns: Sequence[str], by: str = "disease") -> DataFrame:
    """Exact distinct counts per disease."""
    return df.groupBy(by).agg(*[F.count_distinct(c).alias(c) for c in columns])


def age_histogram(cohort: DataFrame, rounded: bool = False) -> DataFrame:
    """Distinct patients per age and their share of the disease's patients.

    ``rounded`` groups ages by five years, halves to even.
    """
    age = F.col("age_visit_in_years_num")
    key = (F.bround(age * 2, -1) / 2).alias("round_age") if rounded else age
    name = "round_age" if rounded else "age_visit_in_years_num"
    per_age = cohort.groupBy("disease", key).agg(F.count_distinct("patient_num").alias("patient_num"))
    total = cohort.groupBy("disease").agg(F.count_distinct("patient_num").alias("total_patient"))
    return per_age.join(total, "disease").select(
        "disease", name, "patient_num", "total_patient", (F.col("patient_num") / F.col("total_patient")).alias("density")
    )


def monthly_visits(cohort: DataFrame) -> DataFrame:
    """Distinct visits per month and their share of the disease's visits."""
    month = F.date_format("start_date", "yyyy-MM").alias("month_date")
    per_month = cohort.groupBy("disease", month).agg(F.count_distinct("encounter_num").alias("encounter_num"))
    total = cohort.groupBy("disease").agg(F.count_distinct("encounter_num").alias("total_visit"))
    return per_month.join(total, "disease").withColumn("density", F.col("encounter_num") / F.col("total_visit"))


def quarterly_visits(months: DataFrame) -> DataFrame:
    """Monthly visits summed by quarter."""
    quarter = F.date_format(F.date_trunc("quarter", F.to_date("month_date", "yyyy-MM")), "yyyy-MM").alias("quarter")
    return months.groupBy("disease", quarter).agg(F.sum("encounter_num").alias("encounter_num"))


def gold_list(labs: DataFrame) -> DataFrame:
    """Values with units of each (disease, visit, patient, test), one row each, numbered from 1."""
    found = F.coalesce(F.col("nval_num").cast("string"), F.col("tval_char"))
    df = labs.withColumn("gold", F.concat_ws(" ", found, "units_cd"))
    keys = ["disease", "encounter_num", "patient_num", "terms_linked_to_measurement"]
    return number_sorted(df.select(*keys, "name_char", "gold"), keys, ["name_char", "gold"], "position")
