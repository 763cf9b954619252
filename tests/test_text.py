"""Column functions and the mention grammar on hand-written French text."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chartloom.functions import labpatterns as P
from chartloom.functions import text as X
from chartloom.operators import interpret as I
from chartloom.operators import measure as M

ENTITY = "source string, term string, lexical_variant string, span_start int, span_end int, label string"


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], [*cols]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


def parse(spark, text, inner=None, canonical="none"):
    outer = spark.createDataFrame([("a.ann", text, text, 0, len(text), "BIO_comp")], ENTITY)
    rows = [("a.ann", inner, inner, 0, len(inner), "BIO")] if inner else []
    return M.parse_measurements(outer, spark.createDataFrame(rows, ENTITY), canonical).first()


@pytest.mark.parametrize(
    "text, inner, want",
    [
        ("Hémoglobine à 12,5 g/dl (N: 12 - 16)", "Hémoglobine", dict(value_cleaned="12.5", unit="g/dl", range_value="12-16", lexical_variant="hemoglobine")),
        ("CRP 5mg/l", "CRP", dict(value_cleaned="5.0", unit="mg/l", range_value=None)),
        ("Leucocytes 7 G/L 12/2019", "Leucocytes", dict(value_cleaned="7.0", unit="x10*9/l", extracted_date="12/2019")),
        ("créatinine à 80 µmol/L", "créatinine", dict(value_cleaned="80.0", unit="µmol/l")),
        ("Protéinurie < 0.5 g/24h urinaire", "Protéinurie", dict(value_cleaned="<0.5", unit="g/24h")),
        ("protéinurie urinaire 2 g/l", "protéinurie urinaire", dict(fluid_source="urinaire", lexical_variant="proteinurie  ")),
        ("TP 85 %", "TP", dict(value_cleaned="85.0", unit="%")),
        ("Ac anti-DNA positif", "Ac anti-DNA", dict(non_digit_value="positif", value_cleaned=None, lexical_variant="ac anti dna")),
        ("titre 1/160", "titre", dict(value_cleaned="1/160")),
        ("natrémie …¹ 140 mmol/l", "natrémie", dict(value_cleaned="140.0", unit="mmol/l")),
        # without an inner mention the text is kept and names the test
        ("Creatinine 80 micromol/l", None, dict(value_cleaned="80.0", unit="µmol/l", lexical_variant="creatinine", term_bio=None)),
        ("taux sur CRP", "taux sur CRP", dict(lexical_variant="taux / crp")),
    ],
)
def test_parse(spark, text, inner, want):
    row = parse(spark, text, inner)
    assert {k: row[k] for k in want} == want


def test_qualitative_options(spark):
    assert parse(spark, "test hemolysee", "test").non_digit_value == "hemolysee"
    assert parse(spark, "test hemolysee", "test", "last").non_digit_value == "hemolyse"
    assert parse(spark, "test elevees", "test", "all").non_digit_value == "eleve"
    assert one(spark, M.qualitative_family(F.lit("diminuee"))) == "dimunue"


def test_names_and_keys(spark):
    assert one(spark, X.test_name(F.lit("A12: CRP serum_x_y"))) == "CRP serum"
    with pytest.raises(Exception, match="no ':'"):
        one(spark, X.test_name(F.col("c")), c="CRP")
    assert one(spark, X.note_id_from_source(F.lit("12_34.ann"))) == "12"
    assert one(spark, X.drop_extension(F.lit("12_34.ann"))) == "12_34"
    assert one(spark, X.mention_key(F.lit("  Œstrogène "))) == "oestrogene"
    assert one(spark, X.product_key(F.lit("Doliprane 500 mg"))) == "doliprane"
    assert one(spark, X.is_combination(F.lit("AMOX/CLAV"))) is False
    assert one(spark, X.is_combination(F.lit("AMOX/CLAV 1g"))) is True
    assert one(spark, X.empty_to_null(F.lit(""))) is None


def test_vocabulary_text(spark):
    clean = X.clean_vocab_text(F.lit("Dosage of Ac anti-ADN (sérum)"), stopwords=["of", "dosage"])
    assert one(spark, clean) == "antibody anti adn serum"
    assert one(spark, X.clean_vocab_text(F.lit("Ag HBs"), cased=True, special_characters=False)) == "Antigene HBs"


def test_codes(spark):
    assert one(spark, X.code_prefixes(F.array(F.lit("H02")))) == ["H", "H0", "H02"]
    pred, gold = F.array(F.lit("H02AB07")), F.array(F.lit("H02AB"))
    assert one(spark, X.codes_hit(pred, gold)) is False
    assert one(spark, X.codes_hit(pred, gold, True)) is True


def test_bounds_and_flags(spark):
    for text, want in {"12-16": (12, 16), "1,5–3": (1.5, 3), "<5": (None, 5), ">2": (2, None), "7": (None, None)}.items():
        lo, hi = I.range_bounds(F.lit(text))
        assert one(spark, F.struct(lo.alias("a"), hi.alias("b"))) == want
    lo, hi = I.range_bounds(F.lit("<5"), one_sided=False)
    assert one(spark, F.struct(lo.alias("a"), hi.alias("b"))) == (None, None)
    args = [F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0), F.lit("1-2")]
    assert one(spark, I.out_of_range(*args)) is None
    assert one(spark, I.out_of_range(F.lit(3.0), F.lit(1.0), F.lit(2.0), F.lit("1-2"))) is True
    positive, negative = I.text_polarity(F.lit("absente"))
    assert one(spark, F.struct(positive.alias("a"), negative.alias("b"))) == (None, True)
    assert one(spark, I.is_positive_structured("v", "l", "t"), v=1.0, l=2.0, t="PRÉSENCE") is True


def test_canonical_measurement(spark):
    assert one(spark, I.canonical_annotation(F.lit("x_12,5 g/dl"))) == "12.5 g/dl"
    assert one(spark, I.canonical_annotation(F.lit("neg"))) == "0 bool"
    assert one(spark, I.canonical_annotation(F.lit("+"))) == "1 bool"
    assert one(spark, I.canonical_annotation(F.lit("normaux"))) == "0.5 bool"
    assert one(spark, I.canonical_annotation(F.lit("CRP_4 G/L"))) == "4.0 x10*9/l"


def test_snippet_near_the_start(spark):
    cut, lo, hi = X.snippet(F.lit("abcdefghij"), F.lit(2), F.lit(4), 3)
    assert one(spark, F.struct(cut.alias("a"), lo.alias("b"), hi.alias("c"))) == ("abcdefgh", 2, 4)


def plain_steps(df):
    """The steps as plain patterns, each searched for in every text."""
    every = "|".join(P.QUALITATIVE.values())
    rest, sub, get = M.REST, F.regexp_replace, F.regexp_extract
    noise = lambda c: X.replace_all(X.strip_space(c), P.MENTION_NOISE)
    fold = lambda c: F.translate(F.lower(c), *P.ACCENTS)
    marks = [(P.FOOTNOTE, " "), (P.ELLIPSIS, " "), (P.SUPERSCRIPT, " ")]
    df = df.withColumns({c: X.replace_all(c, marks) for c in ("lexical_variant_biocomp", "lexical_variant_bio")})
    inner = F.coalesce("lexical_variant_bio", F.lit(""))
    df = df.withColumn(rest, sub(F.trim(F.replace(F.col("lexical_variant_biocomp"), inner, F.lit(" "))), P.GIGA_PER_LITRE, P.GIGA_PER_LITRE_UNIT))
    df = df.withColumns({"extracted_date": get("lexical_variant_biocomp", P.DATE, 1), rest: sub(rest, P.DATE, "")})
    df = df.withColumns({"range_value": X.empty_to_null(sub(get(rest, P.RANGE, 1), P.NOT_RANGE_CHAR, "")), rest: sub(rest, P.RANGE, " ")})
    low = F.translate(F.lower(X.replace_all(rest, [("⁹", " "), ("m²", "m2"), ("m³", "m3")])), *P.SUPERSCRIPT_DIGITS)
    df = df.withColumn(rest, noise(fold(X.replace_all(low, [("à", "="), (":", " ")]))))
    df = df.withColumns({"non_digit_value": X.empty_to_null(sub(get(rest, every, 0), P.NOT_QUALITATIVE_CHAR, "")), rest: sub(rest, every, " ")})
    df = df.withColumn(rest, X.replace_all(rest, [*P.UNIT_SPELLING, (P.POWER_UNIT_GLUED, "$1 $2"), (P.UNIT_GLUED, "$1 $2")]))
    unit = F.btrim(F.lower(F.replace(get(rest, P.UNIT, 1), F.lit(" "), F.lit(""))), F.lit(P.UNIT_EDGE))
    df = df.withColumns({"unit": X.empty_to_null(F.when(unit.contains("%"), "%").otherwise(unit)), rest: sub(rest, P.UNIT, " ")})
    kept = sub(get(rest, P.VALUE, 1), P.NOT_VALUE_CHAR, "")
    value = X.empty_to_null(F.when(kept.rlike("[<>/]"), kept).otherwise(F.coalesce(X.plain_decimal(kept), kept)))
    df = df.withColumns({"value_cleaned": value, rest: sub(rest, P.VALUE, " ")})
    name = F.when(F.col("lexical_variant_bio") != "", F.col("lexical_variant_bio")).otherwise(get(rest, P.FIRST_WORD, 1))
    return M.extract_specimen(df.withColumn("lexical_variant", F.trim(X.replace_all(noise(fold(name)), [(r"\bsur\b", "/"), ("[<>-]", " ")]))))


WORDS = (
    "est comprise avec pour soit dans sans selon rapport raports dosage numerations ratio rati sur positifs |po ¦pos pos positiv negatifs |ne nega "
    "negatve augmentee diminue depassees normaux normo nle correcte stabl elevee bas basse absences indetectable presente sign ns non physio physiologique "
    "fluctuentes hemolysees pas d' p n + - grammes grames micro micr micor mole molaires mili milli litre secondes secs jours par minute min heures "
    "G/L x10*9/l 10*12/l g/24h mg/dl µmol/l μmol ui/ml ml/min/1.73m2 mm3 /mm3 mm hg % fl kpa m?mol osmol gl giga/l mgy.cm |µs ¦s |/l u / l k "
    "12/2019 2019-03-04 2020 01/02 (N: 12 – 16) 3-5 (<5) |>7 <0.5 > 7,0 1/160 007 0,50 250000000 5 12 ... … …¹ ... 2 ⁹ m² m³ à É ÿ µ ℓ _ : \\ \\n / urine sang"
).split(" ")
GAPS = ["", "", " ", " ", " ", "\t", "\n", " ", " ", "\x85", "-", ".", ","]


def test_guarded_searches(spark):
    """A search that is skipped, or led by what a match begins with, finds what the plain pattern finds in every text."""
    rng, rows = random.Random(11), [(None, None), (None, "CRP"), ("", ""), ("CRP 5", None)]
    for _ in range(6000):
        text = "".join(rng.choice((str, str, str.upper))(rng.choice(WORDS)) + rng.choice(GAPS) for _ in range(rng.randrange(9)))
        rows.append((rng.choice(GAPS) + text, rng.choice([None, "", text[:3], rng.choice(WORDS)])))
    texts = spark.createDataFrame(rows, "lexical_variant_biocomp string, lexical_variant_bio string")
    none = spark.createDataFrame([], ENTITY)
    outer = texts.select(F.monotonically_increasing_id().cast("string").alias("source"), F.lit("t").alias("term"),
        F.col("lexical_variant_biocomp").alias("lexical_variant"), F.lit(0).alias("span_start"), F.lit(9).alias("span_end"), F.lit("BIO_comp").alias("label"))
    marks = [(P.FOOTNOTE, " "), (P.ELLIPSIS, " "), (P.SUPERSCRIPT, " ")]
    linked = texts.withColumns({c: X.replace_held(c, marks, P.NEEDED) for c in texts.columns})
    plain, guarded = plain_steps(texts), M.parse_texts(linked)
    columns = [c for c in plain.columns]
    want, got = (Counter(map(tuple, d.select(*columns).collect())) for d in (plain, guarded))
    assert want == got
    assert {r.lexical_variant_biocomp for r in M.link_mentions(outer, none).collect()} == {r.lexical_variant_biocomp for r in linked.collect()}
    plan = guarded._jdf.queryExecution().optimizedPlan().toString()
    assert P.UNIT_SEARCH in plan and f", {P.UNIT}, " not in plan
