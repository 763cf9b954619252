"""Annotation files on disk."""

import pytest
from chartloom.operators import notes as N
from chartloom.sources import standoff as B

TEXT = "Fièvre et\n  toux. Aspirine 100 mg"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "n1.txt").write_text(TEXT, encoding="utf-8")
    lines = [
        "T1\tDISO 0 9;12 16\tFièvre et toux",
        "T2\tChemical_and_drugs 27 30;18 26\t100 Aspirine",
        "A1\tNegation T2 Neg",
        "A2\tHypo T1",
        "R1\tLinked Arg1:T1 Arg2:T2",
        "E1\tTest:T1 Value:T2",
        "#1\tAnnotatorNotes T2\tB01AC06",
    ]
    (tmp_path / "sub" / "n1.ann").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "x-checkpoint.txt").write_text("old", encoding="utf-8")
    return tmp_path


def test_entities(spark, folder):
    rows = {r.ann_id: r for r in B.read_standoff(spark, str(folder)).collect()}
    assert set(rows) == {"T1", "T2", "#1"}
    assert (rows["T2"].term, rows["T2"].span) == ("Aspirine 100", "18 30")
    assert rows["T1"].source == "sub/n1.ann"
    only = B.read_standoff(spark, str(folder), ["DISO"])
    assert [r.ann_id for r in only.collect()] == ["T1"]
    noted = N.attach_notes(B.read_standoff(spark, str(folder)), "left")
    assert {r.ann_id: r.annotation for r in noted.collect()} == {"T1": None, "T2": "B01AC06"}


def test_full(spark, folder):
    s = B.read_standoff_full(spark, str(folder))
    frags = {r.entity_id: [tuple(f) for f in r.fragments] for r in s.entities.collect()}
    # the pieces are parted by white space only
    assert frags == {"T1": [(0, 16)], "T2": [(18, 30)]}
    apart = B.read_standoff_full(spark, str(folder), merge_spaced=False).entities.where("entity_id = 'T1'").first()
    assert [tuple(f) for f in apart.fragments] == [(0, 9), (12, 16)]
    assert {(r.attribute_id, r.target_id, r.value) for r in s.attributes.collect()} == {("A1", "T2", "Neg"), ("A2", "T1", None)}
    assert s.relations.first().to_entity_id == "T2"
    assert [tuple(a) for a in s.events.first().arguments] == [("Test", "T1"), ("Value", "T2")]
    assert s.bad_lines.count() == 0


def test_malformed_lines(spark):
    lines = spark.createDataFrame([("a.ann", "T1\tbroken"), ("a.ann", "R1\tX Arg1:T1")], "source string, line string")
    assert B.parse_full(lines).bad_lines.count() == 2
    with pytest.raises(Exception, match="malformed"):
        B.parse_full(lines, on_error="raise").entities.collect()


def test_discovery(spark, folder):
    rows = B.discover_notes(spark, str(folder)).collect()
    assert [(r.note_id, r.text) for r in rows] == [("sub/n1", TEXT)]


def test_written_lines(spark, tmp_path):
    texts = spark.createDataFrame([("n", TEXT)], "note_id string, text string")
    ents = spark.createDataFrame(
        [("n", "e2", "Chemical_and_drugs", [(18, 26)]), ("n", "e1", "DISO", [(0, 16)])],
        "note_id string, entity_id string, label string, fragments array<struct<begin:int,end:int>>",
    )
    attrs = spark.createDataFrame(
        [("n", "e2", "Negation", "Neg"), ("n", "e1", "Negation", "Neg")], "note_id string, entity_id string, label string, value string"
    )
    lines = B.standoff_lines(ents, texts, attrs)
    B.write_standoff(lines, str(tmp_path / "out"), 4)
    got = [r.line for r in spark.read.parquet(str(tmp_path / "out")).orderBy("entity_no", "attribute_no").collect()]
    assert got == ["T1\tDISO 0 9;12 16\tFièvre et toux", "T2\tChemical_and_drugs 18 26\tAspirine", "A1\tNegation T2 Neg"]


def test_repair_and_override(spark):
    lines = ["A1\tNegation T1", "A2\tFamily T1 Relative", "A3\tAllergie T2", "T1\tTemporal 0 1\tx", "A4\tAttTemp T1 Date", "A5\tTech T9 Device"]
    df = spark.createDataFrame([("a", x) for x in lines], "source string, line string")
    fixed = {r.line for r in B.repair_attributes(df).collect()}
    assert {"A1\tNegation T1 Neg", "A2\tFamily T1 Relative", "A3\tAllergie T2 Allergic"} <= fixed
    out = {r.line for r in B.override_labels(df).collect()}
    assert "T1\tDate 0 1\tx" in out and "A4\tAttTemp T1 Date" not in out and "A5\tTech T9 Device" in out
    assert len(out) == 5


def test_drop_unannotated(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "source string")
    lines = spark.createDataFrame([("a", "T1\tX 0 1\tx"), ("b", "")], "source string, line string")
    assert [r.source for r in B.drop_unannotated(docs, lines).collect()] == ["a"]


def test_vocabulary_without_quoting(spark, tmp_path):
    from chartloom.sources.tables import read_vocabulary

    line = "C1|FRE|||||||||" + "|ATC||B01|l'\"acide" + "|||\n"
    (tmp_path / "names.rrf").write_text(line, encoding="utf-8")
    row = read_vocabulary(spark, str(tmp_path / "names.rrf")).first()
    assert (row.concept_id, row.language, row.vocabulary, row.code, row.str) == ("C1", "FRE", "ATC", "B01", "l'\"acide")
