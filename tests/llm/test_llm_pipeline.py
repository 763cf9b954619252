"""The pipeline stage by stage against plain versions, and on odd rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
import llm_brute as brute
from chartloom.llm.tables import documents
from test_llm_edges import ROWS, labels, odd  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SF)


def test_names():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "repeats", "packing"]


def test_line_stage(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    marks = brute.line_marks(rows)
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.distinct_lines(spark, docs, SF).collect()}
    for i, t in rows:
        gone = {k for k, m in marks[i, t].items() if any(m)}
        if gone and len(gone) == len(marks[i, t]):
            assert i not in got
        else:
            left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
            assert got[i] == (left, len(left))


def test_near_duplicate_stage(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute.components(rows)
    out = pipeline.one_near_duplicate(spark, docs, SF)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i, t in rows if want[i, t][2]}


def test_repeat_stage(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute.repeats(rows)
    got = {r.doc_id: r for r in pipeline.without_repeats(spark, docs, SF).collect()}
    for i, t in rows:
        gone, at, left = want[i, t][4], 0, []
        for c in t:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                left.append(c)
            at += n
        left = "".join(left)
        if any(gone) and not brute.words(left):
            assert i not in got
        else:
            assert (got[i].text, got[i].n_chars) == (left, len(left))


def test_quality_stage(spark, docs):
    from chartloom.llm import quality
    from chartloom.llm.tables import labels as label_table

    kept = {r.doc_id for r in quality.scored(docs, label_table(spark, SF)).collect() if r.predicted}
    out = pipeline.good_quality(spark, docs, SF)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept


@pytest.mark.parametrize("k", range(1, 5))
def test_odd_rows(spark, odd, k):  # noqa: F811
    """Stages after the first, each on the odd rows: nothing breaks, columns stay."""
    out = pipeline.STAGES[k][1](spark, odd, SF)
    if k < 4:
        assert out.columns == odd.columns
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(ids) <= {i for i, _ in ROWS} and len(ids) <= len(ROWS)
        assert out.where("text is not null and n_chars <> length(text)").count() == 0
        assert pipeline.STAGES[k][1](spark, odd.where("false"), SF).count() == 0
    else:
        assert out.select("doc_id").distinct().count() == len({i for i, _ in ROWS})


def test_quality_on_odd_rows(spark, odd, labels):  # noqa: F811
    from chartloom.llm import quality

    out = quality.accepted(odd, labels)
    assert out.columns == odd.columns and quality.accepted(odd.where("false"), labels).count() == 0


def test_whole_pipeline(spark):
    out = pipeline.run(spark, SF)
    per = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert per.where("n <> end or n > 1024").count() == 0 and out.count() > 100
