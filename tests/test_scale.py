"""Results against brute force on small tables where one key holds most rows, and plans."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.operators import codes as K
from chartloom.operators import cohort as C
from chartloom.operators import interpret as I
from chartloom.operators import lists as L
from chartloom.operators import match as M
from chartloom.operators import measure as X
from chartloom.operators import notes as N
from chartloom.operators import quantiles as Q
from chartloom.operators import resample as R
from chartloom.operators import rollup as U
from chartloom.operators import score as S
from chartloom.operators import spans as P
from chartloom.sources.codelists import code_table

rng = random.Random(7)
SPAN = "source string, span_start int, span_end int, label string"


def spans(n, width, hot=0.6, top=400):
    out = set()
    while len(out) < n:
        s = rng.randrange(top)
        out.add(("hot" if rng.random() < hot else f"d{rng.randrange(5)}", s, s + 1 + rng.randrange(width), rng.choice("ab")))
    return sorted(out)


@pytest.mark.parametrize("block", [16, 1000])
def test_span_joins(spark, block):
    a, b = spans(150, 60), spans(150, 20)
    da, db = spark.createDataFrame(a + a[:20], SPAN), spark.createDataFrame(b, SPAN)
    inside = {(x, y) for x in a for y in b if x[0] == y[0] and x[1] <= y[1] and x[2] >= y[2]}
    got = P.containment_join(da, db, block=block).collect()
    assert {(tuple(r)[:4], tuple(r)[4:]) for r in got if r.source_inner} == inside
    lonely = [tuple(r)[:4] for r in got if not r.source_inner]
    assert sorted(lonely) == sorted(set(a) - {x for x, _ in inside})
    assert len(got) == len(inside) + len(lonely)

    touching = {(x, y) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1]}
    both = P.overlap_join(spark.createDataFrame(a, SPAN), db, block=block).collect()
    assert {(tuple(r)[:4], tuple(r)[4:]) for r in both} == touching and len(both) == len(touching)
    assert inside <= touching


def test_containment_at_every_width(spark):
    """Outer spans of very different lengths: each pair meets once, and a long one changes no other's block."""
    rng = random.Random(3)
    a = [("n", s, s + 4**k + rng.randrange(3), f"o{k}") for k in range(13) for s in (0, 5, 4**k, 3 * 4**k + 1, rng.randrange(4**12))]
    a += [("n", -40, -3, "below zero"), ("n", 9, 9, "empty"), (None, 0, 9, "no note"), ("n", None, 9, "no start")]
    b = [("n", s, s + rng.randrange(5), "i") for s in [0, 5, 9, 10, *[4**k + d for k in range(13) for d in (-2, -1, 0, 1)], -20]] + [("n", 3, 4**11, "long")]
    a, b = sorted(set(a), key=str), sorted(set(b), key=str)
    inside = {(x, y) for x in a for y in b if x[0] == y[0] and x[1] is not None and x[1] <= y[1] and x[2] >= y[2]}
    got = P.containment_join(spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN), block=4).collect()
    assert {(tuple(r)[:4], tuple(r)[4:]) for r in got if r.source_inner} == inside
    assert len(got) == len(inside) + len(set(a) - {x for x, _ in inside})


def greedy(rows):
    keep = []
    for r in sorted(rows, key=lambda r: (r[1] - r[2], r[1], r[3])):
        if all(r[2] <= k[1] or r[1] >= k[2] for k in keep):
            keep.append(r)
    return set(keep)


def resolved(spark, rows):
    want = set().union(*[greedy([r for r in rows if r[0] == d]) for d in {r[0] for r in rows}]) if rows else set()
    got = N.resolve_overlaps(spark.createDataFrame(rows, SPAN), "source").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_resolve_overlaps(spark):
    resolved(spark, spans(250, 15))
    resolved(spark, [])


def test_resolve_overlaps_in_crowded_places(spark):
    rng = random.Random(8)
    # many spans over one place, a span as long as the note, a staircase in which each span hangs on the one before
    rows = [("n", 500 - rng.randrange(60), 500 + rng.randrange(1, 60), "c%d" % k) for k in range(300)]
    rows += [("n", 2000 + 10 * k, 2030 + 10 * k - k % 12, "stairs") for k in range(40)] + [("m", 0, 5_000_000, "whole")]
    rows += [("m", 7 * k, 7 * k + 5, "inside") for k in range(50)] + [("m", 5_000_000, 5_000_003, "after")] + rows[:5]
    resolved(spark, rows)


def test_resolve_overlaps_of_odd_spans(spark):
    rows = [("n", 3, 8, "a"), ("n", 5, 5, "empty inside"), ("n", 3, 3, "empty at start"), ("n", 8, 8, "empty at end"), ("n", 8, 8, "another"), ("n", 8, 9, "b"), ("n", 8, 9, "c"), (None, 4, 6, "no note"), (None, 5, 6, "nor here")]
    got = {tuple(r) for r in N.resolve_overlaps(spark.createDataFrame(rows + [("n", None, 4, "no start")], SPAN), "source").collect()}
    assert got == greedy([r for r in rows if r[0]]) | {(None, 4, 6, "no note"), ("n", None, 4, "no start")}


def test_spans_that_meet_none_are_settled_at_once(spark):
    """The rounds see the spans that meet another one, also over the edges of position blocks; what is written follows the rows."""
    rng, b = random.Random(11), P.BLOCK
    rows = [(d, s, s + rng.randrange(0, 30), "ab"[s % 2]) for d in ("n", "m", None) for k in range(1, 4) for s in (rng.randrange(k * b - 60, k * b + 60) for _ in range(4))]
    rows += [("n", 9 * b, 12 * b, "long"), ("n", 11 * b, 11 * b + 2, "inside"), ("n", 13 * b, 13 * b + 1, "alone"), ("n", None, 4, "no start"), ("n", 5, None, "no end"), ("n", 20, 20, "empty")]
    place = lambda r: (2 * r[1], 2 * r[2] - 2) if r[2] > r[1] else (2 * r[1] - 1,) * 2
    known = [r for r in set(rows) if None not in r[1:3]]
    meet = {r for r in known for o in known if r != o and r[0] == o[0] and place(r)[0] <= place(o)[1] and place(o)[0] <= place(r)[1]}
    got = [tuple(r) for r in N._met(spark.createDataFrame(rows + rows[:3], SPAN), "source").collect()]
    assert {r[:4] for r in got if r[4]} == meet and sorted((r[:4] for r in got), key=str) == sorted(set(rows), key=str)

    size = lambda: sum(f.stat().st_size for f in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).rglob("*") if f.is_file())
    lonely, before = [(f"n{i % 50}", 40 * i, 40 * i + 12, "ab"[i % 2]) for i in range(20_000)], size()
    assert N.resolve_overlaps(spark.createDataFrame(lonely, SPAN), "source").count() == 20_000
    assert size() - before < 15 * 20_000  # bytes a span

    tagged = N.tag_terms(spark.createDataFrame([("n", "the cat , the")], "note_id string, text string"), spark.createDataFrame([("the", "D"), ("cat", "A")], "term string, label string"), 2)
    assert tagged.count() == 3 and "hashpartitioning(note_id" not in plan(tagged)  # hits are not moved again


def pack(tokens, cap, spans=()):
    """Word ranges of the chunks of one note, by a plain loop."""
    ends = [i + 1 for i, t in enumerate(tokens) if t.endswith(".") and i + 1 < len(tokens)]
    at = np.cumsum([0] + [len(t) + 1 for t in tokens])
    ends = [e for e in ends if not any(s <= at[e] < f for s, f in spans)] + [len(tokens)]
    out, start = [], 0
    for e in ends:
        if e - start > cap:
            while e - start > cap:
                out.append((start, start + cap))
                start += cap
            out.append((start, e))
            start = e
    if start < len(tokens):
        out.append((start, len(tokens)))
    return out


def test_chunks(spark):
    notes = []
    for i in range(12):
        words = [rng.choice(["aa", "b", "ccc.", "dd"]) for _ in range(rng.randrange(1, 300))]
        notes.append((f"n{i}", " ".join(words)))
    df = spark.createDataFrame(notes, "note_id string, text string")
    marks = spark.createDataFrame([("n0", 5, 60), ("n1", 0, 9)], "note_id string, span_start int, span_end int")
    for cap in (7, 40):
        got = N.chunk_notes(df, marks, cap).collect()
        for note, text in notes:
            want = pack(text.split(" "), cap, {"n0": [(5, 60)], "n1": [(0, 9)]}.get(note, ()))
            mine = sorted((r.start, r.end) for r in got if r.note_id == note)
            assert mine == want
            for r in got:
                if r.note_id == note:
                    assert r.text == text[r.span_start : r.span_end] == " ".join(text.split(" ")[r.start : r.end])
                    assert r.end - r.start <= cap


def test_tagging_crosses_rows(spark):
    text = " ".join(["x"] * 31 + ["Foo,", "bar."] + ["y"] * 5000 + ["foo"])
    notes = spark.createDataFrame([("n", text)], "note_id string, text string")
    terms = spark.createDataFrame([("foo", "A"), ("foo, bar", "B")], "term string, label string")
    got = N.tag_terms(notes, terms, 2).collect()
    assert {(r.term, r.lexical_variant) for r in got} == {("foo", "Foo"), ("foo, bar", "Foo, bar"), ("foo", "foo")}
    assert all(text[r.span_start : r.span_end] == r.lexical_variant for r in got)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [10, 4, 2, 1, 0])
def test_edit_matches(spark, threshold):
    def word():
        return "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 16)))

    names, terms = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)} | {"", "z" * 30, "é漢a"})
    names += [terms[3], terms[9][:-1] + "x", "z" * 22, "é漢b"]
    names = sorted(set(names) - {""})
    got = M.edit_matches(
        spark.createDataFrame([(t,) for t in terms], "term_to_norm string"),
        spark.createDataFrame([(n,) for n in names], "norm_term string"), threshold,
    ).collect()
    want = set()
    for t in terms:
        scores = {n: 1 - distance(t, n) / max(len(t), len(n)) for n in names if distance(t, n) < threshold}
        want |= {(t, n) for n, s in scores.items() if abs(s - max(scores.values())) < 1e-12}
    assert {(r.term_to_norm, r.norm_term) for r in got} == want and len(got) == len(want)


def test_jaro_winkler_blocks_agree(spark):
    names = [(f"{a} {b}",) for a in ("prednisone", "prednisolone", "rituximab", "heparine") for b in ("fort", "x")]
    terms = spark.createDataFrame([("prednisonne fort",), ("ritximab x",), ("zzz",)], "term_to_norm string")
    df = spark.createDataFrame(names, "norm_term string")
    whole = M.jaro_winkler_matches(terms, df, 0.8).collect()
    blocks = M.jaro_winkler_matches(terms, df, 0.8, block_terms=1, block_names=2).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, blocks))
    assert {r.term_to_norm: r.norm_term for r in whole} == {"prednisonne fort": "prednisone fort", "ritximab x": "rituximab x"}


def test_match_terms_keeps_unmatched_and_ties(spark):
    mentions = spark.createDataFrame(
        [("RTX", "a", 0, 3), ("RTX", "a", 0, 3), ("inconnu", "a", 9, 16)], "term string, source string, span_start int, span_end int"
    )
    dictionary = spark.createDataFrame([("L01XC02", "rituximab"), ("L01FA01", " Rituximab"), ("X", None)], "label string, norm_term string")
    got = {r.term: (r.label, r.norm_term, r.score) for r in M.match_terms(mentions, dictionary).collect()}
    assert got == {"RTX": (["L01FA01", "L01XC02"], ["rituximab"], 1.0), "inconnu": ([], [], None)}


def test_nearest_blocks_agree(spark):
    g = np.random.default_rng(1)
    v, w = g.normal(size=(40, 8)).astype("float32"), g.normal(size=(30, 8)).astype("float32")
    w[7] = w[3]  # a tie: the smaller id wins
    v[0] = w[3] * 2
    dv = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<float>")
    dw = spark.createDataFrame([(i, str(i), f"n{i}", x.tolist()) for i, x in enumerate(w)], "vocab_id long, label string, norm_term string, vec array<float>")
    sim = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (w / np.linalg.norm(w, axis=1, keepdims=True)).T
    for blocks in ({}, dict(block_rows=9, block_vocab=4)):
        got = {r.id: r.vocab_id for r in M.nearest_concept(dv, dw, **blocks).collect()}
        assert got[0] == 3 and [got[i] for i in range(40)][1:] == sim.argmax(axis=1).tolist()[1:]


def test_exact_quantiles(spark):
    values = [("hot", float(rng.choice([1, 1, 1, 2, 3, 50, 1000]))) for _ in range(300)] + [("one", 4.0), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(values, "k string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.k, r.prob): r.quantile for r in Q.exact_quantiles(df, ["k"], "v", probs).collect()}
    for k in ("hot", "one", "two"):
        for p in probs:
            assert got[k, p] == pytest.approx(np.quantile([v for x, v in values if x == k], p))


def test_quantiles_with_one_outlier(spark):
    """One value of 1e12 must not put all others into one task: ranges follow the data."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.when(F.col("id") == 7, 1e12).otherwise(F.col("id") / 7).alias("v"))
    got = {r.prob: r.quantile for r in Q.exact_quantiles(df, ["k"], "v", [0.25, 0.5, 1.0]).collect()}
    values = [1e12 if i == 7 else i / 7 for i in range(20_000)]
    assert [got[p] for p in (0.25, 0.5, 1.0)] == pytest.approx([np.quantile(values, p) for p in (0.25, 0.5, 1.0)])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(tasks, "k", "v").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == tasks and max(r["count"] for r in spread) < 2 * 20_000 / tasks


def test_number_within_and_lists(spark):
    rows = [("hot", rng.randrange(10_000), i) for i in range(300)] + [("b", 5, 0)]
    df = spark.createDataFrame(rows, "k string, pos int, i int")
    got = {(r.k, r.i): r.rn for r in L.number_within(df, ["k"], "pos", ["i"], width=64).collect()}
    order = sorted(r for r in rows if r[0] == "hot")
    assert [got["hot", r[2]] for r in order] == list(range(1, 301))


@pytest.mark.parametrize("size", [5, 50_000])
def test_numbering_has_one_row_shape_at_every_size(spark, size):
    df = spark.range(size).select(F.lit("hot").alias("k"), F.format_string("%06d", "id").alias("name"))
    df = df.union(spark.createDataFrame([("b", "x"), (None, "y")], "k string, name string"))
    got = L.number_sorted(df, ["k"], ["name"], "position")
    assert got.columns == ["k", "name", "position"] and got.count() == size + 2
    hot = got.where("k = 'hot'")
    assert hot.where(F.col("position") != F.col("name").cast("int") + 1).count() == 0
    assert {(r.k, r.position) for r in got.where("k is null or k = 'b'").collect()} == {("b", 1), (None, 1)}


def test_copies_of_one_text(spark):
    ids = [(f"{i:03d}", "x" * 2000 if i < 200 else f"{i}" * 800, i, i, "2020-01-01") for i in range(230)]
    notes = spark.createDataFrame(ids, "instance_num string, observation_blob string, encounter_num int, patient_num int, note_date string")
    notes = notes.withColumn("concept_cd", F.lit("CR:CRH-S"))
    diagnoses = spark.range(230).select(F.col("id").cast("int").alias("encounter_num"), F.lit("CIM10:M32").alias("concept_cd"))
    visits = spark.range(230).select(F.col("id").cast("int").alias("encounter_num"), F.lit(40).alias("age_visit_in_years_num"), F.lit("2020").alias("start_date"))
    codes = C.disease_codes(spark, {"lupus": ["M32"]})
    cohort = C.cohort_notes(notes, diagnoses, visits, codes).collect()
    assert len(cohort) == 31 and {r.n_copies for r in cohort} == {1, 200}
    groups = C.note_groups(C.cohort_rows(notes, diagnoses, visits, codes))
    numbered = C.numbered_note_ids(groups).collect()
    assert sorted(r.instance_num for r in numbered) == [r[0] for r in ids]
    assert sorted(r.position for r in numbered) == sorted([*range(1, 201), *[1] * 30])


def test_cohort_note_with_two_rows_of_one_id(spark):
    rows = [("a", "x" * 1500, 1, 1, "2020-01-01"), ("a", "y" * 1500, 2, 2, "2020-01-02")]
    notes = spark.createDataFrame(rows, "instance_num string, observation_blob string, encounter_num int, patient_num int, note_date string")
    notes = notes.withColumn("concept_cd", F.lit("CR:CRH-S"))
    diagnoses = spark.createDataFrame([(1, "CIM10:M32"), (2, "CIM10:M32")], "encounter_num int, concept_cd string")
    visits = spark.createDataFrame([(1, 40, "2020"), (2, 41, "2020")], "encounter_num int, age_visit_in_years_num int, start_date string")
    got = C.cohort_notes(notes, diagnoses, visits, C.disease_codes(spark, {"lupus": ["M32"]})).collect()
    assert sorted((r.encounter_num, r.observation_blob[0]) for r in got) == [(1, "x"), (2, "y")]


def test_entity_bootstrap_is_centred(spark):
    counts = spark.createDataFrame([("a", 80, 10, 20), ("b", 40, 40, 10)], "label string, tp long, fp long, fn long")
    draws = R.bootstrap_entities(counts, 400, 1).toPandas()
    assert draws[draws.draw == 0].set_index("label").tp.to_dict() == {"a": 80, "b": 40}
    assert (draws.groupby("draw")[["tp", "fp", "fn"]].sum().sum(axis=1) == 200).all()
    means = draws[draws.draw > 0].groupby("label").tp.mean()
    assert abs(means["a"] - 80) < 2 and abs(means["b"] - 40) < 2


def test_document_bootstrap_draws_all_documents(spark):
    counts = spark.createDataFrame([(f"d{i}", "a", i % 3, 1, 0) for i in range(50)], "source string, label string, tp long, fp long, fn long")
    draws = R.bootstrap_docs(counts, 60, 3).toPandas()
    assert (draws.fp == 50).all() and draws.tp[draws.draw > 0].nunique() > 5
    assert int(draws.tp[draws.draw == 0].iloc[0]) == sum(i % 3 for i in range(50))


def test_scores_without_denominator(spark):
    counts = spark.createDataFrame([("a", 0, 0, 0), ("b", 0, 2, 0), ("c", 0, 0, 3)], "label string, tp long, fp long, fn long")
    got = {r.label: (r.precision, r.recall, r.f1) for r in S.prf(counts).collect()}
    assert got == {"a": (100.0, 100.0, 100.0), "b": (0.0, 100.0, 0.0), "c": (100.0, 0.0, 0.0)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    df = spark.createDataFrame([("a", 1, 0.5)], "k string, id int, score double")
    assert "WindowGroupLimit" in plan(L.sample_per_group(df, "k", ["id"], 3))
    assert "WindowGroupLimit" in plan(L.keep_top_ties(df, ["k"], "score"))
    from chartloom.catalog import load

    for name in ("containment_join", "overlap_join", "exact_match_counts", "edit_distance_matches", "values_by_source"):
        text = plan(load()[name].run(spark, "/root/testdata/sf0.001"))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
    scan = plan(load()["cohort_notes"].run(spark, "/root/testdata/sf0.001"))
    assert "PushedFilters: [" in scan and "n_chars" not in scan.split("ReadSchema")[1]


def test_value_sets_are_not_dealt_by_concept(spark):
    """Few concepts: a join with the tables of units and limits must not move all results to a task per concept."""
    rows = spark.range(200).select(
        (F.col("id") % 50).alias("patient_num"), F.lit("CRP").alias("concept"), F.lit("MG/L").alias("unit"), (F.col("id") % 7).cast("double").alias("value")
    )
    rates = I.unit_table(spark, {"CRP": {"mg/l": 1, "mg/dl": 10}, "Hb": {"g/dl": 1}})
    limits = I.limit_table(spark, {"CRP": 5, "Hb": 30})
    got = U.value_sets(rows, rows.where("patient_num < 10"), rates, limits)
    found = {tuple(r) for r in got.select("patient_num", "value", "method").collect()}
    both = {(p, float(i % 7)) for i in range(200) for p in [i % 50] if i % 7 <= 5}
    few = {x for x in both if x[0] < 10}
    assert found == {(*x, U.TEXT) for x in both} | {(*x, U.STRUCTURED) for x in few} | {(*x, U.BENEFIT) for x in both - few} | {(*x, U.BOTH) for x in both}
    assert "hashpartitioning(concept" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_frequent_term_is_spread(spark):
    """Phrases of one term meet the list in many tasks, and are not broadcast where the rows of texts are few."""
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        notes = spark.createDataFrame([(f"n{k}", "the " * 40) for k in range(30)] + [(None, "the cat")], "note_id string, text string")
        terms = spark.createDataFrame([("the", "D"), ("The", "E"), ("dog", "N")], "term string, label string")
        got = N.tag_terms(notes, terms, 2)
        found = [tuple(r) for r in got.select("note_id", "span_start", "span_end", "lexical_variant", "label").collect()]
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    at = [(f"n{k}", 4 * i) for k in range(30) for i in range(40)] + [(None, 0)]
    assert sorted(found, key=str) == sorted([(n, s, s + 3, "the", label) for n, s in at for label in "DE"], key=str)
    assert "Broadcast" not in plan.split("== Initial Plan ==")[0] and "hashpartitioning(_key#" in plan and "_share" in plan


def test_mentions_are_not_shuffled_again_after_their_join(spark):
    """Parsed mentions meet the vocabulary where the containment join left them, and the widths of spans cost no shuffle."""
    i = F.col("id")
    text = F.concat(F.element_at(F.array(F.lit("CRP "), F.lit("Hemoglobine "), F.lit("Autre ")), (i % 3 + 1).cast("int")), (i % 40).cast("string"), F.lit(" mg/l"))
    rows = spark.range(3000).select(F.concat((i % 400).cast("string"), F.lit(".ann")).alias("source"), text.alias("term"), text.alias("lexical_variant"), (i * 50).cast("int").alias("span_start"))
    outer = rows.select("*", (F.col("span_start") + F.length("term")).alias("span_end"), F.lit("BIO_comp").alias("label"))
    name = F.split("term", " ")[0]
    inner = rows.select("source", name.alias("term"), name.alias("lexical_variant"), "span_start", (F.col("span_start") + F.length(name)).alias("span_end"), F.lit("BIO").alias("label")).where("term <> 'Autre'")
    # made from a table of thousands of rows, though its names are few
    names = spark.range(40_000).select((F.col("id") % 2).alias("k")).select(F.concat(F.lit("L"), F.col("k")).alias("label"), F.when(F.col("k") == 0, "crp").otherwise("hemoglobine").alias("norm_term"))

    def found(placed):
        parsed = X.parse_measurements(outer, inner, placed=placed).withColumn("term", F.col("lexical_variant"))
        matched = M.match_terms(parsed, names, "exact", within=P.PLACE if placed else ())
        return matched.select("source", "span_start", "span_start_bio", "value_cleaned", "unit", "label", "score")

    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        moved = [line for line in plan(found(True)).splitlines() if "Exchange hashpartitioning" in line]
        a, b = ([str(r) for r in found(placed).collect()] for placed in (True, False))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted(a) == sorted(b) and len(a) == 3000 and sum("label=['L" in r for r in a) == 2000
    # mentions and inner mentions, each for its repeated rows and for the join
    assert len([line for line in moved if "source" in line]) == 4, moved


def test_code_lists_do_not_gather_rows(spark):
    rows = spark.range(100).select(F.lit("lupus").alias("disease"), "id", F.when(F.col("id") % 4 == 0, "H02AB").otherwise("H02AB07").alias("code"))
    codes = code_table(spark, {"lupus": {"steroid": ["H02AB"], "other": ["H02AB07"]}})
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # rows of any number
    try:
        got = K.filter_by_code_prefix(rows, codes, "code")
        by = Counter((r.code, r.concept, r.match_level) for r in got.collect())
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert by == {("H02AB", "steroid", "full"): 25, ("H02AB07", "other", "full"): 75, ("H02AB", "steroid", "prefix"): 100}
    assert "hashpartitioning" not in plan
