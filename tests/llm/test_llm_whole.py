"""Where an operator has to do the whole job: cases that a cap, a limit or a shortcut would leave out."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import llm_brute as brute
from chartloom.llm import line_join, line_rules, ngram, queries, segmentation, syncmers


def test_every_token_is_a_context(spark, monkeypatch):
    """Scores equal plain counts of all pairs, however few tokens every task knows."""
    rng = random.Random(10)
    rows = [(k, " ".join("w%d" % int(rng.paretovariate(0.6)) for _ in range(rng.randrange(1, 40)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = {i for i, _ in rows if brute.held(i, 7, 2)}
    tokens = {i: [*brute.words(t), None] for i, t in rows}
    train = [ws for i, ws in tokens.items() if i not in held]
    one = Counter(w for ws in train for w in ws)
    pair = Counter(p for ws in train for p in zip(["", *ws], ws))
    before = Counter(h for ws in train for h in ["", *ws[:-1]])
    n, v = sum(one.values()), len(one)
    grow = math.log(v / (sum(len(set(ws)) for ws in train) / len(train))) / math.log(len(train))
    alone = lambda w: (one[w] + 1) / (n + v + 1)
    m = lambda h: max(v / n**grow * before[h] ** grow, 1e-9)
    want = {i: sum(math.log10((pair[h, w] + m(h) * alone(w)) / (before[h] + m(h))) for h, w in zip(["", *ws], ws)) for i, ws in tokens.items()}
    for known in (65_534, 4, 1):
        monkeypatch.setattr(ngram, "COMMON", known)
        got = {r.doc_id: r for r in ngram.scored(df, ngram.held_out).collect()}
        for i, ws in tokens.items():
            assert got[i].score == pytest.approx(want[i], abs=len(ws) / ngram.QUANTA)
            assert got[i].base_score == pytest.approx(sum(math.log10(alone(w)) for w in ws), rel=1e-9)
            assert (got[i].n_tokens, got[i].n_known) == (len(ws), sum(one[w] > 0 for w in ws))


def test_words_of_one_short_hash_differ(spark):
    """Lines that differ in one word whose 32-bit hashes are equal aren't copies."""
    numbers = spark.range(300_000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("w"))
    clash = numbers.groupBy(F.hash("w")).agg(F.sort_array(F.collect_list("w")).alias("w")).where("size(w) > 1").first().w
    rest = "invoice to be paid by"
    df = spark.createDataFrame([(k, f"{rest} {w}") for k, w in enumerate([*clash[:2], clash[0]])], "doc_id long, text string")
    got = {r.doc_id: (r.n_copies, r.n_similar) for r in line_join.line_counts(df).collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (1, 0)}


def test_short_lines_are_copies(spark, tmp_path):
    """The registered query counts copies of lines of any length with a word."""
    rows = [(0, "Read more\nown words of the first"), (1, "a a a a a a\nRead more"), (2, "more Read\n\na\none two three four"), (3, "Read less")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_copies, r.n_similar, r.n_removed) for r in queries.op2_line_join(spark, str(tmp_path)).collect()}
    assert got == {0: (2, 0, 0, 0), 1: (2, 1, 0, 1), 2: (3, 2, 0, 2), 3: (1, 0, 0, 0)}
    marks = brute.line_marks(rows, least=1)
    assert all(got[i][1] == sum(c for c, _ in marks[i, t].values()) for i, t in rows)


def test_all_segmentations_are_given(spark, tmp_path):
    """The registered query gives the pieces of each of the four best, different ones that all decode to the text."""
    rows = [(0, "the thsteden of a house"), (1, "unbelievable 漢字"), (2, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pieces = segmentation.Pieces(segmentation.vocabulary())
    for r in queries.op7_segmentation(spark, str(tmp_path)).collect():
        assert len(r.ids) == len(r.scores) == len({tuple(x) for x in r.ids}) == (4 if r.doc_id < 2 else 1)
        assert all(pieces.decode(x) == rows[r.doc_id][1] for x in r.ids) and r.round_trip
        assert r.each_pieces == [len(x) for x in r.ids] and r.each_crc32 == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in r.ids]
        assert (r.n_pieces, r.ids_crc32) == (r.each_pieces[0], r.each_crc32[0])


def test_limit_does_not_grow_with_the_host(spark):
    """A line of six documents goes in a host of 5,000 as in one of six, one of five stays in both."""
    rows = [(k, ("menu home\n" if k % 5000 < 6 else "share this\n" if k % 5000 < 11 else "") + f"own words of {chr(97 + k % 26) * (k // 26 + 1)}", "hot") for k in range(5000)]
    rows += [(9000 + k, f"menu home\nfoot {'x' * (k + 1)}" + ("\nshare this" if k else ""), "small") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = sorted((r.host, r.n_documents) for r in line_rules.boilerplate(df).collect())
    assert found == [("hot", 6), ("small", 6)]
    removed = {r.doc_id: r.removed_lines for r in line_rules.judge(df).collect()}
    assert sum(removed[k] for k in range(5000)) == 6 and all(removed[9000 + k] == 1 for k in range(6))


def test_short_texts_have_anchors(spark):
    """Every text with a word has an anchor; unrelated short texts are not alike."""
    rows = [(k, " ".join("t%dw%d" % (k, i) for i in range(1 + k % 10))) for k in range(80)]
    df = syncmers.with_anchors(spark.createDataFrame(rows, "doc_id long, text string"), "text", "a")
    assert df.where("size(a) = 0").count() == 0
    found = syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.where("near_next > 0 or n_anchors = 0").count() == 0


def test_edits_of_text_without_spaces_are_local(spark):
    """One code point ahead of a long run without spaces leaves the anchors behind it."""
    rng = random.Random(3)
    run = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(300))
    df = syncmers.with_anchors(spark.createDataFrame([(0, run), (1, "\u6f22" + run)], "doc_id long, text string"), "text", "a")
    a, b = ({x.hash for x in r.a} for r in df.orderBy("doc_id").collect())
    assert a <= b and len(a) > 50 and len(b) <= len(a) + 1
