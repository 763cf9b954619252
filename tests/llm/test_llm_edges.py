"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import random

import pytest
from pyspark.sql import functions as F

import llm_brute as brute
from chartloom.llm import language, line_join, line_rules, minhash_forest, ngram, packing, quality, repeats, segmentation, syncmers

rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]


def text(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


LONG = "\n".join(text(40) for _ in range(300))
SHARED = text(60)
ROWS = [
    (0, None),
    (1, ""),
    (2, " \n\t \r\n"),
    (3, "one"),
    (4, LONG),
    (5, SHARED + "\n" + text(30)),
    (6, text(20) + "\n" + SHARED),
    (7, SHARED + "\n" + text(30)),
    (7, SHARED + "\n" + "another text of the same id " + text(12)),
    (8, text(35)),
    (8, None),
    (None, "no id " + text(25)),
    (None, SHARED),
    (-3, "é" * 70 + " 漢字 🙂 " + text(9)),
    (9, "x" * 3000),
    (10, "x" * 2999 + "y"),
    (11, "Und " * 400),
    (12, text(6) + "  double  space \x0b\x0c end "),
]
ROWS += [(13, ROWS[9][1]), (14, ROWS[9][1].upper()), (15, "a b c\na b c\nd e f g h\nd e f g h")]
ROWS.append(ROWS[8])  # a repeated row
CLASHES = ["key", "id", "_id", "node", "rep", "_own", "_places", "lines_removed", "lines_left", "_gone", "_kept", "_sha", "_hash", "score", "n", "place", "bucket", "label", "host"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(i, t, "en" if t and k % 2 else None, None if k % 3 else "src", len(t or "")) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(c).alias(c) for c in CLASHES]).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, q) for i in range(-3, 16) for q in (i % 2, None)] + [(None, 1), (4, 7)], "doc_id long, quality int")


OPERATORS = {
    "language": lambda d, lab: language.identified(d),
    "line_join": lambda d, lab: line_join.line_counts(d),
    "syncmers": lambda d, lab: syncmers.fingerprints(d),
    "quality": lambda d, lab: quality.scored(d, lab),
    "packing": lambda d, lab: packing.packed(d),
    "minhash_forest": lambda d, lab: minhash_forest.near_duplicates(d),
    "segmentation": lambda d, lab: segmentation.encoded(d),
    "repeats": lambda d, lab: repeats.removed(d),
    "line_rules": lambda d, lab: line_rules.judge(d),
    "ngram": lambda d, lab: ngram.scored(d, ngram.held_out),
}


@pytest.fixture(scope="module")
def results(odd, labels):
    return {name: run(odd, labels).collect() for name, run in OPERATORS.items()}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(odd, labels, name):
    assert OPERATORS[name](odd.where("false"), labels.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"packing"}))
def test_one_row_for_each(results, name):
    key = lambda i: (i is None, i or 0)
    assert sorted((r.doc_id for r in results[name]), key=key) == sorted((i for i, _ in ROWS), key=key)


def rows_of(results, name, i):
    return [r for r in results[name] if r.doc_id == i]


def test_language(results):
    by = {r.doc_id: r for r in results["language"] if r.doc_id not in (7, 8, None)}
    assert {by[i].lang_pred for i in (0, 1, 2)} == {"und"} and by[4].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in results["language"])


def test_numbers_are_no_letters(odd, labels, spark):
    """Fractions, raised and circled digits and Roman numeral signs are numbers: a text of them is undetermined."""
    rows = [(100 + k, t, None) for k, t in enumerate(["½ ² ①", "Ⅷ ١٢ 12_", "ª", "x²"])]
    texts = odd.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r.doc_id: r.lang_pred for r in language.identified(texts).collect()}
    assert (got[100], got[101]) == ("und", "und") and got[102] == got[103] == "en"
    assert language.words_of("½a² ①b Ⅷ c_d É१") == ["a", "b", "c", "d", "é"]


def test_segmentation(results):
    assert all(r.round_trip for r in results["segmentation"])
    (empty,) = rows_of(results, "segmentation", 0)
    assert (empty.n_pieces, empty.scores) == (0, [0.0])
    assert all(r.scores == sorted(r.scores, reverse=True) and len(r.ids) == len(r.scores) for r in results["segmentation"])


def test_quality(results):
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in results["quality"])


def test_packing(results):
    by = {}
    for r in results["packing"]:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    assert [(r.piece, r.length) for r in rows_of(results, "packing", 0)] == [(0, 1)]
    long = sorted((r.piece, r.start, r.length) for r in rows_of(results, "packing", 4))
    assert all(n == 1024 for _, _, n in long[1:]) and [s for _, s, _ in long] == [sum(n for *_, n in long[:k]) for k in range(len(long))]


def test_near_duplicates(results):
    want = brute.components(ROWS)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, bool(r.kept)) for r in results["minhash_forest"]))
    assert got == sorted((i is None, i or 0, *want[i, t]) for i, t in ROWS)


def test_repeats(results):
    want = brute.repeats(ROWS)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, len(r.starts), r.kept_sha256) for r in results["repeats"] if r.doc_id not in (7, 8, None))
    assert got == sorted((False, i, *want[i, t][:4]) for i, t in ROWS if i not in (7, 8, None))
    assert sum(r.n_removed for r in results["repeats"] if r.doc_id is None) > 0


def test_line_rules(results):
    for i, t in ROWS:
        if i in (7, 8, None):
            continue
        (r,) = rows_of(results, "line_rules", i)
        w = brute.words(t)
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.n_dup_lines == brute.duplicate_lines(t) and r.n_repeat_words == brute.repeat_words(t)
        assert r.base_failed == (len(w) < 20 or 100 * r.n_repeat_words > 30 * len(w)) and not (r.base_failed and r.kept)


def test_line_join(results):
    single = [(i, t) for i, t in ROWS]
    marks = brute.line_marks(single)
    for i, t in ROWS:
        if i in (7, 8, None):
            continue
        (r,) = rows_of(results, "line_join", i)
        own = marks[i, t]
        assert r.n_lines == len(own)
    (r,) = rows_of(results, "line_join", 15)
    assert (r.n_copies, r.n_removed) == (2, 2)  # lines of any length are judged


def test_syncmers(results):
    by = {r.doc_id: r for r in results["syncmers"] if r.doc_id not in (7, 8, None)}
    for i in (0, 1, 2):
        assert by[i].fingerprint == ""
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in results["syncmers"])
    (a,), b = rows_of(results, "syncmers", 13), [r for r in rows_of(results, "syncmers", 8) if r.n_chars]
    assert {a.fingerprint} == {r.fingerprint for r in b}
    text = {i: t for i, t in ROWS}
    import hashlib

    third = len(text[15]) // 3
    edited = text[15][: len(text[15]) - third] + text[14][:third]
    assert by[15].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    lowest = text[-3]
    third = len(lowest) // 3
    assert by[-3].n_chars == len(lowest)


def test_ngram(results):
    by = {r.doc_id: r for r in results["ngram"] if r.doc_id not in (7, 8, None)}
    assert (by[0].n_tokens, by[1].n_tokens, by[2].n_tokens, by[3].n_tokens) == (1, 1, 1, 2)
    assert all(r.score <= 1e-6 and r.base_score <= 0 and 0 <= r.n_known <= r.n_tokens for r in results["ngram"])
    assert not any(r.held_out for r in rows_of(results, "ngram", None))
    assert len({(r.n_tokens, round(r.base_score, 6)) for r in rows_of(results, "ngram", 7)}) == 2
