"""Operators against plain versions and on the smallest given tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import llm_brute as brute
from chartloom.llm import blocks, graph, language, line_join, line_rules, minhash_forest, ngram, packing, quality, repeats, segmentation, syncmers
from chartloom.llm.tables import documents, labels

SF = "/root/testdata/sf0.001"
rng = random.Random(3)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SF)


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def near_copies(n, edits):
    words = ["w%03d" % rng.randrange(700) for _ in range(150)]
    out = []
    for k in range(n):
        w = list(words)
        for _ in range(k % edits):
            w[rng.randrange(len(w))] = "e%05d" % rng.randrange(10**5)
        out.append((1000 + k, " ".join(w[:50]) + "\n" + " ".join(w[50:100]) + "\n" + " ".join(w[100:])))
    return out


def test_near_duplicates(spark, texts, monkeypatch):
    monkeypatch.setattr(minhash_forest, "BLOCK", 20)  # regions of copies are split again and dealt out
    rows = texts + near_copies(70, 7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_forest.near_duplicates(df).collect()}
    assert got == {i: want[i, t] for i, t in rows}


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (500, 40)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in [*range(41), 500]) and all(got[100 + k] == 100 for k in range(60)) and len(got) == 102
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeats(spark, texts):
    rows = texts + near_copies(30, 4)
    want = brute.repeats(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.starts), r.kept_sha256) for r in repeats.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: want[i, t][:4] for i, t in rows}


def test_repeats_in_segments(spark, monkeypatch):
    """Phrases cut at segment borders change nothing."""
    base = " ".join("s%04d" % rng.randrange(5000) for _ in range(500))
    rows = [(1, base), (2, base[700:2200] + " tail"), (3, "head " + base[100:900])]
    want = brute.repeats(rows)
    raw = np.frombuffer(rows[0][1].encode(), np.uint8)
    monkeypatch.setattr(repeats.bytesets, "SLICE", 300)
    owner, start, length, _, _ = repeats._parse(raw, np.array([0, len(raw)]))
    covered = np.concatenate([np.arange(s, s + n) for s, n in zip(start, length)])
    assert sorted(covered.tolist()) == list(range(len(raw) - repeats.SPAN + 1)) and not owner.any()
    got = {r.doc_id: r.n_removed for r in repeats.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: want[i, t][1] for i, t in rows}


def test_blocks_round_trip():
    keys = np.array([-5, -5, 0, 3, 2**40], np.int64)
    values = np.array([0, 1, 255, 2**39, 7], np.uint64)
    (k, v), _ = blocks.read(blocks.write([(blocks.steps(keys), 8), (values, 5)]), [8, 5])
    assert blocks.keys_of(k).tolist() == keys.tolist() and v.tolist() == values.tolist()


def test_line_join(spark, texts):
    rows = texts + near_copies(40, 5)
    marks = brute.line_marks(rows)
    got = {r.doc_id: (r.n_lines, r.n_copies, r.n_similar, r.n_removed) for r in line_join.line_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        own = marks[i, t].values()
        assert got[i] == (len(own), sum(c for c, _ in own), sum(s for _, s in own), sum(c or s for c, s in own))


def test_line_rules(spark, texts):
    got = {r.doc_id: r for r in line_rules.base_measures(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        assert got[i].n_repeat_words == brute.repeat_words(t) and got[i].n_dup_lines == brute.duplicate_lines(t)


def test_host_lines(spark):
    """A line that more than the limit of one host's documents hold goes; in another host it stays."""
    rows = [(k, f"menu  home 12\nown words {chr(97 + k)} " + "x " * 30, "a") for k in range(10)] + [(k, "menu home 7\nshort", "a") for k in (20, 21)]
    rows += [(30, "menu home 1\n" + "y " * 30, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    common = line_rules.boilerplate(df, max_documents=5)
    assert {(r.host, r.n_documents) for r in common.collect()} == {("a", 12)}
    clean = {r.doc_id: r.text for r in line_rules.remove_boilerplate(df, common).collect()}
    assert clean[20] == "short" and clean[30].startswith("menu") and clean[3].startswith("own words d")
    verdict = {r.doc_id: r for r in line_rules.judge(df).collect()}
    assert verdict[3].removed_lines == 1 and verdict[30].removed_lines == 0 and not verdict[20].kept


def test_ngram_base_and_gain(texts, docs):
    rows = ngram.scored(docs, ngram.held_out).collect()
    want = brute.base_scores(texts, {i for i, _ in texts if brute.held(i, 7, 2)})
    for r in rows:
        n, known, train, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train) and r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == brute.held(r.doc_id, 7, 2)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_trie_finds_what_it_holds():
    g = np.random.default_rng(2)
    values = np.unique(g.integers(0, 1 << 62, 3000, dtype=np.uint64))
    coded = ngram.EliasFano(np.frombuffer(ngram.EliasFano.coded(values), np.uint8))
    asked = np.concatenate([values, g.integers(0, 1 << 63, 3000, dtype=np.uint64)])
    assert coded.successor(asked).tolist() == np.searchsorted(values, asked).tolist()
    assert coded[np.arange(len(values))].tolist() == values.tolist()
    for small in (np.zeros(0, np.uint64), np.array([0, 0, 5], np.uint64)):
        c = ngram.EliasFano(np.frombuffer(ngram.EliasFano.coded(small), np.uint8))
        assert c.successor(np.array([0, 1, 6], np.uint64)).tolist() == np.searchsorted(small, [0, 1, 6]).tolist()


def test_probabilities_add_up():
    """Over all words and the unknown one, the probabilities after any context are one."""
    counts = np.array([50, 30, 20, 7])
    common = ngram.Common(np.arange(4, dtype=np.uint64), counts, int(counts.sum()), 4, 7, 20)
    every = np.append(counts, 0)
    assert common.alone(every).sum() == pytest.approx(1)
    pairs = np.array([10, 9, 0, 11, 0])  # 30 words after the second token
    assert common.after(every, pairs, np.full(5, 1)).sum() == pytest.approx(1)


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_one_by_one(seed):
    g = random.Random(seed)
    lengths = [g.randrange(1, 65) for _ in range(400)] if seed < 3 else [g.choice([64, 33, 32, 31, 5]) for _ in range(300)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    loads = {}
    for size, _, first, each, place in (runs := packing.best_fit_decreasing(counts, 64)):
        del place
    for k, (size, start, first, each, place) in enumerate(runs):
        stop = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == size else counts[size]
        for j in range(stop - start):
            s = first + j // each
            assert loads.get(s, 0) == place + j % each * size
            loads[s] = loads.get(s, 0) + size
    assert sorted(loads.values()) == sorted(brute.best_fit(lengths, 64))


def test_packed_sequences_hold_the_ids(docs):
    rows = packing.packed(docs.limit(40), with_ids=True)
    joined = {r.sequence_id: bytes(r.ids) for r in packing.sequences(rows).collect()}
    for r in rows.collect():
        assert joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def test_encoder_equals_the_tokenizer(texts):
    encoder = packing.Encoder(packing.vocabulary())
    assert encoder.engine is not None
    odd = ["", " a", "a ", "a  b", "a \n b", "x\n\ny", "it's 12 o'clock<|endoftext|>", "tab\there", "é 漢字 🙂", "\n", "a b\n", " "]
    every = odd + [t for _, t in texts[:60]]
    every += ["a <|endoftext|> b", "<|endoftext|>" * 3, "<|endoftext", " <|endoftext|>\n"]
    plain = Tokenizer.from_file(packing.vocabulary())  # as it is read, special tokens included
    want = [e.ids for e in plain.encode_batch(every, add_special_tokens=False)]
    assert len(want[-4]) == 4
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.ids(every)] == want
    encoder.engine = None  # as for a vocabulary the engine can't take
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.ids(every)] == want


def test_quality_held_out(spark, docs):
    df = documents(spark, "/root/testdata/sf0.01")
    marks = {r.doc_id: r.quality for r in labels(spark, "/root/testdata/sf0.01").collect()}
    rows = [r for r in quality.scored(df, labels(spark, "/root/testdata/sf0.01")).collect() if r.held_out and r.doc_id in marks]
    assert sum(r.predicted == marks[r.doc_id] for r in rows) / len(rows) > 0.95


def test_isotonic_is_monotone():
    places, shares = quality.isotonic(np.arange(6.0), np.array([4.0, 4, 4, 4, 4, 4]), np.array([0.0, 2, 1, 3, 2, 4]))
    assert (np.diff(shares) >= 0).all() and len(places) == 4


def test_language_held_out(spark):
    df = documents(spark, "/root/testdata/sf0.01")
    truth = {r.doc_id: r.lang for r in df.collect()}
    rows = [r for r in language.identified(df).collect() if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.95


def test_words_of_mixed_text(docs):
    """A text that switches language half way gets both labels, in order."""
    model = language.train(language.sample(docs))
    by = {}
    for r in docs.where("n_chars between 600 and 3000").orderBy("doc_id").collect():
        by.setdefault(r.lang, r.text)
    a, b = [language.words_of(by[x])[:60] for x in ("en", "de")]
    ((_, p),) = language.Labeller(model).probabilities([a + b])
    best = [model.languages[k] for k in p.argmax(axis=1)]
    assert best[:60].count("en") > 50 and best[60:].count("de") > 50
    assert np.allclose(p.sum(axis=1), 1)


def test_forward_backward_sums_all_paths():
    g = np.random.default_rng(1)
    scores, start, moves = g.normal(size=(4, 1, 3)), g.normal(size=3), g.normal(size=(3, 3))
    total, marginal, pairs = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(start[path[0]] + sum(scores[t, 0, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += w
        for t, k in enumerate(path):
            marginal[t, k] += w
        for a, b in zip(path, path[1:]):
            pairs[a, b] += w
    found, expected = language.forward_backward(scores, np.array([4]), start, moves)
    assert np.allclose(found[:, 0], marginal / total) and np.allclose(expected, pairs / total)


def test_n_best_equals_enumeration():
    pieces = segmentation.Pieces(segmentation.vocabulary())

    def paths(arcs, b):
        if not b:
            yield 0.0, ()
        for a, p, s in arcs[b]:
            for score, before in paths(arcs, a):
                yield score + s, before + p

    for word in (" hello", " thsted", " é漢", " aaaaaa", "\n\n"):
        every = sorted((s for s, _ in paths(pieces.arcs(word), len(word))), reverse=True)[:4]
        found = pieces.n_best(word, 4)
        assert [s for s, _ in found] == pytest.approx(every)
        assert all(pieces.decode(list(p)).strip(" ") == word.strip(" ") for _, p in found)


def test_words_go_through_the_forward_pass_together(monkeypatch):
    """The joint pass gives the pieces, sums and leads of the pass word by word, and takes short words without it."""
    pieces = segmentation.Pieces(segmentation.vocabulary())
    words = [" thonsta,", " a\nb", " \U0001f600\u00e9", "\u65e5\u672c", " ", "-" * 40, "aaaaaaaa", " x\x00y", "ab" * 40, *(" " + "thstaeo"[k % 7 :] * (1 + k % 3) for k in range(30))]
    want = {}
    for w in words:
        arcs, first, second = pieces.arcs(w), [0.0], [-math.inf]
        for b in range(1, len(arcs)):
            ways = sorted((x + s for a, _, s in arcs[b] for x in (first[a], second[a])), reverse=True)
            first.append(ways[0])
            second.append(ways[1] if len(ways) > 1 else -math.inf)
        found, score, lead = pieces.best(w)
        assert (score, lead) == (first[-1], first[-1] - second[-1])
        assert b"".join(pieces.bytes[i] for i in found) == w.encode()
        want[w] = (np.array(found, "<u4").tobytes(), score, lead)
    monkeypatch.setattr(segmentation, "TOGETHER", 7)
    one_by_one = []
    monkeypatch.setattr(pieces, "best", lambda w, best=pieces.best: one_by_one.append(w) or best(w))
    assert dict(pieces.best_of(list(want))) == want
    assert one_by_one == ["ab" * 40]
    # words that are not remembered are found all the same
    monkeypatch.setattr(segmentation, "REMEMBERED", 3)
    s = segmentation.Segmenter(segmentation.vocabulary(), 4)
    text = " thst\n thonsta \U0001f600, aaaa - thonsta"
    again = segmentation.Segmenter(segmentation.vocabulary(), 4).segment(text)
    (found,) = s.learn([segmentation.words_of(text)])
    each, scores, back = s.each(text, segmentation.words_of(text), found)
    data, sums, differ = s.segment(text)
    assert (each[0], scores, back, len(s.known)) == (data, sums, True, 3) and again == (data, sums, differ)
    assert [np.frombuffer(x, "<u4").tolist() for x in each] == [s.spelled(text, d) for d in differ]


def test_texts_differ_where_it_costs_least():
    s = segmentation.Segmenter(segmentation.vocabulary(), 4)
    words = [" the", " thsteden", " a"]
    _, scores, differ = s.segment("the thsteden a")
    lists = [[x for x, _ in s.pieces.n_best(w, 4)] for w in words]
    every = sorted((sum(c) for c in __import__("itertools").product(*lists)), reverse=True)[:4]
    assert scores == pytest.approx(every) and differ[0] == []


def test_decoding_gives_the_text(docs):
    rows = segmentation.encoded(docs.limit(30))
    back = segmentation.decoded(rows.select("doc_id", F.get("ids", F.lit(1)).alias("ids")), out="again").join(docs, "doc_id")
    assert back.where("again <> text").count() == 0 and rows.where("not round_trip").count() == 0


def test_syncmers_are_context_free(spark):
    middle = " ".join("m%03d" % k for k in range(60))
    rows = [(1, "alpha beta gamma " + middle), (2, middle + " some other end of it"), (3, middle)]
    df = syncmers.with_anchors(spark.createDataFrame(rows, "doc_id long, text string"), "text", "a")
    marks = {r.doc_id: {x.hash for x in r.a} for r in df.collect()}
    assert marks[3] <= marks[1] and marks[3] <= marks[2] and len(marks[3]) > 10
    places = {r.doc_id: [(x.place, x.hash) for x in r.a] for r in df.collect()}
    assert {(p + 3, h) for p, h in places[3]} <= set(places[1])


def test_next_document_in_order(spark):
    ids = [5, -7, 512, 511, 100_000, 3, 10**12]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in syncmers.with_next(df).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: f"text {order[(k + 1) % len(order)]}" for k, i in enumerate(order)}
