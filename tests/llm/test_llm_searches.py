"""Contamination, conversation repair and spelling variants against plain versions, and their odd cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.llm import postings, repair, variants
from chartloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
rng = random.Random(11)
DOCS = "doc_id long, text string, item string, row long, id string"
NULLS = lambda r: tuple((x is not None, x) for x in r)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)


# contamination


def plain_contamination(docs, items, window=10, width=20):
    asked = {}
    for name, text in items:
        w = item_words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            asked.setdefault(tuple(w[k : k + window]), set()).add(None if name is None else str(name))
    out = []
    for i, text in docs:
        w = item_words(text)
        hit, found, near = set(), set(), set()
        for phrase, names in asked.items():
            at = [k for k in range(len(w) - len(phrase) + 1) if tuple(w[k : k + len(phrase)]) == phrase]
            hit.update(p for k in at for p in range(k, k + len(phrase)))
            found |= names if at else set()
            if any(set(phrase) <= set(w[k : k + width]) for k in range(len(w))):
                near |= names
        names = lambda s: sorted(s - {None})
        runs = [(p, next(q for q in range(p + 1, len(w) + 1) if q not in hit)) for p in sorted(hit) if p - 1 not in hit]
        out.append((i, len(w), runs, names(found), names(near)))
    return sorted(out, key=repr)


def contaminated(spark, docs, items, **options):
    got = postings.contamination(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), **options).collect()
    return sorted(((r.doc_id, r.n_words, [(h.a, h.b) for h in r.hits], r["items"], r.near_items) for r in got), key=repr)


def some_words(n, kinds=60):
    return [rng.choice(["the", "of"]) if rng.random() < 0.3 else "w%d" % rng.randrange(kinds) for _ in range(n)]


def planted(n_docs):
    items = [(k, " ".join(some_words(rng.randrange(1, 25)))) for k in range(20)]
    docs = []
    for k in range(n_docs):
        w = some_words(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            own = rng.choice(items)[1].split()
            a = rng.randrange(len(own))
            own = own[a : a + rng.randrange(1, 20)]
            if rng.random() < 0.4:
                rng.shuffle(own)
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
        docs.append((k, rng.choice([" ", ", ", "\n", "-"]).join(w).upper() if k % 5 == 0 else " ".join(w)))
    return docs, items


def test_contamination(spark):
    docs, items = planted(80)
    docs += [(None, None), (None, docs[3][1]), (3, docs[3][1]), (4, ""), (5, " .,! "), (6, "é" * 40 + " 漢字🙂 " + items[0][1])]
    items += [(None, docs[7][1]), (3, items[3][1]), (3, "other words of the same id"), (50, None), (51, "- -"), (52, "漢字🙂"), (53, "the the the")]
    assert contaminated(spark, docs, items) == plain_contamination(docs, items)
    assert contaminated(spark, docs, items, window=4, width=6) == plain_contamination(docs, items, 4, 6)


def test_contamination_of_nothing(spark):
    docs, items = planted(4)
    assert contaminated(spark, [], items) == []
    assert contaminated(spark, docs, []) == plain_contamination(docs, [])
    with pytest.raises(ValueError):
        contaminated(spark, docs, items, window=postings.REACH + 1)


def test_very_long_text(spark):
    """A text of several blocks: phrases across every cut are found once."""
    words = ["v%06d" % k for k in range(600_000)]
    text = " ".join(words)
    raw = np.frombuffer(text.encode(), np.uint8)
    parts = list(postings._parts(raw, np.array([0, len(raw)])))
    assert len(parts) > 3 and sum(p.own for p in parts) == len(words)
    cuts = [p.base for p in parts[1:]]
    items = [(k, " ".join(words[c - 7 : c + 6])) for k, c in enumerate(cuts)] + [(99, " ".join(words[:3]))]
    (got,) = contaminated(spark, [(1, text)], items)
    assert got[1] == len(words) and got[2] == [(0, 3)] + [(c - 7, c + 6) for c in cuts]
    assert got[3] == sorted(str(k) for k, _ in items) == got[4]
    index = postings.indexed(docs_of(spark, [(1, text)]))
    found = postings.phrases(index, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(r.start for r in found) == sorted([0] + [c - 7 for c in cuts])


def test_phrases_and_spans(spark):
    docs, items = planted(60)
    index = postings.indexed(docs_of(spark, docs))
    asked = spark.createDataFrame([(k, t) for k, t in items if len(t.split()) < 7], "item_id long, text string")
    got = sorted((r.doc_id, r.item, r.start) for r in postings.phrases(index, asked).collect())
    want, spans = [], []
    for i, text in docs:
        w = item_words(text)
        for k, t in items:
            p = item_words(t)
            if len(p) < 7:
                want += [(i, str(k), s) for s in range(len(w) - len(p) + 1) if w[s : s + len(p)] == p]
                fits = [(n, s) for n in range(1, 9) for s in range(len(w) - n + 1) if set(p) <= set(w[s : s + n])]
                spans += [(i, str(k), *min(fits))] if fits else []
    assert got == sorted(want) and len(got) > 5
    assert sorted((r.doc_id, r.item, r.n_span, r.start) for r in postings.near(index, asked, width=8).collect()) == sorted(spans)


def test_batches_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(postings, "BATCH_WORDS", 200)
    docs, items = planted(30)
    df = spark.createDataFrame(items, "item_id long, text string")
    batches = list(postings._batches(df, "item_id", "text", 10))
    assert len(batches) > 1 and all(sum(len(w) for _, w in b) <= 200 for b in batches)
    assert contaminated(spark, docs, items) == plain_contamination(docs, items)


def test_words_that_share_a_hash(spark):
    """The dictionary is asked for the bytes of a word, not only for its hash."""
    raw = np.frombuffer(b"one two three", np.uint8)
    cells = postings._block(postings.Part(0, raw, np.array([0, 13]), 0, None), np.array([5]))
    block = dict(zip([c for c, _ in postings._INDEX], cells))
    asked = postings._asked([("a", ["one", "two"]), ("b", ["two", "three"])], None)
    assert [p.tolist() for p in postings.phrase_places(postings.Lists(block, asked), asked)] == [[0, 1], [0, 1]]
    forged = asked._replace(spelling=[b"one", b"owt", b"three"])
    assert postings.phrase_places(postings.Lists(block, forged), forged)[0].size == 0


# conversations


def plain_repair(roles):
    """(cost, audit) by trying all ways; ``roles``: (initial, must go, truncated)."""
    best = (10**9, "")

    def go(k, now, cost, audit, inserted):
        nonlocal best
        if (cost, audit) >= best and cost >= best[0] and cost > best[0]:
            return
        if k == len(roles) and re.fullmatch("(s?(ua)+)?", now):
            best = min(best, (cost, audit))
        if inserted < 3:
            for r in "ua":
                go(k, now + r, cost + 5, audit + "I", inserted + 1)
        if k < len(roles):
            r, gone, cut = roles[k]
            go(k + 1, now, cost + 2, audit + "D", 0)
            if not gone:
                go(k + 1, now + r, cost + 5 * cut, audit + "K", 0)
                for x in "ua":
                    go(k + 1, now + x, cost + 1 + 5 * cut, audit + "R", 0)

    def legal_prefix(x):
        return re.fullmatch("(s?(ua)*u?)?", x)

    inner = go

    def go(k, now, cost, audit, inserted):  # noqa: F811 - cuts what can't become legal
        if legal_prefix(now):
            inner(k, now, cost, audit, inserted)

    go(0, "", 0, "", 0)
    return best


def test_solve():
    kinds = [(r, g, c) for r in "suax" for g, c in ((False, False), (True, False), (False, True))]
    cases = [list(c) for n in range(3) for c in itertools.product(kinds, repeat=n)] + [[rng.choice(kinds) for _ in range(rng.randrange(3, 7))] for _ in range(150)]
    for roles in cases:
        codes = bytes({"s": 1, "u": 2, "a": 3}.get(r, 0) | (repair.GONE if g else repair.CUT if c else 0) for r, g, c in roles)
        assert repair.solve(codes) == plain_repair(roles), roles


def test_long_conversations_are_solved_in_parts():
    for n in (40, 300):
        codes = bytes(rng.choice([1, 2, 2, 2, 3, 3, 3, 0, 6, 7, 10]) for _ in range(n))
        whole = repair.solve.__wrapped__(codes)
        best = {repair.START: (0, "")}
        for k in range(0, n, 17):
            part = codes[k : k + 17]
            ways = [(g, best[e][0] + f[0], best[e][1] + f[1]) for e in best for g in range(4) if (f := repair.solve(part, e, (g,)))]
            best = {g: min(w[1:] for w in ways if w[0] == g) for g in {w[0] for w in ways}}
        assert min(v for k, v in best.items() if k in (repair.START, repair.ASSISTANT)) == whole


def plain_digests(rows):
    """The contract, conversation by conversation."""
    text_of = lambda x: " " if x is None else str(x)
    hit = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = text_of(role), text_of(text)
        f = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        if f:
            text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
            hit[conv] += [(turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    out = []
    for conv, lines in hit.items():
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
        lines.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        seen, marks, counts = set(), [], Counter()
        for turn, role, text in lines:
            blank = not re.search("[^\x20\x09-\x0d]", text)
            again = (role, text) in seen
            cut = not re.search("[.!?][\x20\x09-\x0d]*\\Z", text)
            seen.add((role, text))
            counts["blank" if blank else "duplicate" if again else "truncated" if cut else "none"] += 1
            marks.append((role[:1] or "x", blank or again, cut and not (blank or again)))
        turns = [t for t, *_ in lines if t is not None]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        cost, audit = plain_repair(marks)
        told, k, want = [], 0, None
        for e in audit:
            role, text = lines[k][1:] if e != "I" else ("", "")
            k += e != "I"
            if e != "D":
                last = told[-1][0][:1] if told else ""
                told.append((role if e == "K" else "assistant" if last == "u" else "user", text))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in told).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha))
    return sorted(out, key=repr)


def odd_conversations():
    rows = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 8)):
            text = rng.choice(["A b.", "What?", "cut", "", " \n", "Same.", None, "Yes!  ", "dot. \x0b", "é漢."]) if rng.random() < 0.5 else f"Text {conv} {turn}."
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, turn * 3]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "stop"]), text))
    rows += [(None, 0, "user", "Who?"), (None, 1, "assistant", "No one."), (500, None, "user", "Null turn."), (500, 0, "assistant", "Yes."), (501, None, None, None)]
    rows += [rows[0], rows[0], (777, 3, "user", "x" * 200_000 + "."), (777, 4, "assistant", "y." * 100_000)]
    return rows


def conversations_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.select("*", F.lit(1).alias("conv"), F.lit("z").alias("audit"), F.lit(0).alias("kind"), F.lit("d").alias("digest")).repartition(3)


def digests(spark, rows):
    df = conversations_of(spark, rows)
    return sorted((tuple(r) for r in repair.digested(repair.damaged(df), df).collect()), key=repr)


def test_digests(spark):
    rows = odd_conversations()
    assert digests(spark, rows) == plain_digests(rows)
    assert digests(spark, []) == []


def test_one_conversation_over_many_tasks(spark):
    """A conversation longer than a segment, and cut over tasks, has the result of one search over all its rows."""
    rows = [(k // 1500, k % 1500, rng.choice(["user", "assistant", "assistant", "user", "system"]), rng.choice(["Again.", f"Text {k}.", f"cut {k}"])) for k in range(4500)]
    df = conversations_of(spark, rows)
    got = {r.conv_id: r for r in repair.audits(df).collect()}
    for conv in range(3):
        lines = [(role, text) for c, _, role, text in rows if c == conv]
        first = {}
        for k, line in enumerate(lines):
            first.setdefault(line, k)
        gone = [first[line] != k for k, line in enumerate(lines)]
        codes = bytes({"s": 1, "u": 2, "a": 3}[r[:1]] | (repair.GONE if g else 0 if t[-1] in ".!?" else repair.CUT) for (r, t), g in zip(lines, gone))
        assert (got[conv].cost, got[conv].audit) == repair.solve.__wrapped__(codes)
        assert got[conv].duplicate == sum(gone) and got[conv].gaps == 0
        assert got[conv].illegal == sum(a[0][0] + b[0][0] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))


def test_repaired_messages(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "There?"), (2, 5, "user", "Alone."), (3, 0, "assistant", "Keep me."), (3, 1, "assistant", "And me.")]
    got = sorted(tuple(r) for r in repair.repaired(conversations_of(spark, rows)).collect())
    assert got == [(1, 0, "K", 0, "user", "Hi."), (1, 1, "R", 2, "assistant", "There?"), (3, 0, "R", 0, "user", "Keep me."), (3, 1, "K", 1, "assistant", "And me.")]


# spelling variants


def plain_variants(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return plain_groups({w: k for w, k in n.items() if len(w) >= 5 and k >= 3})


def plain_groups(n):
    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n.get(form[w])))
    return sorted(out, key=NULLS)


def test_variants(spark):
    with_docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows = with_docs + [(None, "Colour colour color colör colour"), (None, None), (1, ""), (2, "×÷×÷× ×÷×÷× ×÷×÷×÷ " * 3), (3, "½½½½½ abc-de " * 4), (4, "z" * 5000 + " " + "z" * 5001 + " " + "z" * 4999 + "y")] * 3
    got = sorted((tuple(r) for r in variants.grouped(variants.counted(docs_of(spark, rows))).collect()), key=NULLS)
    assert got == plain_variants(rows) and any(r[1] for r in got)
    assert variants.grouped(variants.counted(docs_of(spark, []))).count() == 0


def test_variants_of_a_crowded_cell(spark, monkeypatch):
    """Thousands of words with the same letters: many blocks of one cell, every pair of them met once."""
    words = {"".join(p): 1 + k % 7 for k, p in enumerate(itertools.permutations("abcdefg"))}
    words |= {w[:-1] + "h": 40 for w in list(words)[::9]}
    words |= {w[:3] + w[4:]: 100 for w in list(words)[::50]}
    words |= {w[:2] + "漢" + w[2:]: 2 for w in list(words)[::70]}
    got = {r.word: tuple(r) for r in variants.grouped(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    rests = {}
    for w in words:
        for k in range(len(w)):
            rests.setdefault((k, w[:k] + w[k + 1 :]), set()).add(w)
    close = {w: set() for w in words}
    for (_, rest), ws in rests.items():
        for w in ws:
            close[w] |= ws - {w}
            if rest in words:
                close[w].add(rest)
                close[rest].add(w)
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form = best if best and words[best] >= 2 * words[w] else None
        assert (got[w][1], got[w][4]) == (form, len(vs))
    assert len(got) == len(words)


def test_roots(spark):
    forms = [(f"w{k}", f"w{k + 1}") for k in range(13)] + [("x", "w13"), ("y", "z")]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {**{f"w{k}": "w13" for k in range(13)}, "x": "w13", "y": "z"}


@pytest.mark.parametrize("name", ["op11_contamination", "op12_repair", "op13_variants"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    want = con.execute(f"select {', '.join(df.columns)} from ({SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=NULLS) == sorted(want, key=NULLS)
