"""Draws as vectors: the same numbers by column, by matrix and by plain arithmetic; splits and resamples against plain versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from chartloom.operators import draws as D
from chartloom.operators import resample as R

P = D.PRIME


def number(doc):
    return int(hashlib.md5(doc.encode()).hexdigest()[5:19], 16) % P


def factors(seed, draw):
    x = hashlib.md5(f"{seed}:{draw}".encode()).hexdigest()
    return 1 + int(x[:14], 16) % (P - 1), int(x[14:28], 16) % P


def scattered(doc, seed, draw):
    a, b = factors(seed, draw)
    return pow(number(doc) * a + b, 5, P)


def test_numbers_agree(spark):
    docs = [f"d{k}" for k in range(40)]
    a, b = D.factors(3, np.arange(60))
    table = D.scattered(np.array([number(d) for d in docs]), a, b)
    assert [[scattered(d, 3, k) for k in range(60)] for d in docs] == table.tolist()
    edges = [0, 1, P - 1, P, P + 1, (P - 1) ** 2 + P - 1, 2**62, 2**64 - 1]
    folded = D._folded(np.array(edges, np.uint64)).tolist()
    assert [x % P for x in folded] == [x % P for x in edges] and max(folded) < P + 9
    assert D.scattered(np.array([0, P - 1]), np.array([1, P - 1]), np.array([0, P - 1])).tolist() == [[0, P - 1], [P - 1, 0]]
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    got = df.select("doc", D.scattered_column(D.doc_number(F.col("doc")), int(a[7]), int(b[7])).alias("y")).collect()
    assert {r.doc: r.y for r in got} == {d: scattered(d, 3, 7) for d in docs}


def plain_resample(counts, n_draw, seed):
    """(draw, label) -> sums, one document and one pick at a time."""
    docs = sorted({d for d, *_ in counts}, key=lambda d: (int(hashlib.md5(d.encode()).hexdigest()[:5], 16), d))
    n = len(docs)
    rate = max(0.0, 1 - 8 / math.sqrt(n))
    steps, total, term = [], 0.0, 1.0
    for k in range(D.STEPS):
        total += term
        steps.append(math.floor(P * (math.exp(-rate) * total) + 0.5))
        term = term * rate / (k + 1)
    out = defaultdict(Counter)
    for draw in range(n_draw):
        weight = Counter(docs) if draw == 0 else Counter({d: sum(scattered(d, seed, draw) >= s for s in steps) for d in docs})
        for slot in range(1, n - weight.total() + 1):
            weight[docs[int(hashlib.md5(f"{seed}:{draw}:{slot}".encode()).hexdigest()[:8], 16) % n]] += 1
        assert weight.total() == n
        for d, label, *values in counts:
            for k, v in enumerate(values):
                out[draw, label][k] += weight[d] * v
    return {k: tuple(v[i] for i in range(3)) for k, v in out.items()}


def test_resample(spark):
    rng = random.Random(2)
    for n in (1, 9, 400):
        counts = [(f"doc{d}", label, rng.randrange(5), rng.randrange(3), rng.randrange(3)) for d in range(n) for label in ("a", 'b "quoted"', None)[: 1 + d % 3]]
        df = spark.createDataFrame(counts, "source string, label string, tp long, fp long, fn long").repartition(3)
        got = {(r.draw, r.label): (r.tp, r.fp, r.fn) for r in R.bootstrap_docs(df, 30, 5).collect()}
        want = plain_resample(counts, 30, 5)
        assert {k: v for k, v in want.items() if any(v)} == {k: v for k, v in got.items() if any(v)}
    empty = spark.createDataFrame([], "source string, label string, tp long, fp long, fn long")
    assert R.bootstrap_docs(empty, 30, 5).count() == 0


def test_weights_are_picks_with_replacement(spark):
    """Over many draws a document is taken once in the mean, with the variance of n picks, and draws don't go together."""
    n = 900
    df = spark.createDataFrame([(f"doc{d}", f"l{d % 3}", 1, 0, 0) for d in range(n)], "source string, label string, tp long, fp long, fn long")
    got = R.bootstrap_docs(df, 2001, 1).where("draw > 0").toPandas().pivot(index="draw", columns="label", values="tp")
    assert (got.sum(axis=1) == n).all() and len(got) == 2000
    third = got["l0"].to_numpy()
    assert abs(third.mean() - 300) < 1.5 and abs(third.var() - 200) < 25
    assert abs(np.corrcoef(third[1:], third[:-1])[0, 1]) < 0.08 and abs(np.corrcoef(got["l0"], got["l1"])[0, 1] + 0.5) < 0.07


def plain_split(docs, counts, share, draws, seed):
    size = int(share * len(docs))
    total, costs, parts = Counter(), [], []
    for _, name, n in counts:
        total[name] += n
    for draw in range(draws):
        test = set(sorted(docs, key=lambda d: (scattered(d, seed, draw), d))[:size])
        got = Counter()
        for d, name, n in counts:
            got[name] += n * (d in test)
        costs.append(sum(math.floor(abs(got[k] / total[k] - share) * 1000 + 0.5) for k in total) / 1000)
        parts.append(test)
    best = min(range(draws), key=lambda k: (costs[k], k)) if draws else 0
    return costs, parts[best]


def test_split(spark):
    rng = random.Random(4)
    for n, share in ((3, 0.2), (40, 0.3), (700, 0.2), (50, 1.0)):
        docs = [f"n{k}" for k in range(n)]
        counts = [(d, name, rng.randrange(1, 6)) for d in docs for name in "abcdef" if rng.random() < 0.4]
        split, cost = R.balanced_split(spark.createDataFrame([(d,) for d in docs] * 2, "source string"), spark.createDataFrame(counts + counts[:1], "source string, name string, n long"), share, 50, 9)
        costs, test = plain_split(docs, counts + counts[:1], share, 50, 9)
        assert [r.cost for r in cost.orderBy("draw").collect()] == costs
        assert {r.source for r in split.where("part = 'test'").collect()} == test and split.count() == n


def test_numbers_of_a_split_are_made_once(spark, monkeypatch):
    """One pass gives the sums below the stretch and the numbers in it; the memory of a matrix is used again."""
    docs, draws, low, high = [f"n{k}" for k in range(90)], 40, P // 6, P // 4
    a, b = D.factors(9, np.arange(draws))
    scatter, hs = D.Scatter(a, b), np.array([number(d) for d in docs])
    assert np.array_equal(scatter(hs[:50]).copy(), D.scattered(hs[:50], a, b)) and np.array_equal(scatter(hs[:7]), D.scattered(hs[:7], a, b))
    monkeypatch.setattr(D, "CELLS", 7 * draws)
    rows = [(d, number(d), ["a", "b"][: k % 3] or None, [1 + k % 5, 2][: k % 3] or None) for k, d in enumerate(docs)]
    near, sums = D.split_at(spark.createDataFrame(rows, "source string, h long, keys array<string>, vals array<long>").repartition(3), 9, draws, low, high)
    want, close, part = Counter(), set(), Counter()
    for d, _, keys, vals in rows:
        for draw in range(draws):
            y = scattered(d, 9, draw)
            if low <= y < high:
                close.add((d, draw, y))
            for key, n in [*zip(keys or [], vals or []), (None, 1)]:
                want[key, draw] += n * (y < low)
                part[key, draw] += n * (low <= y < (low + high) // 2 and key is not None)
    assert {(r.key, r.draw): r.v[0] for r in sums.collect() if r.v[0]} == {k: v for k, v in want.items() if v}
    assert {(r.source, d, y) for r in near.collect() for d, y in zip(r.draws, r.ys)} == close
    got = {(r.name, r.draw): r.n for r in D.sums_near(near, np.full(draws, (low + high) // 2)).collect()}
    assert got == {k: v for k, v in part.items() if v}
    buckets = Counter((draw, (y - low) // 100_000_000 + 1) for _, draw, y in close)
    assert {(r.draw, r.bucket): r.n for r in D.counted_near(near, draws, low, 100_000_000, 9).collect()} == buckets


def test_cut_outside_the_first_stretch(spark, monkeypatch):
    """Numbers that are not uniform: the stretch is widened until every draw's cut lies in it."""
    low = [d for d in (f"x{k}" for k in range(3000)) if scattered(d, 9, 0) < P // 100]
    docs = low + [f"y{k}" for k in range(3)]
    split, _ = R.balanced_split(spark.createDataFrame([(d,) for d in docs], "source string"), spark.createDataFrame([(d, "a", 1) for d in docs], "source string, name string, n long"), 0.2, 1, 9)
    _, test = plain_split(docs, [(d, "a", 1) for d in docs], 0.2, 1, 9)
    assert {r.source for r in split.where("part = 'test'").collect()} == test


def test_picks_are_not_broadcast(spark):
    """The picks grow with the documents, also where the rows they are made from are few."""
    counts = spark.range(400).select(F.concat(F.lit("d"), "id").alias("source"), F.lit("a").alias("label"), *[F.lit(1).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    got = R.bootstrap_docs(counts, 20, 7)
    assert {r.tp for r in got.collect()} == {400}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
