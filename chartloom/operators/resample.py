"""Bootstrap confidence intervals and balanced splits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.operators import draws as D
from chartloom.operators.draws import hex_number
from chartloom.operators.lists import number_within
from chartloom.operators.score import METRICS, add_overall, prf
from chartloom.session import cut_lineage

LABEL_BLOCKS = 64


def indexed_docs(docs: DataFrame, doc: str) -> DataFrame:
    """Documents numbered from 0 in the order of (hash, id), by many tasks."""
    h = hex_number(F.col(doc).cast("string"), 1, 5)
    df = docs.select(doc).distinct().withColumns({"_h": h, "_all": F.lit(0)})
    return number_within(df, ["_all"], "_h", [doc], "idx", width=1024).select(doc, (F.col("idx") - 1).alias("idx"))


def draw_index(seed, draw, slot, n: int) -> Column:
    """Document number drawn for a slot: MD5 of ``seed:draw:slot``, eight hex digits, modulo ``n``."""
    return F.pmod(hex_number(F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), slot.cast("string")), 1, 8), F.lit(n))


def bootstrap_docs(
    counts: DataFrame, n_draw: int, seed: int = 0, doc: str = "source", values: Sequence[str] = ("tp", "fp", "fn"), by: Sequence[str] = ("label",)
) -> DataFrame:
    """Sums of ``values`` over resampled documents, per draw and ``by``; draw 0 is the observed sum.

    Draws 1 … ``n_draw`` − 1 take as many documents as there are, with replacement. A draw is made in two parts,
    which together are as many independent picks as there are documents. Each document first gets a Poisson weight in each draw,
    from its own number alone: tasks compute the weights of their documents in all draws at once and multiply them with
    the counts. The weights are a little low on purpose; the picks a draw still lacks (eight times the root of
    the number of documents, in the mean) are drawn one by one. No row exists per document and draw.
    """
    by, values = list(by), list(values)
    counts = cut_lineage(counts)
    index = cut_lineage(indexed_docs(counts, doc))
    n = index.count()
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    cells = counts.select(doc, key.alias("_key"), *[F.col(v).cast("long").alias(f"_v{k}") for k, v in enumerate(values)])
    held = F.struct("_key", F.array(*[f"_v{k}" for k in range(len(values))]).alias("_v"))
    packed = cells.groupBy(doc).agg(F.collect_list(held).alias("c")).join(index, doc)
    packed = cut_lineage(packed.select("idx", D.doc_number(F.col(doc)).alias("h"), F.col("c._key").alias("keys"), F.flatten("c._v").alias("vals")))
    rate = D.weight_rate(n)
    steps, scatter = D.weight_steps(rate), D.Scatter(*D.factors(seed, np.arange(n_draw)))

    def weights(h: np.ndarray) -> np.ndarray:
        y = scatter(h)
        w = np.zeros(y.shape, np.int8)
        for step in steps if rate else ():
            reached = y >= step
            if not reached.any():
                break
            w += reached
        w[:, 0] = 1  # draw 0 is the observed sum
        return w

    sums = cut_lineage(D.sums_over(packed, len(values), weights, n_draw))
    lacking = F.lit(n) - F.col("v")[0]
    sure = F.when(lacking < 0, F.raise_error(F.lit("a draw has more weight than documents: take another seed"))).otherwise(lacking)
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = sums.where("key is null and draw > 0").repartition(tasks, "draw").select("draw", F.explode(F.sequence(F.lit(0).cast("long"), sure)).alias("slot")).where(F.col("slot") > 0)
    picks = slots.select("draw", draw_index(seed, F.col("draw"), F.col("slot"), max(n, 1)).alias("idx"))
    pairs = packed.select("idx", F.posexplode("keys").alias("_k", "key"), "vals")
    pairs = pairs.select("idx", "key", F.slice("vals", F.col("_k") * len(values) + 1, len(values)).alias("v"))
    # The hint: measured by the few rows they are made from, the picks would be broadcast.
    taken = picks.join(pairs.hint("merge"), "idx").select("key", "draw", "v")
    everything = sums.where("key is not null").select("key", "draw", "v").unionByName(taken)
    out = everything.groupBy("key", "draw").agg(*[F.sum(F.col("v")[k]).alias(v) for k, v in enumerate(values)])
    kinds = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in by)
    return out.withColumn("_by", F.from_json("key", kinds)).select("draw", *[F.col("_by")[c].alias(c) for c in by], *values)


def bootstrap_entities(counts: DataFrame, n_draw: int, seed: int = 0) -> DataFrame:
    """Multinomial resamples of the (label, outcome) cells; draw 0 is the observed table.

    ``counts`` is (label, tp, fp, fn), one row per label. A draw of as many outcomes as there
    are is one multinomial vector, so its cost depends on the number of cells, not of entities.
    It is drawn in two steps, over ``LABEL_BLOCKS`` blocks of labels and then inside each block by
    a task of its own: the labels are never collected, and their number has no limit.
    """
    cells = counts.select("label", "tp", "fp", "fn")
    block = F.pmod(F.xxhash64("label"), F.lit(LABEL_BLOCKS)).cast("int")
    held = cells.withColumn("_block", block)
    # How many outcomes of a draw fall into each block of labels: one small multinomial.
    sizes = {r["_block"]: r["n"] for r in held.groupBy("_block").agg(F.sum(F.col("tp") + F.col("fp") + F.col("fn")).alias("n")).collect()}
    names = sorted(sizes)
    share = np.array([sizes[b] for b in names], dtype=np.int64)
    total = int(share.sum())

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("label", kind="stable")
        table = rows[["tp", "fp", "fn"]].to_numpy(dtype=np.int64)
        own, b = int(table.sum()), int(rows["_block"].iloc[0])
        out = []
        for d in range(n_draw):
            got = table
            if d and total:
                n = np.random.default_rng([seed, d]).multinomial(total, share / total)[names.index(b)]
                spread = table.ravel() / own if own else np.full(table.size, 1 / table.size)
                got = np.random.default_rng([seed, d, b]).multinomial(n, spread).reshape(table.shape)
            out.append(pd.DataFrame({"draw": d, "label": rows["label"].to_numpy(), "tp": got[:, 0], "fp": got[:, 1], "fn": got[:, 2]}))
        return pd.concat(out)

    return held.groupBy("_block").applyInPandas(draw, "draw long, label string, tp long, fp long, fn long")


def intervals(
    draws: DataFrame, alpha: float = 0.05, digits: int = 2, by: Sequence[str] = ("label",), metrics: Sequence[str] = ("n_entity", *METRICS)
) -> DataFrame:
    """Observed value (draw 0) and percentile interval of each metric: ``m``, ``m_lo``, ``m_hi``.

    The number of draws bounds the values a group holds.
    """
    aggs = []
    for m in metrics:
        aggs += [
            F.max(F.when(F.col("draw") == 0, F.col(m))).alias(m),
            F.percentile(m, alpha / 2).alias(m + "_lo"),
            F.percentile(m, 1 - alpha / 2).alias(m + "_hi"),
        ]
    out = draws.groupBy(*by).agg(*aggs)
    return out.withColumns({c: F.bround(F.col(c).cast("double"), digits) for m in metrics for c in (m, m + "_lo", m + "_hi")})


def interval_text(df: DataFrame, metrics: Sequence[str] = METRICS, sep: str = "-") -> DataFrame:
    """``value [lower-upper]`` per metric."""
    return df.withColumns(
        {
            m: F.concat(F.col(m).cast("string"), F.lit(" ["), F.col(m + "_lo").cast("string"), F.lit(sep), F.col(m + "_hi").cast("string"), F.lit("]"))
            for m in metrics
        }
    ).drop(*[m + s for m in metrics for s in ("_lo", "_hi")])


def scored_intervals(counts: DataFrame, n_draw: int = 5000, seed: int = 0, alpha: float = 0.05, digits: int = 2, doc: str = "source") -> DataFrame:
    """Score table of per-document counts: every label and ``Overall`` with intervals."""
    draws = add_overall(bootstrap_docs(counts, n_draw, seed, doc))
    return intervals(prf(draws), alpha, digits)


def accuracy_intervals(
    counts: DataFrame, n_draw: int = 1000, seed: int = 0, alpha: float = 0.05, digits: int = 3, by: Sequence[str] = (), doc: str = "source"
) -> DataFrame:
    """Accuracy with a document bootstrap, from (doc, hits, n) per group."""
    by = list(by) or ["_all"]
    if by == ["_all"]:
        counts = counts.withColumn("_all", F.lit(0))
    draws = bootstrap_docs(counts, n_draw, seed, doc, ("hits", "n"), by)
    out = intervals(draws.withColumn("accuracy", F.col("hits") / F.col("n")), alpha, digits, by, ["accuracy"])
    return out.drop("_all")


def balanced_split(docs: DataFrame, counts: DataFrame, share: float = 0.2, draws: int = 5000, seed: int = 0, doc: str = "source") -> tuple[DataFrame, DataFrame]:
    """Best of many random splits: (documents with ``part``, cost per draw).

    ``counts`` is (doc, name, n): occurrences of each label and attribute. A draw puts the
    ``int(share · documents)`` documents of least number (then id) into the test part; its cost is the sum over names of
    |test share of the name − ``share``|, each rounded to three places. The least cost wins, then the lowest draw.

    The cut of a draw lies close to ``share`` of the range of numbers, because numbers are uniform. One pass makes the numbers of
    all documents in all draws: what lies below that stretch is multiplied with the counts of names at once, and what lies
    in it (a share that falls as the root of the documents grows) is written down for each document. The rest reads only that: documents per
    piece of the stretch, which gives the cut up to one piece, and sums up to that piece. Of the piece itself documents are ranked.
    """
    per_doc = counts.where("name is not null").groupBy(doc, "name").agg(F.sum("n").cast("long").alias("n"))
    packed = per_doc.groupBy(doc).agg(F.collect_list("name").alias("keys"), F.collect_list("n").alias("vals"))
    base = docs.select(doc).distinct().join(packed, doc, "left").select(doc, D.doc_number(F.col(doc)).alias("h"), "keys", "vals")
    base = cut_lineage(base)
    n = base.count()
    size = int(share * n)
    cut, near, sums = _cuts(base, n, size, share, draws, seed)
    a, b = D.factors(seed, np.arange(draws))
    floor, ceiling = cut["floor"].to_numpy(), cut["ceiling"].to_numpy()

    def on_edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, draw, y = D.numbers_near(batch.column(1), batch.column(2))
            at = np.flatnonzero((y >= floor[draw]) & (y < ceiling[draw]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[at])), pa.array(draw[at]), pa.array(y[at])], [doc, "draw", "y"])

    kind = base.schema[doc].dataType.simpleString()
    edge = near.select(doc, "draws", "ys").mapInArrow(on_edge, f"`{doc}` {kind}, draw long, y long")
    left = docs.sparkSession.createDataFrame(cut[["draw", "left"]], "draw long, left long")
    edge = edge.withColumn("_k", F.row_number().over(Window.partitionBy("draw").orderBy("y", doc))).join(left, "draw").where("_k <= left")
    edge = cut_lineage(edge.select(doc, "draw"))
    test = sums.where("key is not null").select("draw", F.col("key").alias("name"), F.col("v")[0].alias("n"))
    test = test.unionByName(D.sums_near(near, floor).select("draw", "name", "n"))
    test = test.unionByName(edge.join(per_doc, doc).select("draw", "name", "n")).groupBy("draw", "name").agg(F.sum("n").alias("n"))

    totals = per_doc.groupBy("name").agg(F.sum("n").alias("total")).where("total > 0")
    every = docs.sparkSession.range(draws).select(F.col("id").alias("draw"))
    # draws x names, both small: every name counts in every draw, also where the test part lacks it
    grid = totals.select("name", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("draw"))
    thousandths = F.floor(F.abs(F.coalesce("n", F.lit(0)) / F.col("total") - F.lit(share)) * 1000 + 0.5)
    per_draw = grid.join(test, ["draw", "name"], "left").groupBy("draw").agg(F.sum(thousandths).alias("off"))
    cost = every.join(per_draw, "draw", "left").select(F.col("draw").cast("int").alias("draw"), (F.coalesce("off", F.lit(0)) / 1000).alias("cost"))
    cost = cut_lineage(cost)
    best = cost.orderBy("cost", "draw").first()["draw"] if draws else 0
    picked = base.select(doc, D.scattered_column(F.col("h"), int(a[best]), int(b[best])).alias("y"))
    chosen = edge.where(F.col("draw") == best).select(doc, F.lit(True).alias("_in"))
    inside = (F.col("y") < int(floor[best])) | F.coalesce("_in", F.lit(False))
    return picked.join(chosen, doc, "left").select(doc, F.when(inside, "test").otherwise("train").alias("part")), cost


#: Pieces of the stretch that holds the cuts.
PIECES = 128


def _cuts(base: DataFrame, n: int, size: int, share: float, draws: int, seed: int) -> tuple[pd.DataFrame, DataFrame, DataFrame]:
    """(draw, floor, ceiling, left), numbers near the cuts, sums below them.

    Documents with a number below ``floor`` are in, of those below ``ceiling`` the ``left`` first. The stretch is six standard
    deviations wide to each side; should a cut lie outside, it is widened.
    """
    reach = 6 * float(np.sqrt(0.25 / max(n, 1)))
    while True:
        low, high = (int(min(max(share + s * reach, 0), 1) * D.PRIME) for s in (-1, 1))
        width = max(1, -(-(high - low) // PIECES))
        near, sums = D.split_at(base, seed, draws, low, low + width * PIECES)
        found = D.counted_near(near, draws, low, width, PIECES).toPandas()
        below = sums.where("key is null").select("draw", F.col("v")[0].alias("n")).toPandas()
        table = np.zeros((draws, PIECES + 1), np.int64)
        table[found["draw"], found["bucket"]] = found["n"]
        table[below["draw"], 0] = below["n"]
        upto = table.cumsum(axis=1)
        if size == 0:
            # Nothing is in: no number lies below the lowest.
            zero = np.zeros(draws, np.int64)
            cut = pd.DataFrame({"draw": np.arange(draws), "floor": zero, "ceiling": zero, "left": zero})
            return cut, near.limit(0), sums.limit(0)
        piece = (upto < size).sum(axis=1)
        if (piece >= 1).all() and (piece <= PIECES).all():
            before = upto[np.arange(draws), piece - 1]
            floor = low + (piece - 1) * width
            return pd.DataFrame({"draw": np.arange(draws), "floor": floor, "ceiling": floor + width, "left": size - before}), near, sums
        if reach >= 1:
            raise ValueError("no cut found")
        reach *= 4
