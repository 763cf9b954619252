"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

1. Every text becomes ``len(MEASURES)`` statistics (lengths, shares of kinds of characters, repeated
   words, lines and runs). They are all that a score depends on.
2. Standardised statistics go through ``FEATURES`` random cosines, which approximate a Gaussian
   kernel. Each task adds up its rows' part of the normal equations; parts are added row by row of
   the matrix, and the driver solves one system of ``FEATURES + 1`` unknowns, whatever the input.
3. Rows kept out of that fit (one in ``CALIBRATION`` by the id's checksum) give counts of labels in
   ``BINS`` bins of the raw score; pooled adjacent violators turn them into probabilities.

Cases: null counts as the empty text, which has a score as any other; labels that are null or not 0
or 1 are left out; a document with several label rows counts with each; without labels of both
kinds all scores are the share of label 1, or 0.5; a null id is never learned from; rows that
repeat an id get a row each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import bytesets
from chartloom.llm.tables import remainder, stored

MEASURES = [
    "log words", "log bytes", "bytes in a word", "spread of word lengths", "short words", "long words", "distinct words",
    "commonest word", "word after itself", "distinct pairs", "distinct fives", "symbols", "digits", "capitals", "sentence marks",
    "bytes above ASCII", "white space", "entropy", "log lines", "repeated lines", "words of marks", "words with symbols",
    "words ending a sentence", "capital words", "other marks",
]
FEATURES = 256
WIDTH = 3.0
RIDGE = 1e-3
CALIBRATION = 5
BINS = 1024

_rng = np.random.Generator(np.random.PCG64(4))
_DIRECTIONS = _rng.standard_normal((len(MEASURES), FEATURES)) / WIDTH
_PHASES = _rng.uniform(0, 2 * np.pi, FEATURES)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) < 58)
_CAPITAL = (np.arange(256) >= 65) & (np.arange(256) < 91)
_SENTENCE = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
_OTHER = np.isin(np.arange(256), np.frombuffer(b"{}[]()=_/\\@+~^\"'-", np.uint8))
_KINDS = np.array([_SYMBOL, _DIGIT, _CAPITAL, _SENTENCE, np.arange(256) >= 128, bytesets.IS_SPACE, _OTHER])


def _within(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of values per text; ``before`` counts the values ahead of each text."""
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    return sums[before[1:]] - sums[before[:-1]]


def _distinct(hashes: np.ndarray, before: np.ndarray, width: int) -> np.ndarray:
    found, at = bytesets.shingle_sets(hashes, before, width)
    return np.diff(at) / np.maximum(np.diff(before) - width + 1, 1)


def measures(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of each text of a slice, one row per text."""
    n_texts = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, before = bytesets.words(buf, offsets)
    hashes = bytesets.range_hash(bytesets.prefix_sums(bytesets.BYTE_VALUES[bytesets.LOWER[buf]]), starts, ends)
    words = np.diff(before).astype(float)
    many, much = np.maximum(words, 1), np.maximum(size, 1)
    length = (ends - starts).astype(float)
    owner = np.repeat(np.arange(n_texts), np.diff(before))
    mean = _within(length, before) / many
    spread = np.sqrt(np.maximum(_within(length**2, before) / many - mean**2, 0))

    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    most = np.zeros(n_texts)
    np.maximum.at(most, o[at], runs)
    distinct = np.bincount(o[at], minlength=n_texts)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])

    counts = np.bincount(np.repeat(np.arange(n_texts), np.diff(offsets)) * 256 + buf, minlength=256 * n_texts).reshape(n_texts, 256)
    share = counts / much[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    kinds = share @ _KINDS.T

    def words_with(kind: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(kind[buf], out=sums[1:])
        return sums[ends] - sums[starts]

    breaks = np.flatnonzero(buf == 10)
    line_start = np.unique(np.concatenate([offsets[:-1][size > 0], breaks + 1]))
    line_start = line_start[line_start < len(buf)]
    line_end = np.minimum(np.append(breaks, len(buf))[np.searchsorted(breaks, line_start)], offsets[1:][np.searchsorted(offsets[1:], line_start, side="right")])
    line_hash = bytesets.range_hash(bytesets.prefix_sums(bytesets.BYTE_VALUES[buf]), line_start, line_end)
    line_before = np.searchsorted(line_start, offsets)
    lines = np.diff(line_before).astype(float)
    _, line_at = bytesets.shingle_sets(line_hash, line_before, 1)

    last = buf[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    head = buf[starts] if len(starts) else np.zeros(0, np.uint8)
    columns = [
        np.log1p(words), np.log1p(size), np.log1p(mean), np.log1p(spread), _within(length <= 3, before) / many, _within(length > 14, before) / many,
        distinct / many, most / many, _within(again, before) / many, _distinct(hashes, before, 2), _distinct(hashes, before, 5),
        np.sqrt(kinds[:, 0]), np.sqrt(kinds[:, 1]), np.sqrt(kinds[:, 2]), np.sqrt(kinds[:, 3]), kinds[:, 4], kinds[:, 5], entropy,
        np.log1p(lines), 1 - np.diff(line_at) / np.maximum(lines, 1), _within(words_with(_LETTER) == 0, before) / many,
        _within(words_with(_SYMBOL) > 0, before) / many, _within(_SENTENCE[last], before) / many, _within(_CAPITAL[head], before) / many,
        np.sqrt(kinds[:, 6]),
    ]
    return np.stack(columns, axis=1)


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, measures): the statistics of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = bytesets.text_bytes(batch.column(1))
            for i, j in bytesets.slices(offsets):
                part = offsets[i : j + 1]
                rows = measures(raw[part[0] : part[-1]], part - part[0]).astype(np.float32)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), values], ["doc_id", "measures"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id long, measures array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(MEASURES)).astype(float)


def features(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random cosines of the standardised statistics, and a constant."""
    z = np.clip((rows - mean) / scale, -5, 5)
    return np.concatenate([np.cos(z @ _DIRECTIONS + _PHASES) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))], axis=1)


def _normal_equations(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of x x' and of x y over (measures, label) rows, each task its part."""
    d = FEATURES + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for batch in batches:
            if batch.num_rows:
                x = features(_matrix(batch.column(0)), mean, scale)
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                total += x.T @ np.concatenate([x, y[:, None]], axis=1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(row)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([r.tobytes() for r in sums.values()], pa.binary())], ["i", "row"])

    out = np.zeros((d, d + 1))
    parts = rows.select("measures", "label").mapInArrow(part, "i int, row binary").repartition("i").mapInArrow(add, "i int, row binary")
    for r in parts.collect():  # FEATURES + 1 rows
        out[r["i"]] += np.frombuffer(r["row"])
    return out[:, :d], out[:, d]


def isotonic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators on ordered bins: places and non-decreasing shares ``y / n``."""
    blocks: list[list[float]] = []
    for place, count, ones in zip(x, n, y):
        blocks.append([place * count, count, ones])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], (b[:, 2] + 0.5) / (b[:, 1] + 1)


class Model:
    """What scoring needs: a few kilobytes."""

    def __init__(self, mean, scale, weights, places, shares):
        self.mean, self.scale, self.weights, self.places, self.shares = mean, scale, weights, places, shares

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(features(rows, self.mean, self.scale) @ self.weights, -0.5, 1.5)

    def score(self, rows: np.ndarray) -> np.ndarray:
        raw = self.raw(rows)
        # A hundredth of the raw score keeps the order within a level of the calibration.
        return np.clip(0.99 * np.interp(raw, self.places, self.shares) + 0.01 * np.clip(raw, 0, 1), 0, 1)


def fit(rows: DataFrame) -> Model | float:
    """A model from (measures, label, calibrate) rows; the share of label 1 if only one label occurs."""
    k = len(MEASURES)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"), *[F.avg(F.get("measures", F.lit(i))).alias(f"m{i}") for i in range(k)], *[F.stddev_pop(F.get("measures", F.lit(i))).alias(f"s{i}") for i in range(k)]).first()
    if not total["n"] or total["ones"] in (0, total["n"]):
        return total["ones"] / total["n"] if total["n"] else 0.5
    mean = np.array([total[f"m{i}"] for i in range(k)])
    scale = np.maximum(np.array([total[f"s{i}"] for i in range(k)]), 1e-3)
    gram, right = _normal_equations(rows.where("not calibrate"), mean, scale)
    seen = max(gram[-1, -1], 1.0)
    weights = np.linalg.solve(gram + RIDGE * seen * np.diag([1.0] * FEATURES + [1e-6]) / FEATURES + 1e-9 * np.eye(FEATURES + 1), right)
    model = Model(mean, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                b = np.floor((model.raw(_matrix(batch.column(0))) + 0.5) * BINS / 2).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(b), batch.column(1)], ["bin", "label"])

    held = rows.where("calibrate").select("measures", F.col("label").cast("int").alias("label")).mapInArrow(bins, "bin int, label int")
    table = np.array([tuple(r) for r in held.groupBy("bin").agg(F.count(F.lit(1)), F.sum("label")).collect()], float)  # at most BINS + 1 rows
    if len(table):
        table = table[np.argsort(table[:, 0])]
        model.places, model.shares = isotonic((table[:, 0] + 0.5) * 2 / BINS - 0.5, table[:, 1], table[:, 2])
    return model


def _learned(stats: DataFrame, labels: DataFrame, doc_id: str, label: str) -> Model | float:
    """A model from the statistics and labels of documents that aren't held out."""
    known = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).alias("label")).where("label in (0, 1)").where(remainder("_id", 3).isin(0, 2))
    rows = stats.join(known, F.col("doc_id") == F.col("_id")).select("measures", F.col("label").cast("int").alias("label"), (remainder("doc_id", CALIBRATION) == 0).alias("calibrate"))
    return fit(stored(rows, "training"))


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted): labels of held-out documents are never read."""
    stats = stored(statistics(docs, doc_id, text), "statistics")
    model = _learned(stats, labels, doc_id, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.score(_matrix(batch.column(1))) if isinstance(model, Model) else np.full(batch.num_rows, model)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    out = stats.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with all their columns; no shuffle of the texts."""
    model = _learned(stored(statistics(docs, doc_id, text), "statistics"), labels, doc_id, label)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = bytesets.text_bytes(batch.column(place))
            for i, j in bytesets.slices(offsets):
                part = offsets[i : j + 1]
                rows = measures(raw[part[0] : part[-1]], part - part[0])
                score = model.score(rows.astype(np.float32).astype(float)) if isinstance(model, Model) else np.full(j - i, model)
                yield batch.slice(i, j - i).filter(pa.array(score >= least))

    return docs.mapInArrow(run, docs.schema)
