"""Random draws as vectors: what thousands of draws decide about a document, without a row for each.

A draw is a pair of numbers (a, b) from its MD5, a document a number h from its own; ``scattered`` maps the two to a whole
number below the prime ``PRIME``: (a h + b)^5, a permutation of h for each draw. Tasks compute it for
all draws at once in NumPy; ``scattered_column`` and SQL give the same numbers with plain long arithmetic.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.session import cut_lineage

PRIME = 2_147_483_647
#: Cells of a matrix (documents x draws) that a task works on at a time: they fit a core's cache.
CELLS = 1 << 16
#: Keys a task sums up before it sends them on.
KEYS = 128
#: Poisson weights a document can have.
STEPS = 12


def hex_number(text: Column, first: int, digits: int) -> Column:
    """Whole number of some hex digits (at most 15) of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), first, digits), 16, 10).cast("long")


def doc_number(doc: Column) -> Column:
    return hex_number(doc.cast("string"), 6, 14) % F.lit(PRIME)


def factors(seed: int, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of each draw."""
    found = [hashlib.md5(f"{seed}:{d}".encode()).hexdigest() for d in draws.tolist()]
    a = np.array([1 + int(x[:14], 16) % (PRIME - 1) for x in found], np.int64)
    return a, np.array([int(x[14:28], 16) % PRIME for x in found], np.int64)


def _folded(v: np.ndarray, times: int = 2, low: np.ndarray | None = None) -> np.ndarray:
    """A number equal to ``v`` modulo ``PRIME`` (2^31 - 1), without a division, in place; ``low`` is room for as many numbers.

    Below 2^31 + 8; folded once, a number up to 2^62 + 2^36 comes below 2^32, whose square still fits.
    """
    low = np.empty_like(v) if low is None else low
    for _ in range(times):
        np.bitwise_and(v, np.uint64(PRIME), out=low)
        v >>= np.uint64(31)
        v += low
    return v


class Scatter:
    """``scattered`` for the draws (a, b), again and again in the same memory: a matrix holds until the next call.

    New matrices of this size would cost several times the arithmetic.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a.astype(np.uint64)[None, :], b.astype(np.uint64)[None, :]
        self.room = np.empty((3, 0, len(a)), np.uint64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if self.room.shape[1] < len(h):
            self.room = np.empty((3, len(h), self.a.shape[1]), np.uint64)
        x, y, low = self.room[:, : len(h)]
        np.multiply(h.astype(np.uint64)[:, None], self.a, out=x)
        x += self.b
        _folded(x, 1, low)
        np.multiply(x, x, out=y)
        _folded(y, 2, low)
        y *= y
        _folded(y, 1, low)
        y *= x
        _folded(y, 2, low)
        np.subtract(y, np.uint64(PRIME), out=low)
        return np.minimum(y, low, out=low).view(np.int64)  # what is below PRIME wraps round


def scattered(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix (documents x draws) of whole numbers below ``PRIME``."""
    return Scatter(a, b)(h)


def scattered_column(h: Column, a: int, b: int) -> Column:
    x = (h * F.lit(a) + F.lit(b)) % F.lit(PRIME)
    y = x * x % F.lit(PRIME)
    return y * y % F.lit(PRIME) * x % F.lit(PRIME)


def weight_rate(n: int) -> float:
    """Mean weight at which ``n`` Poisson weights add up to more than ``n`` about once in 10^15 draws."""
    return max(0.0, 1 - 8 / math.sqrt(n)) if n else 0.0


def weight_steps(rate: float) -> np.ndarray:
    """A document's weight is the number of these steps that its number reaches: Poisson with mean ``rate``."""
    out, total, term = [], 0.0, 1.0
    for k in range(STEPS):
        total = total + term
        out.append(math.floor(PRIME * (math.exp(-rate) * total) + 0.5))
        term = term * rate / (k + 1)
    return np.array(out, np.int64)


def sums_over(packed: DataFrame, n_values: int, weights, n_draws: int) -> DataFrame:  # noqa: ANN001
    """Sums of weighted values as rows (key, draw, v): ``v`` is an array of ``n_values`` numbers.

    ``packed`` has a row per document: its number ``h``, and arrays ``keys`` and ``vals`` (the values of all its keys, one after the
    other). ``weights(h)`` gives its matrix (documents x draws). The rows of the key null add up the weights
    themselves. A task multiplies the values of a key with the weights of its documents; what leaves it is one vector
    per key, which are added up by key and salt, and then by key.
    """
    width = n_values * n_draws * 8

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def told() -> pa.RecordBatch:
            keys = list(sums)
            data = [np.rint(sums[k]).astype("<i8").tobytes() for k in keys]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(data, pa.binary())], ["key", "data"])

        step = max(1, CELLS // max(n_draws, 1))
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(batch.column(1).value_lengths(), 0).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(sizes)])
            names, code = np.unique(np.array(batch.column(1).flatten().to_pylist(), object).astype(str), return_inverse=True)
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n_values)
            for i in range(0, len(h), step):
                j = min(i + step, len(h))
                w = weights(h[i:j]).astype(float)
                whole = sums.setdefault(None, np.zeros((n_values, n_draws)))
                whole[0] += w.sum(axis=0)
                owner = np.repeat(np.arange(j - i), sizes[i:j])
                own, part = code[at[i] : at[j]], values[at[i] : at[j]]
                for k in np.unique(own):
                    rows = own == k
                    got = part[rows].T @ w[owner[rows]]
                    name = str(names[k])
                    held = sums.get(name)
                    sums[name] = got if held is None else held + got
                if len(sums) > KEYS:
                    yield told()
        if sums:
            yield told()

    # much work on few bytes: as many tasks as a shuffle has, not as many as the bytes need
    packed = packed.repartition(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h")
    return _added(packed.select("h", "keys", "vals").mapInArrow(multiply, "key string, data binary"), n_values, n_draws)


def _added(parts: DataFrame, n_values: int, n_draws: int) -> DataFrame:
    """(key, draw, v): the vectors of each key, added up by key and salt, and then by key."""
    width = n_values * n_draws * 8

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, started = None, None, False

        def told() -> pa.RecordBatch:
            v = total.reshape(n_values, n_draws).T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, n_values), pa.int32()), pa.array(v.ravel()))
            return pa.RecordBatch.from_arrays([pa.array([now] * n_draws, pa.string()), pa.array(np.arange(n_draws)), lists], ["key", "draw", "v"])

        for batch in batches:
            for key, data in zip(*(c.to_pylist() for c in batch.columns)):
                got = np.frombuffer(data, "<i8", width // 8)
                if started and key == now:
                    total = total + got
                    continue
                if started:
                    yield told()
                now, total, started = key, got, True
        if started:
            yield told()

    salt = F.pmod(F.spark_partition_id(), F.lit(16))
    parts = parts.withColumn("salt", salt).repartition("key", "salt").sortWithinPartitions("key").select("key", "data")
    found = parts.mapInArrow(add, "key string, draw long, v array<long>")
    each = [F.sum(F.col("v")[k]) for k in range(n_values)]
    return found.groupBy("key", "draw").agg(F.array(*each).alias("v"))


def split_at(base: DataFrame, seed: int, n_draws: int, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    """Numbers from ``low`` to ``high``, and sums of those below: (doc, draws, ys, keys, vals), (key, draw, v).

    ``base`` is (doc, h, keys, vals), see ``sums_over``; the null key counts documents. The numbers of a document in all draws are
    made once. What a task has multiplied leaves it as one vector per key, in a row without draws.
    """
    a, b = factors(seed, np.arange(n_draws))
    doc = base.columns[0]
    schema = T.StructType([base.schema[doc]])
    for name, kind in (("draws", T.IntegerType()), ("ys", T.IntegerType()), ("keys", T.StringType()), ("vals", T.LongType())):
        schema.add(name, T.ArrayType(kind))
    schema.add("key", T.StringType()).add("data", T.BinaryType())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        names = schema.names
        kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.string(), pa.binary()]

        def told() -> pa.RecordBatch:
            keys = list(sums)
            data = [np.rint(sums[k]).astype("<i8").tobytes() for k in keys]
            sums.clear()
            empty = [pa.nulls(len(keys), k) for k in (kind, *kinds[:4])]
            return pa.RecordBatch.from_arrays([*empty, pa.array(keys, pa.string()), pa.array(data, pa.binary())], names)

        step = max(1, CELLS // max(n_draws, 1))
        kind, scatter = pa.null(), Scatter(a, b)
        inside, near, weight = (np.empty((step, n_draws), t) for t in (bool, bool, float))
        for batch in batches:
            kind = batch.column(0).type
            h = batch.column(1).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(batch.column(2).value_lengths(), 0).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(sizes)])
            labels, code = np.unique(np.array(batch.column(2).flatten().to_pylist(), object).astype(str), return_inverse=True)
            values = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(float)
            docs, draws, ys = [], [], []
            for i in range(0, len(h), step):
                j = min(i + step, len(h))
                y, below, w, close = scatter(h[i:j]), inside[: j - i], weight[: j - i], near[: j - i]
                np.less(y, low, out=below)
                np.copyto(w, below)
                np.less(y, high, out=close)
                close ^= below
                # a row per key of these documents, and one that counts them
                own, which = np.unique(code[at[i] : at[j]], return_inverse=True)
                table = np.zeros((len(own) + 1, j - i))
                table[-1] = 1
                np.add.at(table, (which, np.repeat(np.arange(j - i), sizes[i:j])), values[at[i] : at[j]])
                got = table @ w
                for k, name in enumerate([*labels[own].tolist(), None]):
                    held = sums.get(name)
                    sums[name] = got[k] if held is None else held + got[k]
                if len(sums) > KEYS:
                    yield told()
                row, draw = np.divmod(np.flatnonzero(close), max(n_draws, 1))
                docs.append(row + i)
                draws.append(draw)
                ys.append(y[row, draw])
            ends = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(docs), minlength=len(h)))]) if docs else np.zeros(1)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x) if x else [], pa.int32())) for x in (draws, ys)]
            found = [batch.column(0), *lists, batch.column(2).cast(kinds[2]), batch.column(3).cast(kinds[3]), pa.nulls(len(h), kinds[4]), pa.nulls(len(h), kinds[5])]
            yield pa.RecordBatch.from_arrays(found, names)
        if sums:
            yield told()

    # much work on few bytes, as in sums_over
    dealt = base.repartition(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h")
    both = cut_lineage(dealt.mapInArrow(split, schema))
    near = both.where("data is null and size(draws) > 0").drop("key", "data")
    return near, cut_lineage(_added(both.where("data is not null").select("key", "data"), 1, n_draws))


def numbers_near(draws: pa.Array, ys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, draw, y) of lists of draws and numbers."""
    sizes = draws.value_lengths().to_numpy(zero_copy_only=False)
    flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (draws, ys)]
    return np.repeat(np.arange(len(sizes)), sizes), *flat


def counted_near(near: DataFrame, n_draws: int, low: int, width: int, buckets: int) -> DataFrame:
    """(draw, bucket, n): documents of ``split_at`` by the bucket, from 1 on, that holds their number; a task sums one matrix."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_draws * (buckets + 1), np.int64)
        for batch in batches:
            _, draw, y = numbers_near(batch.column(0), batch.column(1))
            total += np.bincount(draw * (buckets + 1) + (y - low) // width + 1, minlength=len(total))
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at // (buckets + 1)), pa.array(at % (buckets + 1)), pa.array(total[at])], ["draw", "bucket", "n"])

    return near.select("draws", "ys").mapInArrow(count, "draw long, bucket long, n long").groupBy("draw", "bucket").agg(F.sum("n").alias("n"))


def sums_near(near: DataFrame, floor: np.ndarray) -> DataFrame:
    """(draw, name, n): sums of the values of ``split_at``'s documents with a number below ``floor`` of the draw."""
    n_draws = len(floor)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, total in sums.items():
                draw = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(draw), pa.array([name] * len(draw), pa.string()), pa.array(total[draw])], ["draw", "name", "n"])
            sums.clear()

        for batch in batches:
            row, draw, y = numbers_near(batch.column(0), batch.column(1))
            at = np.flatnonzero(y < floor[draw])
            row, draw = row[at], draw[at]
            sizes = pc.fill_null(batch.column(2).value_lengths(), 0).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            names, code = np.unique(np.array(batch.column(2).flatten().to_pylist(), object).astype(str), return_inverse=True)
            values = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            for k, name in enumerate(names.tolist()):
                own = np.zeros(len(sizes), np.int64)
                np.add.at(own, owner[code == k], values[code == k])
                total = sums.setdefault(name, np.zeros(n_draws, np.int64))
                hit = own[row] != 0
                np.add.at(total, draw[hit], own[row[hit]])
                if len(sums) > KEYS:
                    yield from told()
        yield from told()

    return near.select("draws", "ys", "keys", "vals").mapInArrow(add, "draw long, name string, n long").groupBy("draw", "name").agg(F.sum("n").alias("n"))
