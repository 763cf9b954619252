"""Columns of numbers as compact byte blocks, for shuffles of many small records, and document keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import bytesets
from chartloom.llm.tables import stored

_U = np.uint64


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit numbers, byte by byte, so that equal bytes lie together."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes, n: int, width: int, at: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel(), at + n * width


def write(columns: list[tuple[np.ndarray, int]]) -> bytes:
    return b"".join([len(columns[0][0]).to_bytes(4, "little"), *(pack(c, w) for c, w in columns)])


def read(data: bytes, widths: list[int]) -> tuple[list[np.ndarray], int]:
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    for w in widths:
        c, at = unpack(data, n, w, at)
        out.append(c)
    return out, at


def steps(keys: np.ndarray) -> np.ndarray:
    """Differences of ascending keys as unsigned numbers; the first is the key itself."""
    return np.diff(keys, prepend=np.int64(0)).view(_U)


def keys_of(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps.view(np.int64))


#: Neighbouring keys that share a group.
NEIGHBOURS = 256
#: Groups per shuffle partition: what a task sends to a group is one block, however many documents are in it.
GROUPS_PER_PARTITION = 4


def group_count(spark) -> int:  # noqa: ANN001
    return GROUPS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents that each key belongs to."""
    return (bytesets.mix((keys // NEIGHBOURS).view(_U)) % _U(groups)).view(np.int64)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, id, text): ``key`` orders the documents; the id itself wherever ids are unique and not null."""
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    pairs = slim.select("id", hashed.alias("h")).distinct()
    odd = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").limit(1).count()
    if not odd:
        return slim.withColumn("key", F.col("id"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pairs.repartitionByRange(n, F.asc_nulls_last("id"), "h").sortWithinPartitions(F.asc_nulls_last("id"), "h")
    ordered = stored(ordered.select(F.col("id").alias("_i"), F.col("h").alias("_h"), F.monotonically_increasing_id().alias("key")), "order")
    return slim.join(ordered, F.col("id").eqNullSafe(F.col("_i")) & (hashed == F.col("_h"))).select("key", "id", "text")
