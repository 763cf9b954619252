"""Joins on character spans: containment, overlap, equality.

A note with very many spans must not land in one task, and must not be joined with itself
in full. Both sides are therefore keyed by (note, position block): a span belongs to each
block of ``block`` characters it touches, so the equality key splits long notes by position
and the range conditions only compare spans that are near each other. The result does not
depend on ``block``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 16384
#: Widths of blocks: up to ``BLOCK`` times four to this power.
_LEVELS = 15
#: Columns that place an outer span in its block.
PLACE = ["_level", "_a"]


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _block(c, block: int) -> Column:
    return F.floor(F.col(c) / F.lit(block)).cast("long")


def _touched(start, end, block: int) -> Column:
    return F.explode(F.sequence(_block(start, block), F.greatest(_block(end, block), _block(start, block))))


def _equal(left: Sequence[str], right: Sequence[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & (F.col(a) == F.col(b))
    return cond


def suffix(df: DataFrame, s: str, skip: Sequence[str] = ()) -> DataFrame:
    """Every column renamed with a suffix, for joins whose result names its side."""
    return df.withColumnsRenamed({c: c + s for c in df.columns if c not in set(skip)})


def containment_join(
    outer: DataFrame,
    inner: DataFrame,
    key="source",
    how: str = "left",
    start: str = "span_start",
    end: str = "span_end",
    inner_suffix: str = "_inner",
    block: int = BLOCK,
    placed: bool = False,
) -> DataFrame:
    """Outer spans with the inner spans they contain; columns of ``inner`` get a suffix.

    Rows are sets: duplicates of either side are dropped before the join, which gives the
    distinct rows of the joined table without shuffling them again. With ``how="left"`` outer
    spans without a match are kept.

    Outer spans lie in blocks of a width of their own: the least of ``block`` times a power of four that is not shorter.
    An inner span can then only lie in an outer one that starts in the block of its own start or in the one before:
    it is offered, for each width that outer spans have, to its block and, near the start of it, to the one before. An
    outer span lies in one block, so each pair meets once and a left join stays one. A single long span adds a width, and
    leaves the blocks of all others as they are.

    ``placed`` keeps the block of the outer span (``PLACE``), which follows from key, start and end: rows that are grouped by it as
    well lie together already and are not shuffled again.
    """
    if how not in ("left", "inner"):
        raise ValueError("how is 'left' or 'inner'")
    keys = _keys(key)
    length = F.col(end) - F.col(start)
    level = sum((F.when(length > block * 4**k, 1).otherwise(0) for k in range(_LEVELS)), F.lit(0))
    # Repeated rows change no maximum: the widths are told without a shuffle of the rows.
    sized = outer.withColumn("_level", level)
    outer, inner = outer.distinct(), suffix(inner.distinct(), inner_suffix)
    names = outer.columns + inner.columns + (PLACE if placed else [])
    s, e = start + inner_suffix, end + inner_suffix
    outer = outer.withColumn("_level", level)
    width = lambda level: F.lit(block).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), level * 2)

    levels = sized.groupBy("_level").agg(F.max(F.greatest(length, F.lit(0))).alias("longest"))
    levels = levels.where("longest is not null").agg(F.collect_list(F.struct("_level", "longest"))).scalar()

    outer_b = outer.withColumn("_a", F.floor(F.col(start) / width(F.col("_level"))).cast("long"))
    offered = inner.select("*", F.explode(levels).alias("_x"))
    near, own = (F.floor(c / width(F.col("_x._level"))).cast("long") for c in (F.col(s) - F.col("_x.longest"), F.col(s)))
    inner_b = offered.select("*", F.explode(F.sequence(near, own)).alias("_b"))
    cond = (
        _equal(keys, [k + inner_suffix for k in keys])
        & (F.col("_level") == F.col("_x._level"))
        & (F.col("_a") == F.col("_b"))
        & (F.col(start) <= F.col(s))
        & (F.col(end) >= F.col(e))
    )
    return outer_b.join(inner_b, cond, how).select(*names)


def overlap_join(
    a: DataFrame,
    b: DataFrame,
    key="source",
    start: str = "span_start",
    end: str = "span_end",
    b_suffix: str = "_b",
    block: int = BLOCK,
) -> DataFrame:
    """Pairs of spans that share at least one position, ends included.

    A pair meets in every block both spans touch and is kept in the first of them only.
    """
    keys = _keys(key)
    b = suffix(b, b_suffix)
    names = a.columns + b.columns
    s, e = start + b_suffix, end + b_suffix
    cond = (
        _equal(keys, [k + b_suffix for k in keys])
        & (F.col("_a") == F.col("_b"))
        & (F.col("_a") == F.greatest(_block(start, block), _block(s, block)))
        & (F.col(start) <= F.col(e))
        & (F.col(end) >= F.col(s))
    )
    left = a.withColumn("_a", _touched(start, end, block))
    right = b.withColumn("_b", _touched(s, e, block))
    return left.join(right, cond, "inner").select(*names)


def exact_span_join(
    a: DataFrame,
    b: DataFrame,
    key="source",
    how: str = "inner",
    start: str = "span_start",
    end: str = "span_end",
    b_suffix: str = "_b",
) -> DataFrame:
    """Rows of both sides with the same note and the same two offsets."""
    left = _keys(key) + [start, end]
    b = suffix(b, b_suffix)
    return a.join(b, _equal(left, [c + b_suffix for c in left]), how)


def either_contains_join(
    a: DataFrame,
    b: DataFrame,
    key="source",
    start: str = "span_start",
    end: str = "span_end",
    b_suffix: str = "_b",
    block: int = BLOCK,
) -> DataFrame:
    """Pairs where one span contains the other (either way round)."""
    pairs = overlap_join(a, b, key, start, end, b_suffix, block)
    s, e = F.col(start + b_suffix), F.col(end + b_suffix)
    return pairs.where(
        ((F.col(start) <= s) & (F.col(end) >= e)) | ((F.col(start) >= s) & (F.col(end) <= e))
    )


def unmatched(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose keys do not occur in ``b``."""
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")
