"""Connected components of a large graph by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.tables import stored


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours linked to the least of its neighbourhood.

    ``larger``: the neighbours above the node; otherwise those below it and itself. The least
    neighbour is a map-side summed minimum, so a node with very many edges isn't one task's work;
    joining it back is an equality join that adaptive execution can split.
    """
    if larger:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("n"))
    if larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of the component of every node that has an edge to another.

    Large-star and small-star steps alternate until the table of edges stops changing; each round
    is written to the shared folder, so lineage stays short and a lost executor costs one round.
    Rounds grow with the logarithm of the longest path, not with the size of a component. Edges
    with a null end and loops are ignored.
    """
    now = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    measure = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = measure(now)
    while before[0]:
        now = stored(_stars(_stars(now, larger=True), larger=False), "edges")
        after = measure(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
