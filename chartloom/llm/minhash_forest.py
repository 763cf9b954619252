"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Texts become sets of distinct 5-word shingles; equal sets are one node from here on.
2. A signature of ``TREES * DEPTH`` MinHash values gives ``TREES`` labels: the signature read from
   another place each time. All labels are sorted; neighbours whose labels share a long enough
   prefix are candidates. The whole order is one distributed sort, so a dense stretch is spread
   over tasks; stretches cut by a task border are tied together by a node that stands for their
   common prefix.
3. Candidates chain to regions. The depth is adaptive: a region of more than ``BLOCK`` nodes is
   split again by the longer prefix ``DEEP``.
4. In a region every pair that the sizes allow is compared on the full sets, exactly. A region
   above ``BLOCK`` nodes is dealt out as pairs of blocks, so no task holds a whole one.
5. Linked nodes chain to components.

A pair of similarity 0.85 shares a prefix of 6 in one of 21 labels with probability 0.99995 (of 8:
0.9987); every link reported is confirmed, so errors are missed links only.

Cases: null, empty and white-space texts have no shingles, are linked with nothing and are kept;
rows that repeat an id are documents of one id, each gets a row, and all copies are in one
component; a null id comes after all others as a representative (``component_id`` is null only if
all ids of the component are); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import bytesets
from chartloom.llm.graph import components
from chartloom.llm.tables import fresh, stored

WIDTH = 5
PERCENT = 85
TREES = 21
DEPTH = 6
DEEP = 8
#: Values in a label: enough to tell neighbours apart in dense stretches.
LABEL = 12
BLOCK = 1024

_rng = np.random.Generator(np.random.PCG64(6))
_FACTORS = (_rng.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Shingle sets of a text column in slices: range of rows, hashes, offsets."""
    raw, offsets = bytesets.text_bytes(column)
    for i, j in bytesets.slices(offsets):
        part = offsets[i : j + 1]
        hashes, before = bytesets.word_hashes(raw[part[0] : part[-1]], part - part[0])
        found, at = bytesets.shingle_sets(hashes, before, width)
        yield i, j, found, at


def _signatures(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value of the sets that begin at ``starts``."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), TREES * DEPTH), np.uint16)
    for k in range(TREES * DEPTH):
        least = np.minimum.reduceat(short * _FACTORS[k] + _SHIFTS[k], starts)
        out[:, k] = ((least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, node, check, signature): ``node`` and ``check`` are hashes of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j, found, at in _sets(texts, width):
                n = np.diff(at)
                some = np.flatnonzero(n)
                node, check = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                sig = np.zeros((j - i, TREES * DEPTH), np.uint16)
                if len(some):
                    starts = at[:-1][some]
                    node[some] = bytesets.mix(np.add.reduceat(bytesets.mix(found), starts))
                    check[some] = bytesets.mix(np.add.reduceat(bytesets.mix(found ^ np.uint64(0x5851F42D4C957F2D)), starts))
                    sig[some] = _signatures(found, starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i),
                        pa.array(n.astype(np.int64)),
                        pa.array(node.view(np.int64)),
                        pa.array(check.view(np.int64)),
                        pa.array([r.tobytes() if k else None for r, k in zip(sig, n)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "node", "check", "signature"],
                )

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_shingles long, node long, check long, signature binary")


def _labels(nodes: DataFrame) -> DataFrame:
    """(tree, label, node): the signature read from each of ``TREES`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, TREES * DEPTH).astype(">u2")
            twice = np.concatenate([sig, sig[:, :LABEL]], axis=1)
            for t in range(TREES):
                label = np.ascontiguousarray(twice[:, t * DEPTH : t * DEPTH + LABEL])
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * LABEL), n, [None, pa.py_buffer(label.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), fixed.cast(pa.binary()), batch.column(0)], ["tree", "label", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "tree int, label binary, node long")


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """(a, b, depth): nodes next to each other in a sorted order whose labels share ``depth`` values."""
    spark = nodes.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depths = (DEPTH, DEEP)
        last = {d: None for d in depths}
        head = {d: None for d in depths}
        begun = {d: True for d in depths}

        def bucket(key: bytes, d: int) -> int:
            v = np.frombuffer(key.ljust(32, b"\0")[:32], np.uint64) * np.array([3, 5, 7, 11], np.uint64)
            return int(bytesets.mix(np.array([bytesets.mix(v).sum() + np.uint64(d)], np.uint64)).view(np.int64)[0])

        def out(a, b, d):
            a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), d, np.int32))], ["a", "b", "depth"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tree = batch.column(0).to_numpy(zero_copy_only=False).astype("<u4")
            label = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, 2 * LABEL)
            node = batch.column(2).to_numpy(zero_copy_only=False)
            full = np.concatenate([tree.view(np.uint8).reshape(n, 4), label], axis=1)
            for d in depths:
                key = np.ascontiguousarray(full[:, : 4 + 2 * d])
                new = np.ones(n, bool)
                new[1:] = (key[1:] != key[:-1]).any(axis=1)
                first = key[0].tobytes()
                new[0] = first != last[d]
                # The head of each row's run; before the first new one it is the one carried over.
                at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
                heads = np.where(at >= 0, node[np.maximum(at, 0)], head[d] if head[d] is not None else 0)
                rest = ~new
                if rest.any():
                    yield out(heads[rest], node[rest], d)
                if begun[d]:
                    yield out([node[0]], [bucket(first, d)], d)
                    begun[d] = False
                last[d], head[d] = key[-1].tobytes(), int(heads[-1])
        for d in depths:
            if last[d] is not None:
                yield out([head[d]], [bucket(last[d], d)], d)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = _labels(nodes).repartitionByRange(n, "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    return ordered.mapInArrow(run, "a long, b long, depth int").where("a <> b").distinct()


def _regions(nodes: DataFrame) -> DataFrame:
    """(node, region, n_blocks): the nodes that share a region with another."""
    edges = stored(candidate_edges(nodes), "forest")
    real = nodes.select(F.col("node").alias("_n")).distinct()

    def grouped(links: DataFrame) -> DataFrame:
        found = components(links)
        found = found.join(real, F.col("node") == F.col("_n"), "left_semi")
        sizes = found.groupBy(F.col("root").alias("region")).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        return found.join(sizes, F.col("root") == F.col("region")).select("node", "region", "size")

    wide = stored(grouped(edges.where(F.col("depth") == DEPTH)), "regions")
    dense = wide.where(F.col("size") > BLOCK).select(F.col("node").alias("_d"))
    deep_edges = edges.where(F.col("depth") == DEEP)
    # Edges to nodes that stand for a prefix stay: they tie stretches together.
    deep = grouped(deep_edges.join(dense, F.col("a") == F.col("_d"), "left_semi"))
    both = wide.where(F.col("size") <= BLOCK).union(deep)
    return both.select("node", "region", F.ceil(F.col("size") / BLOCK).cast("int").alias("n_blocks"))


def _confirmed(sets: list[np.ndarray], owners: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join parts of one group: pairs with 100 * intersection >= percent * union.

    ``left`` and ``right`` say in which of the two blocks a set is. Sets are ordered by size, so the
    sets that a size allows are one range, and their intersections are one sum over marks.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, left, right, owners = sizes[order], left[order], right[order], owners[order]
    ids = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1]
    at = np.zeros(len(order) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    marks = np.zeros(int(ids.max()) + 1, np.int32)
    parent = np.arange(len(order))
    links = []

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for x in range(len(order) - 1):
        stop = int(np.searchsorted(sizes, sizes[x] * 100 // percent, side="right"))
        if stop <= x + 1:
            continue
        own = ids[at[x] : at[x + 1]]
        marks[own] = 1
        both = np.add.reduceat(marks[ids[at[x + 1] : at[stop]]], at[x + 1 : stop] - at[x + 1])
        marks[own] = 0
        near = 100 * both >= percent * (sizes[x] + sizes[x + 1 : stop] - both)
        near &= (left[x] & right[x + 1 : stop]) | (right[x] & left[x + 1 : stop])
        for y in np.flatnonzero(near) + x + 1:
            p, q = find(x), find(int(y))
            if p != q:
                parent[q] = p
                links.append((int(owners[x]), int(owners[y])))
    return links


def links(docs: DataFrame, regions: DataFrame, reps: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """(a, b): confirmed links between nodes; pairs already joined within a task are left out."""
    members = regions.join(reps.select(F.col("node").alias("_n"), F.col("rep")), F.col("node") == F.col("_n")).drop("_n")
    slim = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    texts = slim.join(members, F.col("_id").eqNullSafe(F.col("rep")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, found, at in _sets(batch.column(3), width):
                sums = bytesets.mix(np.add.reduceat(bytesets.mix(found), at[:-1][np.diff(at) > 0])).view(np.int64) if len(found) else np.zeros(0, np.int64)
                own = np.zeros(j - i, np.int64)
                own[np.diff(at) > 0] = sums
                # A repeated id may bring other texts; only the one the node was made of counts.
                keep = np.flatnonzero((own == nodes[i:j]) & (np.diff(at) > 0))
                part = batch.slice(i, j - i).take(pa.array(keep))
                data = [found[at[k] : at[k + 1]].tobytes() for k in keep]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(data, pa.binary())], ["node", "region", "n_blocks", "shingles"])

    rows = texts.select("node", "region", "n_blocks", "_text").mapInArrow(sets, "node long, region long, n_blocks int, shingles binary")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    dealt = rows.select("node", "region", "block", "shingles", other)
    dealt = dealt.select("region", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "shingles")
    dealt = dealt.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        now = None

        def done() -> pa.RecordBatch:
            own = {node: (block, np.frombuffer(data, np.uint64)) for node, block, data in held}
            nodes, blocks = np.array(list(own), np.int64), np.array([v[0] for v in own.values()])
            found = _confirmed([v[1] for v in own.values()], nodes, blocks == now[1], blocks == now[2], percent) if len(own) > 1 else []
            pairs = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            for region, i, j, node, block, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (region, i, j) != now:
                    if held:
                        yield done()
                    held, now = [], (region, i, j)
                held.append((node, block, data))
        if held:
            yield done()

    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``docs``."""
    sig = stored(signatures(docs, doc_id, text, width), "signatures")
    some = sig.where("n_shingles > 0")
    reps = some.groupBy("node", "check").agg(F.min("doc_id").alias("rep"))
    r = reps.select(F.col("node").alias("_n"), F.col("check").alias("_c"), "rep")
    nodes = some.join(r, F.expr("node = _n and check = _c and doc_id <=> rep")).select("node", "signature", "rep")
    nodes = stored(nodes, "nodes")
    regions = stored(_regions(nodes), "members")
    found = links(docs, regions, nodes.select("node", "rep").distinct(), doc_id, text, width, percent)
    roots = components(found).select(F.col("node").alias("_n"), "root")
    keyed = sig.join(roots, F.col("node") == F.col("_n"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")).alias("key")
    )
    least = keyed.where("key is not null").groupBy(F.col("key").alias("_k")).agg(F.min("doc_id").alias("_least"))
    out = keyed.join(least, F.col("key") == F.col("_k"), "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("_least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without near duplicates: rows whose id ``near_duplicates`` keeps; rows of one id share its fate."""
    (own,) = fresh(docs, "_id")
    kept = found.groupBy(F.col("doc_id").alias(own)).agg(F.max("kept").alias("k")).where("k").select(own)
    return docs.join(kept, F.col(doc_id).cast("long").eqNullSafe(F.col(own)), "left_semi")
