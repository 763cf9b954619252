"""Repeated passages by prefix-free parsing: bytes covered by a string of ``SPAN`` bytes that also
starts in an earlier document are removed.

Parsing. Every string of ``SPAN`` bytes holds the rolling hashes of its inner ``GRAM``-byte strings;
the least of them is its trigger. A maximal run of string starts with one trigger is a phrase: the
bytes from the first start to the end of the last string. Triggers depend on the string alone, so
equal passages fall into equal phrases except at their rims, and all occurrences of one string,
wherever they stand, are in phrases of one trigger.

Dictionary. Phrases meet by trigger. A phrase whose content also occurs in an earlier document
repeats as a whole; repetitive text is settled here, each distinct phrase once. Distinct phrases
that share a trigger may still share strings: only their suffixes (the strings inside) are put in
order, by hash under their trigger, and each string is given its first document. Strings of
distinct phrases with different triggers can't be equal, so nothing else is compared.

Spread. A batch of documents settles what it repeats itself and sends each distinct phrase once, so
a passage in a third of all documents sends one row per batch, not one per document. Rows are
blocks of numbers for a bucket of triggers; the answers are blocks for a group of documents. Texts
are moved twice, compressed, to meet their answers; nothing is collected.

Cases: null counts as empty; texts below ``SPAN`` bytes lose nothing; very long texts are parsed in
overlapping segments (a phrase cut at a border only makes more strings to compare); a null id comes
after all others; rows with equal id and text are one document and lose nothing to each other; rows
that repeat an id with another text are documents of their own, ordered by a hash of their text; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import bytesets
from chartloom.llm.blocks import group_count, group_of, keyed, keys_of, read, steps, write
from chartloom.llm.tables import fresh, stored

SPAN = 50
GRAM = 20
#: Buckets of triggers per shuffle partition; a task holds one bucket at a time.
BUCKETS_PER_PARTITION = 16
_U = np.uint64
_V_BYTES, _H_BYTES = 5, 6
_FULL, _RIM = 0, 1
#: Answers that a task holds before it sends them.
_HELD = 300_000
_BATCH = 8 << 20


def phrases(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of string starts, trigger and content hash of each phrase of a slice of texts."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, none, none.view(_U), none.view(_U)
    sums = bytesets.prefix_sums(bytesets.BYTE_VALUES[buf])
    inverse = bytesets.powers(n)[1]
    least = bytesets.mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    width, reach = SPAN - GRAM + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: -(width - reach)], least[width - reach :])
    starts, ends = offsets[:-1], offsets[1:]
    long = ends - starts >= SPAN
    change = np.zeros(n + 2, np.int32)
    change[starts[long]] += 1
    change[ends[long] - SPAN + 1] -= 1
    inside = np.cumsum(change)[: n - SPAN + 1] > 0
    new = np.ones(n - SPAN + 1, bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    new[starts[long]] = True
    first = np.flatnonzero(new & inside)
    stops = np.append(np.flatnonzero(new | ~inside), n - SPAN + 1)
    last = stops[np.searchsorted(stops, first, side="right")]
    return first, last - first, bytesets.mix(least[first]), bytesets.range_hash(sums, first, last + (SPAN - 1))


def _segments(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and end of pieces of at most ``SLICE`` bytes; those of one text overlap by SPAN - 1."""
    sizes = np.diff(offsets)
    parts = np.maximum(1, -(-(sizes - SPAN + 1) // bytesets.SLICE))
    owner = np.repeat(np.arange(len(sizes)), parts)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = offsets[:-1][owner] + k * bytesets.SLICE
    return owner, start, np.minimum(start + bytesets.SLICE + SPAN - 1, offsets[1:][owner])


def _parse(raw: np.ndarray, offsets: np.ndarray):
    """Text number, start in the text, length, trigger and hash of all phrases of a batch."""
    owner, start, end = _segments(offsets)
    out = []
    at = np.zeros(len(owner) + 1, np.int64)
    np.cumsum(end - start, out=at[1:])
    for i, j in bytesets.slices(at):
        buf = raw[start[i] : end[j - 1]] if (start[i + 1 : j] == end[i : j - 1]).all() else np.concatenate([raw[a:b] for a, b in zip(start[i:j], end[i:j])])
        first, length, trigger, content = phrases(buf, at[i : j + 1] - at[i])
        seg = i + np.searchsorted(at[i : j + 1] - at[i], first, side="right") - 1
        out.append((owner[seg], first - (at[seg] - at[i]) + start[seg] - offsets[owner[seg]], length, trigger, content))
    return [np.concatenate(c) for c in zip(*out)] if out else None


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about ``_BATCH`` bytes of text, which bounds what a task holds."""
    for batch in batches:
        for i, j in bytesets.slices(bytesets.text_bytes(batch.column(1))[1], _BATCH):
            yield batch.slice(i, j - i)


def _groups(*sorted_columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return new


#: What is to be said of phrases or strings: keys, starts, lengths and, for rims, triggers.
_Found = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]


def _answers(kind: int, keys: np.ndarray, start: np.ndarray, length: np.ndarray, trigger: np.ndarray | None, groups: int) -> pa.RecordBatch:
    """Rows (shard, kind, payload) that carry phrases or strings back to their documents' groups."""
    shard = group_of(keys, groups)
    order = np.lexsort((keys, shard))
    keys, start, length, shard = keys[order], start[order], length[order], shard[order]
    trigger = trigger[order] if trigger is not None else None
    cuts = np.flatnonzero(_groups(shard)) if len(keys) else np.zeros(0, np.int64)
    stops = np.append(cuts[1:], len(keys)) if len(cuts) else cuts
    data = []
    for a, b in zip(cuts, stops):
        columns = [(steps(keys[a:b]), 8), (start[a:b].astype(_U), 8), (length[a:b].astype(_U), 8)]
        data.append(write(columns + ([(trigger[a:b], 8)] if trigger is not None else [])))
    return pa.RecordBatch.from_arrays(
        [pa.array(shard[cuts].astype(np.int64)), pa.array(np.full(len(cuts), kind, np.int32)), pa.array(data, pa.binary())],
        ["shard", "kind", "payload"],
    )


_ANSWER = "shard long, kind int, payload binary"


def _sent(found: list[_Found], groups: int) -> Iterator[pa.RecordBatch]:
    """All that a task has found, one block per kind and group."""
    for kind in (_FULL, _RIM):
        parts = [f[1:] for f in found if f[0] == kind and len(f[1])]
        if parts:
            yield _answers(kind, *(np.concatenate(c) if c[0] is not None else None for c in zip(*parts)), groups)


def _first_round(docs: DataFrame, buckets: int, groups: int) -> DataFrame:
    """Phrases of batches by bucket of triggers (kind < 0), and what a batch settled itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            raw, offsets = bytesets.text_bytes(batch.column(1))
            found = _parse(raw, offsets)
            if found is None:
                continue
            owner, start, length, trigger, content = found
            keys = batch.column(0).to_numpy(zero_copy_only=False)[owner]
            order = np.lexsort((keys, content, trigger))
            new = _groups(trigger[order], content[order])
            first = keys[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            later = np.zeros(len(keys), bool)
            later[order] = keys[order] > first
            yield _tagged(_answers(_FULL, keys[later], start[later], length[later], None, groups))
            bucket = ((trigger >> _U(40)) * _U(buckets)) >> _U(24)
            send = np.flatnonzero(~later)
            send = send[np.lexsort((keys[send], bucket[send]))]
            b = bucket[send]
            cuts = np.flatnonzero(_groups(b)) if len(b) else np.zeros(0, np.int64)
            data = []
            for i, j in zip(cuts, np.append(cuts[1:], len(b))):
                s = send[i:j]
                data.append(
                    write([(trigger[s], _V_BYTES), (content[s], _H_BYTES), (steps(keys[s]), 8), (start[s].astype(_U), 8), (length[s].astype(_U), 8)])
                )
            n = len(cuts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b[cuts].astype(np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, -1, np.int32)), pa.array(data, pa.binary())],
                ["bucket", "shard", "kind", "payload"],
            )

    return docs.select("key", "text").mapInArrow(run, "bucket long, " + _ANSWER)


def _tagged(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Answers that pass through a round of buckets, dealt out by their shard."""
    away = pa.array(np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64) * 2 + (1 << 40))
    return pa.RecordBatch.from_arrays([away, *batch.columns], ["bucket", "shard", "kind", "payload"])


def _by_bucket(rows: DataFrame, settle, groups: int) -> DataFrame:
    """``settle(list of payloads) -> what it finds`` for each bucket; answers pass.

    What a task finds in its buckets is sent together, so there are as many rows as groups, not
    as many as documents times buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, found = [], None, []
        for batch in batches:
            kinds = batch.column(2).to_numpy(zero_copy_only=False)
            done = np.flatnonzero(kinds >= 0)
            if len(done):
                yield batch.take(pa.array(done)).select(["shard", "kind", "payload"])
            for k in np.flatnonzero(kinds < 0):
                bucket = batch.column(0)[int(k)].as_py()
                if bucket != now and held:
                    found += settle(held)
                    held = []
                    if sum(len(f[1]) for f in found) > _HELD:
                        yield from _sent(found, groups)
                        found = []
                now = bucket
                held.append(batch.column(3)[int(k)].as_py())
        if held:
            found += settle(held)
        yield from _sent(found, groups)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _ANSWER)


def _settle_phrases(payloads: list[bytes]) -> list[_Found]:
    """Phrases with an earlier equal one are repeats; first ones that share a trigger need their strings."""
    parts = [read(p, [_V_BYTES, _H_BYTES, 8, 8, 8])[0] for p in payloads]
    trigger, content, start, length = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 3, 4))
    keys = np.concatenate([keys_of(p[2]) for p in parts])
    order = np.lexsort((keys, content, trigger))
    trigger, content, keys, start, length = trigger[order], content[order], keys[order], start[order], length[order]
    by_trigger = _groups(trigger)
    by_content = by_trigger | _groups(content)
    first = keys[np.flatnonzero(by_content)][np.cumsum(by_content) - 1]
    later = keys > first
    at = np.flatnonzero(by_trigger)
    group = np.cumsum(by_trigger) - 1
    several = (np.add.reduceat(by_content.astype(np.int64), at) > 1) & (np.minimum.reduceat(keys, at) != np.maximum.reduceat(keys, at))
    rim = ~later & several[group]
    return [(_FULL, keys[later], start[later], length[later], None), (_RIM, keys[rim], start[rim], length[rim], trigger[rim])]


def _settle_strings(payloads: list[bytes]) -> list[_Found]:
    """Each string of the given phrases that an earlier document has under the same trigger."""
    keys, start, trigger, found = [], [], [], []
    for p in payloads:
        (t, k, s, n), at = read(p, [8, 8, 8, 8])
        k, n = keys_of(k), n.astype(np.int64)
        buf = np.frombuffer(p, np.uint8, offset=at)
        sizes = n + SPAN - 1
        begin = np.cumsum(sizes) - sizes
        which = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        where = begin[which] + place
        found.append(bytesets.range_hash(bytesets.prefix_sums(bytesets.BYTE_VALUES[buf]), where, where + SPAN))
        keys.append(k[which])
        start.append(s.astype(np.int64)[which] + place)
        trigger.append(t[which])
    keys, start, trigger, found = map(np.concatenate, (keys, start, trigger, found))
    order = np.lexsort((keys, found, trigger))
    new = _groups(trigger[order], found[order])
    first = keys[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    hit = order[keys[order] > first]
    hit = hit[np.lexsort((start[hit], keys[hit]))]
    keys, start = keys[hit], start[hit]
    run = np.ones(len(hit), bool)
    run[1:] = (keys[1:] != keys[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(run)
    return [(_FULL, keys[at], start[at], np.diff(np.append(at, len(hit))), None)]


def _with_answers(docs: DataFrame, answers: DataFrame, work, schema: str) -> DataFrame:
    """``work(doc rows, answers of their group)`` for each group of documents, texts compressed on the way."""
    groups = group_count(docs.sparkSession)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            n = batch.num_rows
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data = [c.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group_of(keys, groups)), pa.array(np.full(n, 2, np.int32)), pa.array(data, pa.binary()), batch.column(0), batch.column(2)],
                ["shard", "kind", "payload", "key", "id"],
            )

    texts = docs.select("key", "text", "id").mapInArrow(squeeze, _ANSWER + ", key long, id long")
    rows = texts.unionByName(answers.select("shard", "kind", "payload"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        now, own = None, []
        for batch in batches:
            held, size = [], 0
            for shard, kind, payload, key, doc in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    if held:
                        yield work(held, own)
                        held, size = [], 0
                    now, own = shard, []
                if kind < 2:
                    own.append((kind, payload))
                    continue
                if own and not isinstance(own, dict):
                    own = _sorted_answers(own)
                held.append((key, doc, d.decompress(payload)))
                size += len(held[-1][2])
                if size > 2 << 20:
                    yield work(held, own)
                    held, size = [], 0
            if held:
                yield work(held, own)

    ordered = rows.repartition("shard").sortWithinPartitions("shard", "kind").select("shard", "kind", "payload", "key", "id")
    return ordered.mapInArrow(run, schema)


def _sorted_answers(own: list[tuple[int, bytes]]) -> dict[int, tuple[np.ndarray, ...]]:
    """The answers of a group, ordered by document."""
    out = {}
    for kind in (_FULL, _RIM):
        parts = [read(p, [8, 8, 8] + [8] * (kind == _RIM))[0] for k, p in own if k == kind]
        if not parts:
            continue
        columns = [np.concatenate([keys_of(p[0]) for p in parts]), *(np.concatenate([p[k] for p in parts]) for k in range(1, len(parts[0])))]
        order = np.argsort(columns[0], kind="stable")
        out[kind] = tuple(c[order] for c in columns)
    return out


def _of(own, kind: int, key: int) -> tuple[np.ndarray, ...] | None:
    if not own or kind not in own:
        return None
    columns = own[kind]
    a, b = np.searchsorted(columns[0], [key, key + 1])
    return tuple(c[a:b] for c in columns[1:]) if b > a else None


def _rim_strings(docs: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """The bytes of the phrases whose strings must be compared, by bucket of triggers."""

    def work(held, own) -> pa.RecordBatch:
        out: dict[int, list] = {}
        for key, _, text in sorted(held, key=lambda h: h[0]):
            if (mine := _of(own, _RIM, key)) is None:
                continue
            start, length, trigger = mine
            # Only the low bytes of a trigger came back; they name its bucket as well as its group.
            for s, n, t in zip(start.tolist(), length.tolist(), trigger.tolist()):
                out.setdefault(t % buckets, []).append((t, key, s, n, text[s : s + n + SPAN - 1]))
        data = []
        for rows in out.values():
            t, k, s, n = (np.array([r[i] for r in rows], np.int64) for i in range(4))
            data.append(write([(t.view(_U), 8), (steps(k), 8), (s.view(_U), 8), (n.view(_U), 8)]) + b"".join(r[4] for r in rows))
        n = len(out)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(out), pa.int64()), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, -1, np.int32)), pa.array(data, pa.binary())],
            ["bucket", "shard", "kind", "payload"],
        )

    return _with_answers(docs, answers.where(F.col("kind") == _RIM), work, "bucket long, " + _ANSWER)


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kept_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, starts, ends, kept_sha256): the maximal removed runs of every text.

    ``kept_text`` adds ``text_sha256`` of the input and ``kept``: the text without code points all of
    whose bytes are removed.
    """
    spark = docs.sparkSession
    rows = keyed(docs, doc_id, text)
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = group_count(spark)
    whole = stored(_by_bucket(_first_round(rows, buckets, groups), _settle_phrases, groups), "phrases")
    rims = stored(_by_bucket(_rim_strings(rows, whole, buckets), _settle_strings, groups), "strings")

    def work(held, own) -> pa.RecordBatch:
        out = []
        for key, doc, data in held:
            starts = ends = np.zeros(0, np.int64)
            kept = data
            if (mine := _of(own, _FULL, key)) is not None:
                s, n = (c.astype(np.int64) for c in mine)
                change = np.zeros(len(data) + 1, np.int64)
                np.add.at(change, s, 1)
                np.add.at(change, np.minimum(s + n + SPAN - 1, len(data)), -1)
                gone = np.cumsum(change)[:-1] > 0
                edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
                starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                buf = np.frombuffer(data, np.uint8)
                kept = buf[~gone].tobytes()
            row = [doc, len(data), int((ends - starts).sum()), starts, ends, hashlib.sha256(kept).hexdigest()]
            if kept_text:
                if len(starts):
                    lead = np.flatnonzero((buf & 0xC0) != 0x80)
                    point = np.cumsum((buf & 0xC0) != 0x80) - 1
                    whole_point = np.logical_and.reduceat(gone, lead)
                    kept = buf[~whole_point[point]].tobytes()
                row += [hashlib.sha256(data).hexdigest(), kept.decode()]
            out.append(row)
        columns = list(zip(*out))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "n_removed", "starts", "ends", "kept_sha256", "text_sha256", "kept"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names[: len(columns)])

    schema = "doc_id long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept_sha256 string"
    answers = whole.where(F.col("kind") == _FULL).union(rims)
    return _with_answers(rows, answers, work, schema + (", text_sha256 string, kept string" if kept_text else ""))


def shortened(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeats taken out of ``text`` and ``n_chars`` (where there is one) following it.

    A code point goes if all its bytes do. Documents left with white space alone by that go.
    """
    i, sha, gone, kept, own = fresh(docs, "_id", "_sha", "_gone", "_kept", "_own")
    found = removed(docs, doc_id, text, kept_text=True).select(
        F.col("doc_id").alias(i), F.col("text_sha256").alias(sha), F.col("n_removed").alias(gone), F.col("kept").alias(kept)
    )
    # Rows with equal id and text have equal results; one of them is enough.
    found = found.dropDuplicates([i, sha])
    digest = F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256)
    # The text itself comes back from the work; here it only leaves whether there was one.
    slim = docs.select(*[F.col(c).isNull().alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], digest.alias(own))
    joined = slim.join(found, F.col(doc_id).cast("long").eqNullSafe(F.col(i)) & (F.col(own) == F.col(sha)))
    joined = joined.where((F.col(gone) == 0) | F.col(kept).rlike(r"[^\x20\x09-\x0D]"))
    new = {text: F.when(F.col(text), F.lit(None).cast("string")).otherwise(F.col(kept))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(gone) > 0, F.length(kept).cast("long")).otherwise(F.col("n_chars"))
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
