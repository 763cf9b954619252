"""Best-fit packing of token sequences.

Pieces are packed in decreasing length, each into the open sequence with the least room that still
takes it. Lengths are whole numbers up to the capacity, so all pieces of one length are alike and
all sequences with one remaining room are alike: the packing is decided on the counts per length,
a table of at most ``capacity`` numbers, with a segment tree over the remaining rooms that finds
the tightest in logarithmic time. The decisions are runs ("pieces 100 to 180 of length 37 go two by
two into sequences 5000 to 5039, from place 950"), a few thousand however many documents there are;
every task looks its pieces up in them. The result is that of best-fit decreasing done one by one.

Pieces of one length are numbered by task and place in the task, so no length, however common, is
gathered anywhere.

Cases: null and empty texts are one piece of the end mark alone; longer texts than the capacity are
cut into pieces of the capacity, the first of which may be shorter; rows that repeat an id are
documents of their own; a null id stays null; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.tables import stored

CAPACITY = 1024
END = 2
#: Text on which the fast engine must agree with the tokenizer before it is used.
PROBE = " it's  a\tprobe\n\nof 1234 words, é 漢字 🙂 we'll _see_ \r\n  END "


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer; a worker keeps one for all its tasks.

    The tokenizer is used as it is read: the text of a special token is that token. The vocabulary is handed to an
    engine that merges several times faster. It needs ids in the order of the merges and the public pattern of words, as
    the default vocabulary has them; if the two disagree on ``PROBE``, the tokenizer itself does all the work, and it
    always does texts that hold a special token.
    """

    _own: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.engine = self._engine()

    def _engine(self):
        import public_tokenizers
        import tiktoken

        # Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        value = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        special = set(self.tokenizer.get_added_tokens_decoder())
        vocabulary = {p: i for p, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if i not in special}
        if any(c not in value for p in vocabulary for c in p):
            return None
        ranks = {bytes(value[c] for c in p): i for p, i in vocabulary.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            return None
        engine = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        same = engine.encode_ordinary(PROBE) == self.tokenizer.encode(PROBE, add_special_tokens=False).ids
        return engine if same else None

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        slow = [k for k, t in enumerate(texts) if not self.engine or any(s in t for s in self.special)]
        done = dict(zip(slow, self.tokenizer.encode_batch_fast([texts[k] for k in slow], add_special_tokens=False)))
        found = [done[k].ids if k in done else self.engine.encode_ordinary(t) for k, t in enumerate(texts)]
        return [np.array(i, "<u4").tobytes() for i in found]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, place[, ids]): the pieces of every document.

    ``place`` numbers the pieces of one length within their task.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(0).to_pylist()
                texts = [t or "" for t in part.column(1).to_pylist()]
                columns = [[], [], [], [], [], [], [], []]
                for doc, data in zip(ids, encoder.ids(texts)):
                    data += end
                    n = len(data) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k in range(len(cuts) - 1):
                        a, b = cuts[k], cuts[k + 1]
                        own = data[4 * a : 4 * b]
                        for c, v in zip(columns, (doc, k, a, b - a, zlib.crc32(own), task, seen[b - a], own)):
                            c.append(v)
                        seen[b - a] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place", "ids"]
                count = len(names) - (not with_ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:count], kinds)], names[:count])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, place long" + (", ids binary" if with_ids else "")
    return slim.mapInArrow(run, schema)


class Rooms:
    """Segment tree over remaining rooms: which of them some open sequence has."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.base)

    def put(self, room: int, open_: bool) -> None:
        k = room + self.base
        self.some[k] = open_
        while k > 1:
            k >>= 1
            self.some[k] = self.some[2 * k] or self.some[2 * k + 1]

    def tightest(self, size: int) -> int | None:
        """The least room of at least ``size`` that is open."""
        k = size + self.base
        if self.some[k]:
            return size
        while k > 1:
            if k % 2 == 0 and self.some[k + 1]:
                k += 1
                while k < self.base:
                    k = 2 * k if self.some[2 * k] else 2 * k + 1
                return k - self.base
            k >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first piece, first sequence, pieces in a sequence, place) in order of length and piece."""
    rooms, open_ = Rooms(capacity), {}
    runs, fresh = [], 0

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if not open_.get(room):
                open_[room] = []
                rooms.put(room, True)
            open_[room].append((first, n))

    for size in sorted(counts, reverse=True):
        done, left = 0, counts[size]
        while left:
            room = rooms.tightest(size)
            if room is None:
                room = capacity
                first, n = fresh, -(-left // (capacity // size))
                fresh += n
            else:
                first, n = open_[room].pop()
                if not open_[room]:
                    rooms.put(room, False)
            each = room // size
            put = min(left, n * each)
            runs.append((size, done, first, each, capacity - room))
            full, rest = divmod(put, each)
            add(room - each * size, first, full)
            if rest:
                add(room - rest * size, first + full, 1)
            used = full + (rest > 0)
            add(room, first + used, n - used)
            done, left = done + put, left - put
    return runs


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (rows with length, task and place as ``pieces`` makes them) with sequence_id and offset."""
    per_length = found.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_length.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs = best_fit_decreasing(counts, capacity)
    table = np.array(runs or [(0, 0, 0, 1, 0)], np.int64)
    order = np.lexsort((table[:, 1], table[:, 0]))
    size, piece, sequence, each, place = table[order].T
    ends = np.searchsorted(size, np.arange(capacity + 2))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = per_length.select(F.col("length").alias("_l"), F.col("task").alias("_t"), F.coalesce(before, F.lit(0)).alias("_base"))
    names = [f.name for f in found.schema.fields if f.name not in ("task", "place")]
    numbered = found.join(bases, (F.col("length") == F.col("_l")) & (F.col("task") == F.col("_t")))
    numbered = numbered.select(*names, (F.col("_base") + F.col("place")).alias("_number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            number = batch.column(len(names)).to_numpy(zero_copy_only=False)
            k = np.zeros(len(n), np.int64)
            for s in np.unique(n):
                own = n == s
                a, b = ends[s], ends[s + 1]
                k[own] = a + np.searchsorted(piece[a:b], number[own], side="right") - 1
            inside = number - piece[k]
            columns = [sequence[k] + inside // each[k], place[k] + inside % each[k] * n]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *map(pa.array, columns)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields if f.name in names)
    return numbered.mapInArrow(run, fields + ", sequence_id long, offset long")


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    return pack(stored(pieces(docs, doc_id, text, path, capacity, with_ids), "pieces"), capacity)


def sequences(rows: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, from ``packed(..., with_ids=True)``; a group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("h"))))
    return rows.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["h"]), "")).alias("ids"))
