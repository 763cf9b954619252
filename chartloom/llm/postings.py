"""Benchmark decontamination with a distributed positional inverted index.

Words are runs of ASCII letters and digits and of all other characters above ASCII, A-Z in lower case.

* **Index.** ``indexed`` writes a table of blocks, each over about 256 KB of text: a dictionary of its words, ordered by
  hash, and for each word the ascending list of its positions. Every word of every text is stored, so one
  index answers any later test set. Blocks are cut by documents, not by words: no frequent word is one task's list.
  A text longer than a block is cut at words; neighbouring blocks share ``REACH - 1`` words, so no phrase
  of up to ``REACH`` words and no span of that width is lost.
* **Phrases.** The words of a phrase are looked up by hash and confirmed on their bytes. The list of its rarest
  word in the block gives possible starts, which are intersected with the lists of the next rarer words, each
  shifted by its offset in the phrase, until all words are confirmed.
* **Proximity.** The shortest span of at most ``width`` words that holds all words of a phrase, in any order: each
  place of the rarest word is kept while the lists of the others have a place near enough, and spans are then
  measured around those that are left.
* **Test sets** of any size are asked in batches of at most ``BATCH_WORDS`` words, cut so that a batch holds whole
  phrases; only a batch is broadcast, and its size is counted first.

Cases: null and texts without words have no words and match nothing; items without words ask nothing; items that repeat an
id are one item; an item with a null id marks words, but is not named; rows that repeat an id, or are
equal, are documents of their own; an empty table of documents gives an empty result, and without items nothing is hit;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chartloom.llm import bytesets
from chartloom.llm.blocks import pack, unpack
from chartloom.llm.tables import stored

#: Words of the longest phrase, or of the widest span, that a block boundary inside a text can't hide.
REACH = 128
#: Bytes of text of a block.
BLOCK = 1 << 18
#: Words of one batch of test items, and of the pieces that items are cut into.
BATCH_WORDS = 1 << 18
PIECE = 1 << 12
#: Candidate places worked on at a time.
CANDIDATES = 1 << 20
_U = np.uint64

IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each text (one more at the end)."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = IS_WORD[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return bytesets.range_hash(bytesets.prefix_sums(bytesets.BYTE_VALUES[buf]), starts, ends)


def _spelt(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The bytes of these words, one after the other."""
    sizes = ends - starts
    at = np.cumsum(sizes) - sizes
    return buf[np.repeat(starts - at, sizes) + np.arange(int(sizes.sum()))].tobytes()


class Part(NamedTuple):
    """Consecutive texts, or a cut of one long text: raw bytes, offsets, words before it, words that only it counts."""

    first: int
    raw: np.ndarray
    offsets: np.ndarray
    base: int
    own: int | None


def _parts(raw: np.ndarray, offsets: np.ndarray) -> Iterator[Part]:
    for i, j in bytesets.slices(offsets, BLOCK):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= 2 * BLOCK or j > i + 1:
            yield Part(i, raw[a:b], offsets[i : j + 1] - a, 0, None)
            continue
        base = 0
        while True:
            end = a
            while True:  # on to the next gap between words; a cut needs enough words to share some and go on
                end = min(end + BLOCK, b)
                while end < b and IS_WORD[raw[end]]:
                    gaps = np.flatnonzero(~IS_WORD[raw[end : end + BLOCK]])
                    end = min(end + (int(gaps[0]) if len(gaps) else BLOCK), b)
                starts = _words(raw[a:end], np.array([0, end - a]))[0]
                if end == b or len(starts) >= 2 * REACH:
                    break
            back = len(starts) if end == b else len(starts) - REACH + 1
            yield Part(i, raw[a:end], np.array([0, end - a]), base, back)
            if end == b:
                break
            base, a = base + back, a + int(starts[back])


_INDEX = [
    ("row", "array<long>"),
    ("first", "array<long>"),
    ("base", "array<long>"),
    ("words", "array<long>"),
    ("own", "array<long>"),
    ("n_terms", "long"),
    ("n_places", "long"),
    ("keys", "binary"),
    ("counts", "binary"),
    ("sizes", "binary"),
    ("spelling", "binary"),
    ("places", "binary"),
]


def _block(part: Part, rows: np.ndarray) -> list:
    """One row of the index, without the ids: see ``_INDEX``."""
    buf = bytesets.LOWER[part.raw]
    starts, ends, before = _words(buf, part.offsets)
    counts = np.diff(before)
    texts = np.arange(len(counts))
    hashes = _hashes(buf, starts, ends)
    order = np.argsort(hashes, kind="stable")
    places = order + np.repeat(texts, counts)[order]  # one free place after each text
    ordered = hashes[order]
    cut = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.zeros(0, np.int64)
    one = order[cut]
    n = np.diff(np.append(cut, len(order)))
    return [
        rows.tolist(),
        (before[:-1] + texts).tolist(),
        [part.base] * len(counts),
        counts.tolist(),
        [part.own] if part.own is not None else counts.tolist(),
        len(cut),
        len(order),
        (hashes[one] >> _U(32)).astype("<u4").tobytes(),
        pack(n.astype(_U), 4),
        pack((ends - starts)[one].astype(_U), 4),
        _spelt(buf, starts[one], ends[one]),
        pack(places.astype(_U), 4),
    ]


def indexed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index of all texts, written to the shared folder: a row for each block.

    A block names its texts by ``row`` (a number of its own for each row of ``docs``) and ``id``.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0).to_numpy()
            raw, offsets = bytesets.text_bytes(batch.column(2))
            for part in _parts(raw, offsets):
                n = len(part.offsets) - 1
                cells = _block(part, row[part.first : part.first + n])
                ids = batch.column(1).slice(part.first, n)
                ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids)
                kinds = [pa.list_(pa.int64()) if t == "array<long>" else pa.int64() if t == "long" else pa.binary() for _, t in _INDEX]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([c], k) for c, k in zip(cells, kinds))], ["id", *(c for c, _ in _INDEX)])

    schema = f"id array<{kind}>, " + ", ".join(f"{c} {t}" for c, t in _INDEX)
    return stored(slim.mapInArrow(build, schema), "postings")


class Asked(NamedTuple):
    """A batch of phrases: distinct words, distinct phrases as places among them, and the items of each phrase."""

    keys: np.ndarray
    spelling: list[bytes]
    phrases: np.ndarray  # one row each, -1 behind the last word
    sizes: np.ndarray
    owner_at: np.ndarray
    owners: np.ndarray
    names: list


def _asked(items: list[tuple], window: int | None) -> Asked:
    """``items``: (name, words); ``window`` None asks for each item whole."""
    names: dict = {}
    words: dict[bytes, int] = {}
    runs = [(names.setdefault(name, len(names)), np.array([words.setdefault(w.encode(), len(words)) for w in ws])) for name, ws in items if ws]
    by_size: dict[int, list] = {}
    for name, run in runs:
        size = len(run) if window is None else min(window, len(run))
        wide = np.lib.stride_tricks.sliding_window_view(run, size)
        by_size.setdefault(size, []).append((np.full(len(wide), name), wide))
    widest = max(by_size, default=0)
    phrases, sizes, owners, owner_of = [], [], [], []
    for size, found in sorted(by_size.items()):
        distinct, which = np.unique(np.concatenate([w for _, w in found]), axis=0, return_inverse=True)
        at = sum(len(p) for p in phrases)
        pairs = np.unique(np.stack([which.ravel() + at, np.concatenate([o for o, _ in found])]), axis=1)
        owner_of.append(pairs[0])
        owners.append(pairs[1])
        sizes.append(np.full(len(distinct), size))
        phrases.append(np.pad(distinct, ((0, 0), (0, widest - size)), constant_values=-1))
    n = sum(len(p) for p in phrases)
    spelling = list(words)
    buf = np.frombuffer(b"".join(spelling), np.uint8)
    ends = np.cumsum([len(s) for s in spelling]).astype(np.int64) if spelling else np.zeros(0, np.int64)
    keys = _hashes(buf, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if spelling else np.zeros(0, _U)
    owner_of = np.concatenate(owner_of) if owner_of else np.zeros(0, np.int64)
    return Asked(
        (keys >> _U(32)).astype(np.uint32),
        spelling,
        np.concatenate(phrases) if phrases else np.zeros((0, 0), np.int64),
        np.concatenate(sizes) if sizes else np.zeros(0, np.int64),
        np.searchsorted(owner_of, np.arange(n + 1)),
        np.concatenate(owners) if owners else np.zeros(0, np.int64),
        list(names),
    )


def _batches(items: DataFrame, item_id: str, text: str, window: int | None) -> Iterator[list[tuple]]:
    """Test items as lists of (name, words), each of at most ``BATCH_WORDS`` words and never an item's phrase cut in two."""
    share = (window or 1) - 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = bytesets.text_bytes(batch.column(2))
            buf = bytesets.LOWER[raw]
            starts, ends, before = _words(buf, offsets)
            for k, (row, name) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                a, b = int(before[k]), int(before[k + 1])
                if window is None and b - a > REACH:
                    raise ValueError(f"a phrase of {b - a} words; at most {REACH} can be asked")
                part = 0
                while a < b:
                    part += 1
                    c = b if window is None else min(a + PIECE, b)
                    words = [buf[s:e].tobytes().decode() for s, e in zip(starts[a:c].tolist(), ends[a:c].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([name], pa.string()), pa.array([part]), pa.array([len(words)]), pa.array([words])], ["row", "name", "part", "n", "words"])
                    a = b if c == b else c - share

    slim = items.select(F.monotonically_increasing_id().alias("row"), F.col(item_id).cast("string").alias("name"), F.col(text).alias("text"))
    pieces = stored(slim.mapInArrow(split, "row long, name string, part long, n long, words array<string>"), "asked")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    buckets = -(-2 * total // BATCH_WORDS)
    while buckets:
        bucket = F.pmod(F.xxhash64("row", "part"), F.lit(buckets))
        most = pieces.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
        if most <= BATCH_WORDS:
            break
        buckets *= 2
    for k in range(buckets):
        yield [(r.name, r.words) for r in pieces.where(bucket == k).collect()]


class Lists:
    """What a block knows about the words of a batch: their lists of positions."""

    def __init__(self, block: dict, asked: Asked):
        n_terms, n_places = block["n_terms"], block["n_places"]
        keys = np.frombuffer(block["keys"], "<u4")
        counts, _ = unpack(block["counts"], n_terms, 4, 0)
        sizes, _ = unpack(block["sizes"], n_terms, 4, 0)
        counts, sizes = counts.astype(np.int64), sizes.astype(np.int64)
        list_at, spelt_at = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes
        a, b = np.searchsorted(keys, asked.keys, "left"), np.searchsorted(keys, asked.keys, "right")
        found = np.full(len(asked.keys), -1)
        spelling = block["spelling"]
        for w in np.flatnonzero(b > a):
            for k in range(a[w], b[w]):
                if spelling[spelt_at[k] : spelt_at[k] + sizes[k]] == asked.spelling[w]:
                    found[w] = k
        here = np.flatnonzero(found >= 0)
        planes = np.frombuffer(block["places"], np.uint8).reshape(4, n_places)
        #: Number of occurrences of each word of the batch.
        self.count = np.zeros(len(asked.keys), np.int64)
        self.count[here] = counts[found[here]]
        sizes, at = self.count[here], list_at[found[here]]
        #: Where the list of each word begins in ``keyed``.
        self.at = np.zeros(len(asked.keys), np.int64)
        self.at[here] = np.cumsum(sizes) - sizes
        take = np.repeat(at - self.at[here], sizes) + np.arange(int(sizes.sum()))
        places = np.zeros(len(take), np.int64)
        for k in range(4):
            places |= planes[k, take].astype(np.int64) << (8 * k)
        #: All lists, one after the other, as word * 2^32 + position: ascending.
        self.keyed = (np.repeat(here, sizes) << 32) | places

    def up_to(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The last position of each word that is not behind a place, or a negative number."""
        if not len(self.keyed):
            return np.full(len(word), -(1 << 40))
        k = np.searchsorted(self.keyed, (word << 32) | place, "right") - 1
        got = self.keyed[np.maximum(k, 0)]
        return np.where((k >= 0) & (got >> 32 == word), got & 0xFFFFFFFF, -(1 << 40))

    def starts(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which, position) of all occurrences of each of ``words``, in bounded pieces."""
        n = self.count[words]
        ahead = np.cumsum(n)
        total = int(ahead[-1]) if len(n) else 0
        for a in range(0, total, CANDIDATES):
            k = np.arange(a, min(a + CANDIDATES, total))
            which = np.searchsorted(ahead, k, "right")
            yield which, self.keyed[self.at[words[which]] + k - (ahead - n)[which]] & 0xFFFFFFFF


def _rarest_first(lists: Lists, asked: Asked) -> tuple[np.ndarray, np.ndarray]:
    """Phrases all of whose words the block has, and the order of their words by rising list length."""
    if not asked.phrases.size:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
    n = np.where(asked.phrases >= 0, lists.count[asked.phrases], 1 << 60)
    alive = np.flatnonzero(n.min(axis=1) > 0)
    return alive, np.argsort(n[alive], axis=1, kind="stable")


def phrase_places(lists: Lists, asked: Asked) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, position of its first word) of all exact occurrences in the block."""
    alive, order = _rarest_first(lists, asked)
    found = []
    if len(alive):
        words = asked.phrases[alive]
        for which, place in lists.starts(words[np.arange(len(alive)), order[:, 0]]):
            start = place - order[which, 0]
            for r in range(1, order.shape[1]):
                offset = order[which, r]
                asks = r < asked.sizes[alive[which]]
                target = start + offset
                keep = ~asks | ((target >= 0) & (lists.up_to(words[which, offset], np.maximum(target, 0)) == target))
                which, start = which[keep], start[keep]
                if not len(which):
                    break
            found.append((alive[which], start))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def near_spans(lists: Lists, asked: Asked, first: np.ndarray, words: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(phrase, text, first position, words) of the shortest span of each phrase in each text, ``width`` words at most.

    ``first`` and ``words`` say where the texts of the block begin and how long they are.
    """
    alive, order = _rarest_first(lists, asked)
    found = []
    if len(alive):
        by_list = np.take_along_axis(asked.phrases[alive], order, axis=1)
        for which, place in lists.starts(by_list[:, 0]):
            for r in range(1, order.shape[1]):
                word = by_list[which, r]
                keep = (word < 0) | (lists.up_to(np.maximum(word, 0), place + width - 1) > place - width)
                which, place = which[keep], place[keep]
            if not len(which):
                continue
            text = np.searchsorted(first, place, "right") - 1
            last = first[text] + words[text] - 1
            best = np.full(len(which), 1 << 60)  # words of the span, then its position
            for step in range(width):
                end = place + step
                low = end.copy()
                for r in range(order.shape[1]):
                    word = by_list[which, r]
                    low = np.where(word < 0, low, np.minimum(low, lists.up_to(np.maximum(word, 0), end)))
                size = end - low + 1
                fits = (end <= last) & (low >= first[text]) & (size <= width)
                best = np.where(fits, np.minimum(best, (size << 32) | np.maximum(low, 0)), best)
            got = best < 1 << 60
            found.append(np.stack([alive[which[got]], text[got], best[got]]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    phrase, text, best = np.concatenate(found, axis=1)
    order = np.lexsort((best, text, phrase))
    phrase, text, best = phrase[order], text[order], best[order]
    new = np.concatenate([[True], (phrase[1:] != phrase[:-1]) | (text[1:] != text[:-1])]) if len(phrase) else np.zeros(0, bool)
    return phrase[new], text[new], best[new] & 0xFFFFFFFF, best[new] >> 32


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def _id_type(index: DataFrame) -> tuple[str, pa.DataType]:
    kind = index.schema["id"].dataType.elementType
    return kind.simpleString(), to_arrow_type(kind)


def _owners(asked: Asked, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items of each of these phrases, one after the other, and how many each has."""
    n = np.diff(asked.owner_at)[phrase] if len(phrase) else phrase
    return asked.owners[np.repeat(asked.owner_at[phrase] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))] if len(phrase) else phrase, n


def _each(index: DataFrame, items: DataFrame, item_id: str, text: str, window: int | None, run, schema: str, empty: bool = False) -> DataFrame:  # noqa: ANN001
    """``run(block, lists, asked, batch number)`` over all blocks for each batch of the test set; its rows united."""
    spark, out = index.sparkSession, None
    for number, got in enumerate(_batches(items, item_id, text, window)):
        shared = spark.sparkContext.broadcast(_asked(got, window))
        out = _union(out, _one(index, shared, number, run, schema))
    if out is None:
        out = _one(index, spark.sparkContext.broadcast(_asked([], window)), 0, run, schema)
        out = out if empty else out.where("false")
    return out


def _union(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def _one(index: DataFrame, shared, number: int, run, schema: str) -> DataFrame:  # noqa: ANN001
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            asked = shared.value
            yield from run(block, Lists(block, asked), asked, number)

    return index.mapInArrow(ask, schema)


def phrases(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_row, doc_id, item, start): every exact occurrence of the word sequence of every item, from word ``start``.

    Items have ``REACH`` words at most. Occurrences that two blocks share are given once.
    """
    kind, id_type = _id_type(index)

    def run(block: dict, lists: Lists, asked: Asked, number: int) -> Iterator[pa.RecordBatch]:
        phrase, start = phrase_places(lists, asked)
        owner, n = _owners(asked, phrase)
        first = np.array(block["first"])
        start = np.repeat(start, n)
        doc = np.searchsorted(first, start, "right") - 1
        at = start - first[doc] + np.array(block["base"])[doc]
        rows = pa.array(block["row"], pa.int64()), pa.array(block["id"], id_type), pa.array(asked.names, pa.string())
        yield pa.RecordBatch.from_arrays([rows[0].take(pa.array(doc)), rows[1].take(pa.array(doc)), rows[2].take(pa.array(owner, pa.int64())), pa.array(at, pa.int64())], ["doc_row", "doc_id", "item", "start"])

    return _each(index, items, item_id, text, None, run, f"doc_row long, doc_id {kind}, item string, start long").distinct()


def near(index: DataFrame, items: DataFrame, width: int = 20, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_row, doc_id, item, n_span, start): per text and item the shortest span of at most ``width`` words that
    holds all words of the item, in any order; the first of the shortest."""
    if width > REACH:
        raise ValueError(f"spans of at most {REACH} words can be asked")
    kind, id_type = _id_type(index)

    def run(block: dict, lists: Lists, asked: Asked, number: int) -> Iterator[pa.RecordBatch]:
        first, words = np.array(block["first"]), np.array(block["words"])
        phrase, doc, start, size = near_spans(lists, asked, first, words, width)
        owner, n = _owners(asked, phrase)
        doc, start, size = (np.repeat(c, n) for c in (doc, start, size))
        at = start - first[doc] + np.array(block["base"])[doc]
        rows = pa.array(block["row"], pa.int64()), pa.array(block["id"], id_type), pa.array(asked.names, pa.string())
        yield pa.RecordBatch.from_arrays(
            [rows[0].take(pa.array(doc)), rows[1].take(pa.array(doc)), rows[2].take(pa.array(owner, pa.int64())), pa.array(size, pa.int64()), pa.array(at, pa.int64())],
            ["doc_row", "doc_id", "item", "n_span", "start"],
        )

    found = _each(index, items, item_id, text, None, run, f"doc_row long, doc_id {kind}, item string, n_span long, start long")
    best = F.min(F.struct("n_span", "start"))
    return found.groupBy("doc_row", "doc_id", "item").agg(best.alias("b")).select("doc_row", "doc_id", "item", "b.n_span", "b.start")


def _hits(block: dict, lists: Lists, asked: Asked, number: int, width: int, id_type: pa.DataType) -> pa.RecordBatch:
    """A row for each text of the block: hit runs of words, items found, items only near."""
    first, words, base = (np.array(block[c], np.int64) for c in ("first", "words", "base"))
    n = len(first)
    phrase, start = phrase_places(lists, asked)
    end = start + asked.sizes[phrase] if len(phrase) else start
    length = int(first[-1] + words[-1] + 2) if n else 1
    cover = np.cumsum(np.bincount(start, minlength=length) - np.bincount(end, minlength=length)) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    doc = np.searchsorted(first, a, "right") - 1
    shift = base[doc] - first[doc]
    runs = pa.StructArray.from_arrays([pa.array(a + shift), pa.array(b + shift)], ["a", "b"])
    run_at = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
    exact = np.unique(np.stack([np.searchsorted(first, start, "right") - 1, phrase]), axis=1)
    phrase, text, _, _ = near_spans(lists, asked, first, words, width)
    close = np.stack([text, phrase])
    names = pa.array(asked.names, pa.string())
    named = np.array([x is not None for x in asked.names], bool)

    def items(pairs: np.ndarray) -> pa.ListArray:
        owner, k = _owners(asked, pairs[1])
        docs, owner = np.unique(np.stack([np.repeat(pairs[0], k), owner]), axis=1)
        keep = named[owner] if len(owner) else np.zeros(0, bool)
        docs, owner = docs[keep], owner[keep]
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(docs, np.arange(n + 1)), pa.int32()), names.take(pa.array(owner, pa.int64())))

    return pa.RecordBatch.from_arrays(
        [
            pa.array(block["row"], pa.int64()),
            pa.array(block["id"], id_type),
            pa.array(block["own"] if number == 0 else [0] * n, pa.int64()),
            pa.ListArray.from_arrays(run_at, runs),
            items(exact),
            items(close),
        ],
        ["doc_row", "doc_id", "n_words", "runs", "items", "close"],
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, width: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: what of it the test items hold.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window. Columns:
    ``doc_id``, ``n_words``, ``hits`` (runs of words ``[a, b)`` inside occurrences of windows, in order), ``items`` (ids, as
    text, of the items with an occurring window, sorted) and ``near_items`` (those of which all words of a window
    stand within ``width`` words, in any order; every item of ``items`` is among them if ``width`` is at least ``window``).
    """
    if max(window, width) > REACH:
        raise ValueError(f"windows and spans of at most {REACH} words can be asked")
    index = indexed(docs, doc_id, text)

    kind, id_type = _id_type(index)

    def run(block: dict, lists: Lists, asked: Asked, number: int) -> Iterator[pa.RecordBatch]:
        yield _hits(block, lists, asked, number, width, id_type)

    schema = f"doc_row long, doc_id {kind}, n_words long, runs array<struct<a:long,b:long>>, items array<string>, close array<string>"
    found = _each(index, items, item_id, item_text, window, run, schema, empty=True)
    every = lambda c: F.flatten(F.collect_list(c))
    whole = found.groupBy("doc_row").agg(
        F.first("doc_id").alias(doc_id),
        F.sum("n_words").alias("n_words"),
        F.array_sort(every("runs")).alias("hits"),
        F.array_sort(F.array_distinct(every("items"))).alias("items"),
        F.array_sort(F.array_distinct(every("close"))).alias("near_items"),
    )
    whole = whole.select(doc_id, "n_words", "hits", "items", "near_items")
    return whole.mapInArrow(_joined, whole.schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a text that touch or overlap, because two blocks or two batches gave them, as one."""
    for batch in batches:
        hits = batch.column("hits")
        a, b = (hits.flatten().field(k).to_numpy() for k in (0, 1))
        owner = np.repeat(np.arange(batch.num_rows), hits.value_lengths().to_numpy(zero_copy_only=False))
        far = np.maximum.accumulate(b + (owner << 40)) if len(b) else b
        new = np.concatenate([[True], (a + (owner << 40))[1:] > far[:-1]])[: len(a)]
        at = np.flatnonzero(new)
        end = far[np.append(at[1:], len(a)) - 1] - (owner[at] << 40) if len(at) else at
        runs = pa.StructArray.from_arrays([pa.array(a[at]), pa.array(end)], fields=list(hits.type.value_type))
        cut = pa.array(np.searchsorted(owner[at], np.arange(batch.num_rows + 1)), pa.int32())
        joined = pa.ListArray.from_arrays(cut, runs, type=hits.type)
        yield batch.set_column(batch.schema.get_field_index("hits"), batch.schema.field("hits"), joined)


def contamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``contamination`` as counts and a digest of the items found."""
    found = contamination(docs, items)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


#: Words by the same rule, A-Z alone in lower case; every window of every length asked for is joined as text.
SQL = r"""
with lowered as (select row_number() over () as r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
d as (select r, doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), cast([] as varchar[])) as w from lowered),
i as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
spread as (select item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from i where len(w) > 0),
windows as (select distinct item_id, k, array_to_string(w[p:p + k - 1], ' ') as s, list_sort(list_distinct(w[p:p + k - 1])) as bag from spread),
sizes as (select distinct k from windows),
starts as (select r, k, unnest(range(1, len(w) - k + 2)) as p, w from d, sizes where len(w) >= k),
found as (select distinct a.r, a.p, a.k, b.item_id from (select r, p, k, array_to_string(w[p:p + k - 1], ' ') as s from starts) a join windows b on a.k = b.k and a.s = b.s),
hit as (select r, count(distinct q) as n from (select r, unnest(range(p, p + k)) as q from found) group by r),
named as (select r, count(*) as n, string_agg(id, ',' order by id) as ids from (select distinct r, cast(item_id as varchar) as id from found where item_id is not null) group by r),
-- a window is near where all its words stand within 20 words: judged at the places of its longest word
bags as (select item_id, bag, list_reduce(bag, lambda x, y: case when length(y) > length(x) then y else x end) as w1 from (select distinct item_id, bag from windows)),
places as (select r, w, unnest(range(1, len(w) + 1)) as p from d),
anchors as (select distinct r, w[greatest(p - 19, 1):p + 19] as around, b.item_id, b.bag from places, bags b where w[p] = b.w1 and len(list_filter(b.bag, lambda x: not list_contains(w[greatest(p - 19, 1):p + 19], x))) = 0),
close as (select r, count(distinct item_id) as n from (select r, item_id, bag, around[q:q + 19] as span from (select *, unnest(range(1, greatest(len(around) - 19, 1) + 1)) as q from anchors))
  where len(list_filter(bag, lambda x: not list_contains(span, x))) = 0 group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(named.n, 0) as n_items, sha256(coalesce(named.ids, '')) as items_sha256,
  coalesce(hit.n, 0) > 0 as contaminated, coalesce(close.n, 0) as n_near_items
from d left join hit using (r) left join named using (r) left join close using (r)
"""
