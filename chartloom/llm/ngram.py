"""Language-model scoring with an Elias-Fano n-gram trie.

Tokens are the words of a text, A-Z in lower case, then one end. The model is learned from all
documents that aren't held out; nothing it gathers is capped.

* Level 1, words: P1(w) = (c(w) + 1) / (N + V + 1), one share for all unknown words.
* Level 2, a word after the word before it (or after the start of a text):
  P(w | h) = (c(h, w) + m(h) P1(w)) / (c(h) + m(h)), a proper distribution. m(h), how many
  different words h should have been followed by, is read off the corpus's own growth of vocabulary:
  m(h) = a c(h)^b through the mean document and the whole corpus. Every training token is a
  context, and so is the start; after a word never seen the first level speaks alone.

The trie is cut into shards by a hash of the words. A shard holds, as Elias-Fano coded monotone
sequences, its words, its contexts (64-bit hashes both), the pointers from each word to its contexts,
and the contexts' ranks relative to the word's rank, so a successor search finds a pair; and the
probabilities, quantised to 16 bits. Shards are memory-mapped files while a task queries them.

Spread. Vocabulary counts are added up per batch first. Then every token goes, with a reference to
its document, to the shards that know the counts it needs; training tokens build a shard there, all
tokens query it, and sums per document and shard come back. The ``COMMON`` most frequent tokens and
their counts are known to every task (at most 64 Ki numbers, whatever the corpus); they only decide
the way, so that no frequent word or context is one task's work:

* a common word after a common context: the shard of the pair;
* a common word after a rarer one: the shard of the context, which counts it;
* a rarer word after a common context: the shard of the word, which counts it;
* a rarer word after a rarer one: the shard of the context, and with its count on to that of the word.

Cases: null counts as empty, and the empty text is one end; a null id is never held out; rows that
repeat an id are documents of their own, and so are equal rows; without training documents every
probability is 1; long texts are one row in one batch; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import bytesets
from chartloom.llm.blocks import group_count, group_of, keyed, keys_of, read, steps, write
from chartloom.llm.tables import remainder, stored

COMMON = 65_534
START, NONE = 65_534, 65_535
#: The start as a context among hashes.
BEGIN = np.uint64(0x57A7)
END = np.uint64(0xE7D5)
BUCKETS_PER_PARTITION = 2
QUANTA = 4096
#: Rows a task gathers before it sends them on.
GATHERED = 500_000
_U = np.uint64


class EliasFano:
    """A non-decreasing sequence of 64-bit numbers: low bytes as they are, high parts in unary."""

    @staticmethod
    def coded(values: np.ndarray) -> bytes:
        n = len(values)
        top = int(values[-1]) if n else 0
        low = min(7, -(-max(0, (top // max(n, 1)).bit_length() - 1) // 8))
        high = (values >> _U(8 * low)).astype(np.int64)
        bits = np.zeros(n + (int(high[-1]) if n else 0) + 2, np.uint8)
        bits[high + np.arange(n)] = 1
        unary = np.packbits(bits).tobytes()
        lows = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :low].tobytes()
        head = np.array([n, low, len(bits), len(unary)], "<u8").tobytes()
        return head + unary + lows

    def __init__(self, data: np.ndarray, at: int = 0):
        n, low, n_bits, n_bytes = (int(x) for x in data[at : at + 32].view("<u8"))
        at += 32
        self.n, self.low = n, low
        ones = np.unpackbits(data[at : at + n_bytes], count=n_bits)
        at += n_bytes
        zeros = np.flatnonzero(ones == 0)
        #: Elements with a high part below each value of it.
        self.ahead = np.concatenate([[0], zeros - np.arange(len(zeros))])
        self.lows = data[at : at + n * low].reshape(n, low)
        self.end = at + n * low

    def _low(self, k: np.ndarray) -> np.ndarray:
        out = np.zeros((len(k), 8), np.uint8)
        out[:, : self.low] = self.lows[k]
        return out.view("<u8").ravel()

    def __getitem__(self, k: np.ndarray) -> np.ndarray:
        high = np.searchsorted(self.ahead, k, side="right") - 1
        return (high.astype(_U) << _U(8 * self.low)) | self._low(k)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """For each of ``x`` the place of the first element not below it (``n`` if there is none)."""
        high = np.minimum(x >> _U(8 * self.low), _U(len(self.ahead))).astype(np.int64)
        last = len(self.ahead) - 1
        a = np.where(high > last, self.n, self.ahead[np.minimum(high, last)])
        b = np.where(high >= last, self.n, self.ahead[np.minimum(high + 1, last)])
        want = x & _U((1 << (8 * self.low)) - 1)
        while True:
            open_ = a < b
            if not open_.any():
                return a
            middle = (a + b) // 2
            less = np.zeros(len(x), bool)
            less[open_] = self._low(middle[open_]) < want[open_]
            a, b = np.where(open_ & less, middle + 1, a), np.where(open_ & ~less, middle, b)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each of ``x``, or -1."""
        if not self.n or not len(x):
            return np.full(len(x), -1)
        k = self.successor(x)
        hit = k < self.n
        hit[hit] = self[k[hit]] == x[hit]
        return np.where(hit, k, -1)


class Trie:
    """A shard: words with counts, and under each word its contexts with quantised log probabilities."""

    @staticmethod
    def coded(words: np.ndarray, counts: np.ndarray, pointers: np.ndarray, contexts: np.ndarray, logs: np.ndarray) -> bytes:
        """``contexts`` are ordered under their words; ``pointers`` has one more entry than ``words``."""
        rank = np.repeat(np.arange(len(words)), np.diff(pointers)).astype(_U)
        distinct, place = np.unique(contexts, return_inverse=True)
        pairs = (rank << _U(32)) | place.astype(_U)
        parts = [EliasFano.coded(x) for x in (words, distinct, pointers.astype(_U), pairs)]
        quanta = np.clip(np.round(-logs * QUANTA), 0, 65535).astype("<u2")
        data = [p + bytes(-len(p) % 8) for p in (*parts, counts.astype("<u8").tobytes(), quanta.tobytes())]
        return np.array([len(d) for d in data], "<u8").tobytes() + b"".join(data)

    def __init__(self, data: np.ndarray):
        sizes = data[:48].view("<u8").astype(np.int64)
        at = 48 + np.cumsum(sizes) - sizes
        self.words, self.contexts, self.pointers, self.pairs = (EliasFano(data, int(a)) for a in at[:4])
        self.counts = data[at[4] : at[4] + 8 * self.words.n].view("<u8")
        self.quanta = data[at[5] : at[5] + 2 * self.pairs.n].view("<u2")

    @staticmethod
    def mapped(data: bytes) -> Trie:
        """The shard in a memory-mapped file that is gone as soon as the mapping is."""
        handle, path = tempfile.mkstemp()
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(data)
            return Trie(np.memmap(path, np.uint8, "r"))
        finally:
            os.unlink(path)

    def count(self, words: np.ndarray) -> np.ndarray:
        k = self.words.find(words)
        return np.where(k >= 0, self.counts[np.maximum(k, 0)] if self.words.n else 0, 0).astype(np.int64)

    def log(self, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """log10 P(word | context) where the pair was seen, else nan."""
        out = np.full(len(words), np.nan)
        k, c = self.words.find(words), self.contexts.find(contexts)
        known = np.flatnonzero((k >= 0) & (c >= 0))
        place = self.pairs.find((k[known].astype(_U) << _U(32)) | c[known].astype(_U))
        seen = place >= 0
        out[known[seen]] = self.quanta[place[seen]] / -float(QUANTA)
        return out


class Common:
    """The most frequent tokens and the totals of the corpus: what every task knows."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n: int, v: int, documents: int, distinct: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.n, self.v = n, v
        mean, kinds = n / max(documents, 1), distinct / max(documents, 1)
        grow = np.log(max(v, 1) / max(kinds, 1)) / np.log(n / mean) if documents > 1 and mean > 0 else 0.6
        self.power = float(np.clip(grow, 0.05, 0.95))
        self.times = v / max(n, 1) ** self.power if n else 1.0
        #: Count as a context, by code; the start has one for each document.
        self.context = np.zeros(65_536)
        self.context[: len(hashes)] = self.counts
        self.context[START] = documents
        #: Context as a hash, by code.
        self.marks = np.zeros(65_536, _U)
        self.marks[: len(hashes)] = self.hashes
        self.marks[START] = BEGIN

    def code(self, hashes: np.ndarray) -> np.ndarray:
        """Place among the common tokens, or NONE."""
        if not len(self.hashes):
            return np.full(len(hashes), NONE)
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[k] == hashes, k, NONE)

    def alone(self, counts: np.ndarray) -> np.ndarray:
        """P1 of tokens with these counts."""
        return (counts + 1) / (self.n + self.v + 1)

    def after(self, counts: np.ndarray, pairs: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """P of tokens with these counts, seen ``pairs`` times after the contexts of these codes."""
        return self.given(counts, pairs, self.context[contexts])

    def given(self, counts: np.ndarray, pairs: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The same after contexts counted ``c`` times; after one never seen it is P1."""
        m = np.maximum(self.times * np.asarray(c, float) ** self.power, 1e-9)
        return (pairs + m * self.alone(counts)) / (c + m)


def _token_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Range of rows, hashes of their tokens with ends, tokens ahead of each text."""
    raw, offsets = bytesets.text_bytes(texts)
    for i, j in bytesets.slices(offsets):
        part = offsets[i : j + 1]
        words, before = bytesets.word_hashes(raw[part[0] : part[-1]], part - part[0])
        ahead = before + np.arange(j - i + 1)
        tokens = np.full(len(words) + j - i, END)
        inside = np.ones(len(tokens), bool)
        inside[ahead[1:] - 1] = False
        tokens[inside] = words
        yield i, j, tokens, ahead


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> _U(40)) * _U(buckets)) >> _U(24)).astype(np.int64)


def vocabulary(docs: DataFrame, held: str, buckets: int) -> DataFrame:
    """(hash, n) of every training token; hash null: documents, and their distinct tokens added up, as n and kinds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            hashes, kinds = [], 0
            for i, j, tokens, ahead in _token_slices(batch.column(0)):
                own = np.repeat(train[i:j], np.diff(ahead))
                at = np.concatenate([[0], np.cumsum(np.diff(ahead) * train[i:j])])
                tokens = tokens[own]
                kinds += int(bytesets.shingle_sets(tokens, at, 1)[1][-1])
                hashes.append(tokens)
            if not train.any():
                continue
            found, n = np.unique(np.concatenate(hashes), return_counts=True)
            bucket = _bucket(found, buckets)
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            data = [write([(np.diff(found[a:b], prepend=_U(0)), 8), (n[a:b].astype(_U), 5)]) for a, b in zip(at, np.append(at[1:], len(found)))]
            yield pa.RecordBatch.from_arrays([pa.array([*bucket[at].tolist(), -1], pa.int64()), pa.array([*data, write([(np.array([train.sum(), kinds], np.int64).view(_U), 8)])], pa.binary())], ["bucket", "payload"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_, now = [], None

        def done() -> pa.RecordBatch:
            if now == -1:
                docs_, kinds = np.sum([read(p, [8])[0][0].view(np.int64) for p in held_], axis=0)
                return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([docs_], pa.int64()), pa.array([kinds], pa.int64())], ["hash", "n", "kinds"])
            parts = [read(p, [8, 5])[0] for p in held_]
            hashes = np.concatenate([np.cumsum(p[0], dtype=_U) for p in parts])
            found, which = np.unique(hashes, return_inverse=True)
            n = np.bincount(which, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n), pa.nulls(len(n), pa.int64())], ["hash", "n", "kinds"])

        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != now and held_:
                    yield done()
                    held_ = []
                now = bucket
                held_.append(payload)
        if held_:
            yield done()

    counted = docs.select("text", held).mapInArrow(count, "bucket long, payload binary")
    return counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "hash long, n long, kinds long")


def common_tokens(counts: DataFrame) -> Common:
    """The ``COMMON`` most frequent tokens (a fixed number of rows) and the totals."""
    words = counts.where("hash is not null")
    total = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    docs = counts.where("hash is null").agg(F.sum("n").alias("n"), F.sum("kinds").alias("k")).first()
    top = words.orderBy(F.desc("n"), "hash").limit(COMMON).select("hash", "n").toArrow()
    hashes = top.column(0).to_numpy().view(_U)
    return Common(hashes, top.column(1).to_numpy().astype(np.int64), total["n"] or 0, total["v"], docs["n"] or 0, docs["k"] or 0)


def _sums(keys: np.ndarray, rows: np.ndarray, tokens: np.ndarray, known: np.ndarray, base: np.ndarray, score: np.ndarray, groups: int) -> pa.RecordBatch:
    """Sums per document as rows (bucket, shard, payload), by group of documents; ``bucket`` -1 marks them as such."""
    found, which = np.unique(keys, return_inverse=True)
    add = lambda x: np.bincount(which, weights=x, minlength=len(found))
    whole = [add(x).astype(np.int64).view(_U) for x in (rows, tokens, known)]
    exact, near = add(base).view(_U), add(score).astype(np.float32).view(np.uint32).astype(_U)
    shard = group_of(found, groups)
    order = np.lexsort((found, shard))
    found, shard, exact, near = found[order], shard[order], exact[order], near[order]
    whole = [w[order] for w in whole]
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    data = [
        write([(steps(found[a:b]), 8), *((w[a:b], 8) for w in whole), (exact[a:b], 8), (near[a:b], 4)]) for a, b in zip(cuts, np.append(cuts[1:], len(found)))
    ]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), -1)), pa.array(shard[cuts]), pa.array(data, pa.binary())], ["bucket", "shard", "payload"])


#: Kinds of tokens; ``COUNTED`` are rare words after a rare context, with its count.
RARE, PAIR, AFTER_RARE, COUNTED = range(4)


def _references(docs: DataFrame, held: str, shared, buckets: int, groups: int) -> DataFrame:  # noqa: ANN001
    """Tokens by bucket of the trie, and what a task knows itself as sums per document.

    ``bucket`` holds the kind of its tokens in the two low bits: ``RARE`` words after common
    contexts, ``PAIR``s of common ones, any words ``AFTER_RARE`` contexts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            out = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            order = np.argsort(key, kind="stable")
            key, out = key[order], out[order]
            for i, j, tokens, ahead in _token_slices(batch.column(1).take(pa.array(order))):
                sizes = np.diff(ahead)
                owner = np.repeat(np.arange(i, j), sizes)
                code = common.code(tokens)
                context = np.empty(len(code), np.int64)
                context[1:] = code[:-1]
                context[ahead[:-1]] = START
                often = code != NONE
                n = np.where(often, common.counts[np.where(often, code, 0)] if len(common.counts) else 0, 0)
                base = np.where(often, np.log10(common.alone(n)), 0)
                within = lambda x, a=ahead: np.diff(np.concatenate([[0], np.cumsum(x)])[a])
                ones = np.ones(j - i)
                yield _sums(key[i:j], ones, sizes, within(often.astype(float)), within(base), np.zeros(j - i), groups)
                before = np.empty_like(tokens)
                before[1:] = tokens[:-1]
                before[ahead[:-1]] = BEGIN
                after_rare = context == NONE
                spread = np.where(often, bytesets.mix(tokens ^ (context.astype(_U) << _U(20))), tokens)
                bucket = _bucket(np.where(after_rare, before, spread), buckets)
                kind = bucket * 4 + np.where(after_rare, AFTER_RARE, np.where(often, PAIR, RARE))
                send = np.argsort(kind, kind="stable")
                kind = kind[send]
                cuts = np.flatnonzero(np.diff(kind, prepend=-1))
                data = []
                for a, b in zip(cuts, np.append(cuts[1:], len(kind))):
                    s = send[a:b]
                    word = (code[s].astype(_U), 2) if kind[a] & 3 == PAIR else (tokens[s], 8)
                    past = (before[s], 8) if kind[a] & 3 == AFTER_RARE else (context[s].astype(_U), 2)
                    flag = out[owner[s]].astype(_U)
                    data.append(write([word, past, (steps(key[owner[s]]), 8), (flag, 1)]))
                yield pa.RecordBatch.from_arrays([pa.array(kind[cuts].astype(np.int64)), pa.array(np.zeros(len(cuts), np.int64)), pa.array(data, pa.binary())], ["bucket", "shard", "payload"])

    return docs.select("key", "text", held).mapInArrow(run, "bucket long, shard long, payload binary")


def _built(words: np.ndarray, contexts: np.ndarray, counts: np.ndarray | None, seen: np.ndarray, common: Common) -> bytes:
    """A shard from training tokens; ``counts``: of the words, where they aren't all here; ``seen``: of the contexts."""
    order = np.lexsort((contexts, words))
    words, contexts = words[order], contexts[order]
    new_word = np.ones(len(words), bool)
    new_word[1:] = words[1:] != words[:-1]
    at = np.flatnonzero(new_word)
    n_word = np.diff(np.append(at, len(words))) if counts is None else counts[order][at]
    new_pair = new_word.copy()
    new_pair[1:] |= contexts[1:] != contexts[:-1]
    pair = np.flatnonzero(new_pair)
    n_pair = np.diff(np.append(pair, len(words)))
    rank = np.cumsum(new_word)[pair] - 1
    pointers = np.searchsorted(rank, np.arange(len(at) + 1))
    logs = np.log10(common.given(n_word[rank], n_pair, seen[order][pair]))
    return Trie.coded(words[at], n_word, pointers, contexts[pair], logs)


def _scores(word, context, n, seen, train, common: Common) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Counts and log10 P of a bucket's tokens under the shard that its training tokens make; ``n`` None: counted here."""
    trie = Trie.mapped(_built(word[train], context[train], None if n is None else n[train], seen[train], common))
    if n is None:
        n = trie.count(word)
    log = trie.log(word, context)
    return n, np.where(np.isnan(log), np.log10(common.given(n, np.zeros(len(n)), seen)), log)


def _joined(payloads: list[bytes], widths: list[int]) -> list[np.ndarray]:
    """The columns of blocks; the last but one holds keys."""
    parts = [read(p, widths)[0] for p in payloads]
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, _U) for k in range(len(widths))]
    columns[-2] = np.concatenate([keys_of(p[-2]) for p in parts]) if parts else np.zeros(0, np.int64)
    return columns


class _Answers:
    """What a task has found out, gathered over its buckets: fewer and larger blocks than one a bucket."""

    def __init__(self, common: Common, buckets: int, groups: int):
        self.common, self.buckets, self.groups = common, buckets, groups
        self.sums: list[tuple[np.ndarray, np.ndarray]] = []
        self.sent: list[list[np.ndarray]] = []

    def _add(self, key: np.ndarray, score: np.ndarray) -> None:
        found, which = np.unique(key, return_inverse=True)
        self.sums.append((found, np.bincount(which, weights=score, minlength=len(found))))

    def pairs(self, payloads: list[bytes]) -> None:
        common = self.common
        word, context, key, held = _joined(payloads, [2, 2, 8, 1])
        word, context = word.astype(np.int64), context.astype(np.int64)
        self._add(key, _scores(common.hashes[word], common.marks[context], common.counts[word], common.context[context], held == 0, common)[1])

    def contexts(self, payloads: list[bytes]) -> None:
        """Scores of the common words after rare contexts; the other words go on, with their context's count."""
        word, context, key, held = _joined(payloads, [8, 8, 8, 1])
        which = np.unique(context, return_inverse=True)[1]
        # Each token but an end is followed by one: what follows a context counts it.
        seen = np.bincount(which, weights=held == 0)[which]
        code = self.common.code(word)
        s = np.flatnonzero(code != NONE)
        if len(s):
            self._add(key[s], _scores(word[s], context[s], self.common.counts[code[s]], seen[s], held[s] == 0, self.common)[1])
        s = np.flatnonzero(code == NONE)
        if len(s):
            self.sent.append([word[s], context[s], seen[s].astype(_U), key[s], held[s]])

    def size(self) -> int:
        return sum(len(x[0]) for x in (*self.sums, *self.sent))

    def blocks(self) -> Iterator[pa.RecordBatch]:
        if self.sums:
            key, score = (np.concatenate(x) for x in zip(*self.sums))
            zero = np.zeros(len(key))
            yield _sums(key, zero, zero, zero, zero, score, self.groups)
        if self.sent:
            word, context, seen, key, held = (np.concatenate(x) for x in zip(*self.sent))
            bucket = _bucket(word, self.buckets)
            order = np.lexsort((key, bucket))
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            data = [write([(word[k], 8), (context[k], 8), (seen[k], 5), (steps(key[k]), 8), (held[k], 1)]) for k in np.split(order, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts] * 4 + COUNTED), pa.array(np.zeros(len(cuts), np.int64)), pa.array(data, pa.binary())], ["bucket", "shard", "payload"])
        self.sums, self.sent = [], []


def _words_answered(payloads: list[tuple[int, bytes]], common: Common, groups: int) -> pa.RecordBatch:
    word, code, key, held = _joined([p for k, p in payloads if k == RARE], [8, 2, 8, 1])
    code = code.astype(np.int64)
    more, rare, counted, key_, held_ = _joined([p for k, p in payloads if k == COUNTED], [8, 8, 5, 8, 1])
    word, key, held = np.concatenate([word, more]), np.concatenate([key, key_]), np.concatenate([held, held_])
    context, seen = np.concatenate([common.marks[code], rare]), np.concatenate([common.context[code], counted.astype(float)])
    n, score = _scores(word, context, None, seen, held == 0, common)
    zero = np.zeros(len(key))
    return _sums(key, zero, zero, (n > 0).astype(float), np.log10(common.alone(n)), score, groups)


def scored(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    ``held_out``: function of the id column's name to a boolean column; the other documents train.
    """
    spark = docs.sparkSession
    rows = keyed(docs, doc_id, text).withColumn("held", held_out("id"))
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = group_count(spark)
    counts = stored(vocabulary(rows, "held", buckets), "vocabulary")
    common = common_tokens(counts)
    shared = spark.sparkContext.broadcast(common)  # at most COMMON rows and a few totals

    def passed(bucket: int, shard: int, payload: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([shard], pa.int64()), pa.array([payload], pa.binary())], ["bucket", "shard", "payload"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_, now, found = [], None, _Answers(shared.value, buckets, groups)

        def done() -> None:
            (found.pairs if now & 3 == PAIR else found.contexts)(held_)

        for batch in batches:
            for bucket, shard, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket == -1 or bucket & 3 == RARE:
                    yield passed(bucket, shard, payload)
                    continue
                if bucket != now and held_:
                    done()
                    held_ = []
                    if found.size() > GATHERED:
                        yield from found.blocks()
                now = bucket
                held_.append(payload)
        if held_:
            done()
        yield from found.blocks()

    def answer_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_, now = [], None
        for batch in batches:
            for bucket, shard, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket == -1:
                    yield passed(bucket, shard, payload).select(["shard", "payload"])
                    continue
                if bucket >> 2 != now and held_:
                    yield _words_answered(held_, shared.value, groups).select(["shard", "payload"])
                    held_ = []
                now = bucket >> 2
                held_.append((bucket & 3, payload))
        if held_:
            yield _words_answered(held_, shared.value, groups).select(["shard", "payload"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_, now = [], None

        def done() -> pa.RecordBatch:
            parts = [read(p, [8, 8, 8, 8, 8, 4])[0] for p in held_]
            key = np.concatenate([keys_of(p[0]) for p in parts])
            found, which = np.unique(key, return_inverse=True)
            whole = [np.bincount(which, weights=np.concatenate([p[k].view(np.int64) for p in parts])) for k in (1, 2, 3)]
            exact = np.bincount(which, weights=np.concatenate([p[4].view(np.float64) for p in parts]))
            near = np.bincount(which, weights=np.concatenate([p[5].astype(np.uint32).view(np.float32) for p in parts]))
            copies = np.maximum(whole[0], 1)
            columns = [found, (whole[1] / copies).astype(np.int64), (whole[2] / copies).round().astype(np.int64), exact / copies, near / copies]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_key", "n_tokens", "n_known", "base_score", "score"])

        for batch in batches:
            for shard, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != now and held_:
                    yield done()
                    held_ = []
                now = shard
                held_.append(payload)
        if held_:
            yield done()

    sent = _references(rows, "held", shared, buckets, groups)
    # Sums pass to any task; tokens of a bucket meet in one.
    place = F.when(F.col("bucket") < 0, F.col("shard") * 2 + (1 << 40))
    known = sent.repartition(place.otherwise(F.col("bucket"))).sortWithinPartitions("bucket")
    known = known.mapInArrow(answer, "bucket long, shard long, payload binary")
    back = known.repartition(place.otherwise(F.shiftright("bucket", 2))).sortWithinPartitions("bucket")
    back = back.mapInArrow(answer_words, "shard long, payload binary")
    sums = back.repartition("shard").sortWithinPartitions("shard")
    sums = sums.mapInArrow(total, "_key long, n_tokens long, n_known long, base_score double, score double")
    return (
        rows.select("key", F.col("id").alias("doc_id"), F.col("held").alias("held_out"))
        .join(sums, F.col("key") == F.col("_key"))
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(common.n).cast("long").alias("train_tokens"), "base_score", "score")
    )


def held_out(column: str):
    return remainder(column, 7) == 2
