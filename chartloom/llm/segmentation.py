"""N-best segmentation of texts into the pieces of a SentencePiece vocabulary, and decoding.

The lattice of a text has an arc for every piece that matches somewhere. A forward Viterbi pass
gives each place the score of the best way to it; these scores are the exact cost still to come for
an A-star search that starts at the end and walks back, so its first arrivals at the start are the N
best segmentations in order, and no other path is completed.

No piece holds a space behind another character, so a text is cut before each space and its N best
segmentations are those of its words put together: the best is the best of each word, the others
differ from it in the words where that costs least. The forward pass tells how much that is for
every word (words are remembered); the search runs for the N - 1 words where it is least.

The vocabulary ranks its pieces (a piece's score is its negative rank); Zipf's law makes ranks into
log probabilities. Characters without a piece are spelt in byte pieces.

Cases: null counts as the empty text, which has one segmentation, of no piece; a segmentation list is
shorter than N where there are no more; ties are in the order of the search; long texts and long
words are one search, linear in their length; rows that repeat an id get a row each; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEST = 4
#: Words a worker remembers, some 300 bytes each.
REMEMBERED = 600_000
#: Searched words a worker remembers.
SEARCHED = 100_000
#: Words that go through the forward pass together, and the longest of them.
TOGETHER, LONGEST = 8192, 64
#: Characters of texts whose new words are looked up together.
CHARACTERS = 1 << 20


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a model: numbers, log probabilities, byte pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = {i: model.get_score(i) for i in plain}
        # Pieces that no merge makes have a forbidding score; they are left out.
        plain = [i for i in plain if scores[i] > -1e8]
        total = math.log(sum(1 / (1 - scores[i]) for i in plain))
        self.number = {model.id_to_piece(i).replace("▁", " "): (i, -math.log(1 - scores[i]) - total) for i in plain}
        self.text = {i: p for p, (i, _) in self.number.items()}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        #: The bytes of each piece; empty for numbers that are none.
        self.bytes = [self.text.get(i, "").encode() for i in range(size)] + [b""]
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        #: Beginnings of pieces, with the piece they are or None: where a text leaves them, no longer piece matches.
        self.begin = {p[:k]: self.number.get(p[:k]) for p in self.number for k in range(1, len(p) + 1)}
        #: Of one byte, below any piece.
        self.spelt = min(s for _, s in self.number.values()) - 10
        self._trie()

    def _trie(self) -> None:
        """The beginnings of pieces as arrays: where (beginning, letter) leads, and the piece a beginning is."""
        letters = sorted({c for p in self.number for c in p})
        self.letter = np.full(0x110000, -1, np.int64)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        self.letters = len(letters)
        at = {p: k + 1 for k, p in enumerate(self.begin)}
        at[""] = 0
        steps = sorted((at[p[:-1]] * self.letters + int(self.letter[ord(p[-1])]), at[p]) for p in self.begin)
        # One key above all, so that a search never ends outside.
        self.step = np.array([k for k, _ in steps] + [np.iinfo(np.int64).max])
        self.leads = np.array([n for _, n in steps] + [0])
        found = [self.begin.get(p) or (-1, -math.inf) for p in at if p]
        self.made = np.array([-1] + [i for i, _ in found])
        self.score = np.array([-math.inf] + [x for _, x in found])
        #: Code points that are pieces; others are spelt.
        self.whole = np.zeros(0x110000, bool)
        self.whole[[ord(c) for c in letters if c in self.number]] = True

    def arcs(self, word: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each end in ``word`` the arcs that reach it: start, pieces, score."""
        out: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(len(word) + 1)]
        begin, number, size = self.begin, self.number, len(word)
        for a in range(size):
            if word[a] not in number:
                spelt = self._spelt(word[a])
                out[a + 1].append((a, spelt, self.spelt * len(spelt)))
            b = a + 1
            while b <= size and (part := word[a:b]) in begin:
                if found := begin[part]:
                    out[b].append((a, (found[0],), found[1]))
                b += 1
        return out

    def _spelt(self, character: str) -> tuple[int, ...]:
        return tuple(self.byte[x] for x in character.encode("utf-8", "surrogatepass"))

    def best(self, word: str) -> tuple[list[int], float, float]:
        """Pieces and score of the best segmentation, and its lead over the next: one forward pass.

        Each place hands its two best scores on along its arcs; no list of arcs is made.
        """
        size, begin, number, low = len(word), self.begin, self.number, -math.inf
        first, second, start, piece = [low] * (size + 1), [low] * (size + 1), [0] * (size + 1), [0] * (size + 1)
        first[0] = 0.0
        for a in range(size):
            one, two, b = first[a], second[a], a + 1
            if word[a] not in number:
                # The first arc that reaches a place from its left neighbour: no other starts here and ends there.
                s = self.spelt * len(word[a].encode("utf-8", "surrogatepass"))
                if (v := one + s) > first[b]:
                    first[b], second[b], start[b], piece[b] = v, first[b], a, None
                elif v > second[b]:
                    second[b] = v
                if (v := two + s) > second[b]:
                    second[b] = v
            while b <= size and (part := word[a:b]) in begin:
                if found := begin[part]:
                    i, s = found
                    if (v := one + s) > first[b]:
                        first[b], second[b], start[b], piece[b] = v, first[b], a, i
                    elif v > second[b]:
                        second[b] = v
                    if (v := two + s) > second[b]:
                        second[b] = v
                b += 1
        at, pieces = size, []
        while at:
            a, i = start[at], piece[at]
            if i is None:
                pieces.extend(reversed(self._spelt(word[a])))
            else:
                pieces.append(i)
            at = a
        pieces.reverse()
        return pieces, first[-1], first[-1] - second[-1]

    def best_of(self, words: list[str]) -> Iterator[tuple[str, tuple[bytes, float, float]]]:
        """What ``best`` gives for each word: the same sums in the same order, for many words at a time."""
        easy = []
        for w in words:
            if 0 < len(w) <= LONGEST:
                easy.append(w)
            else:
                pieces, score, lead = self.best(w)
                yield w, (np.array(pieces, "<u4").tobytes(), score, lead)
        easy.sort(key=len, reverse=True)
        for k in range(0, len(easy), TOGETHER):
            part = easy[k : k + TOGETHER]
            yield from zip(part, self._forward(part))

    def _forward(self, words: list[str]) -> Iterator[tuple[bytes, float, float]]:
        """Of words in the order of their length, longest first."""
        n, sizes = len(words), np.array([len(w) for w in words])
        longest = int(sizes[0])
        codes = np.zeros((n, longest), np.int64)
        codes[np.arange(longest) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.ascontiguousarray(codes.T)
        letter = self.letter[codes]
        upto = np.searchsorted(-sizes, -np.arange(longest + 1), side="right")  # words of at least that length
        first, second = np.full((longest + 1, n), -math.inf), np.full((longest + 1, n), -math.inf)
        start, piece = np.zeros((longest + 1, n), np.int32), np.full((longest + 1, n), -1, np.int32)
        first[0] = 0.0

        def reach(r: np.ndarray, a: int, b: int, s: np.ndarray, i: np.ndarray) -> None:
            v, before = first[a, r] + s, first[b, r]
            better = v > before
            next_to = np.where(better, before, np.maximum(second[b, r], v))
            second[b, r] = np.maximum(next_to, second[a, r] + s)
            first[b, r] = np.where(better, v, before)
            r = r[better]
            start[b, r], piece[b, r] = a, i[better]

        for a in range(longest):
            rows = np.arange(upto[a + 1])
            r = rows[~self.whole[codes[a][rows]]]
            if len(r):
                c = codes[a][r]
                reach(r, a, a + 1, self.spelt * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)), -2 - c)
            node = np.zeros(len(rows), np.int64)
            for b in range(a + 1, longest + 1):
                live = np.searchsorted(rows, upto[b])
                rows = rows[:live]
                key = node[:live] * self.letters + letter[b - 1][rows]
                at = np.searchsorted(self.step, key)
                on = (self.step[at] == key) & (letter[b - 1][rows] >= 0)
                rows, node = rows[on], self.leads[at[on]]
                if not len(rows):
                    break
                made = self.made[node]
                hit = made >= 0
                reach(rows[hit], a, b, self.score[node[hit]], made[hit])
        every, at, back = np.arange(n), sizes, []
        while at.any():
            back.append(piece[at, every])  # -1 at the start of a word, below it a spelt code point
            at = start[at, every]
        back = np.array(back[::-1]).T
        kept, spelt = back != -1, (back < -1).any(axis=1)
        ends = np.cumsum(kept.sum(axis=1))
        flat, score = back[kept].astype("<i4"), first[sizes, every]
        data, lead, begin = flat.tobytes(), score - second[sizes, every], 0
        for end, odd, x, y in zip(ends.tolist(), spelt.tolist(), score.tolist(), lead.tolist()):
            if odd:
                each = [(i,) if i >= 0 else self._spelt(chr(-2 - i)) for i in flat[begin:end].tolist()]
                yield np.array([i for p in each for i in p], "<u4").tobytes(), x, y
            else:
                yield data[4 * begin : 4 * end], x, y
            begin = end

    def n_best(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of ``word``: score and pieces."""
        arcs = self.arcs(word)
        ahead = [0.0] * (len(word) + 1)
        for b in range(1, len(word) + 1):
            ahead[b] = max(ahead[a] + s for a, _, s in arcs[b])
        # Entries: negative total, place, number, score so far, pieces of the way to the end as a chain.
        # Of equal totals the one nearest to the start goes on: ties are walked through one by one.
        heap: list[tuple[float, int, int, float, tuple]] = [(-ahead[-1], len(word), 0, 0.0, ())]
        done, made = [], 0
        while heap and len(done) < n:
            total, at, _, so_far, way = heapq.heappop(heap)
            if at == 0:
                pieces = []
                while way:
                    pieces.extend(way[0])
                    way = way[1]
                done.append((-total, tuple(pieces)))
                continue
            for a, pieces, s in arcs[at]:
                made += 1
                # Rounded, so that sums of one path in another order stay ties.
                heapq.heappush(heap, (-round(ahead[a] + s + so_far, 9), a, made, s + so_far, (pieces, way)))
        return done

    def decode(self, numbers: list[int]) -> str:
        size = len(self.bytes) - 1
        return self.decoded([i if 0 <= i < size else -1 for i in numbers])

    def decoded(self, numbers: list[int]) -> str:
        """The text of numbers that are pieces; of -1 the empty text."""
        return self.spelling(numbers).decode("utf-8", "replace").removeprefix(" ")

    def spelling(self, numbers: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, numbers))


def words_of(text: str) -> list[str]:
    """A text, with the space that a vocabulary expects in front, cut before each space."""
    return [" " + w for w in text.split(" ")] if text else []


class Segmenter:
    """Segmentations of texts, with the best one of words and its lead over the next remembered.

    A worker keeps one segmenter for all its tasks; it remembers the first words it meets, which
    hold the frequent ones.
    """

    _own: dict[tuple[str, int], Segmenter] = {}

    @classmethod
    def of(cls, path: str, n: int) -> Segmenter:
        if (path, n) not in cls._own:
            cls._own[path, n] = cls(path, n)
        return cls._own[path, n]

    def __init__(self, path: str, n: int):
        self.pieces, self.n = Pieces(path), n
        self.known: dict[str, tuple[bytes, float, float]] = {}
        self.searched: dict[str, list[tuple[float, tuple[int, ...]]]] = {}

    def learn(self, texts: list[list[str]]) -> list[list[tuple[bytes, float, float]]]:
        """Pieces, score and lead of the best segmentation of every word of some texts; new ones are looked up together."""
        known, found = self.known, [list(map(self.known.get, words)) for words in texts]
        gaps = [k for k, row in enumerate(found) if None in row]
        new = dict(self.pieces.best_of(list({w for k in gaps for w, x in zip(texts[k], found[k]) if x is None})))
        for k in gaps:
            found[k] = [new[w] if x is None else x for w, x in zip(texts[k], found[k])]
        known.update(itertools.islice(new.items(), max(0, REMEMBERED - len(known))))
        return found

    def _n_best(self, word: str) -> list[tuple[float, tuple[int, ...]]]:
        found = self.searched.get(word)
        if found is None:
            found = self.pieces.n_best(word, self.n)
            if len(self.searched) < SEARCHED:
                self.searched[word] = found
        return found

    def segment(self, text: str) -> tuple[bytes, list[float], list[list[int]]]:
        """Pieces of the best segmentation, the scores of the N best, and where they differ from the best.

        A difference is a list of (word, choice) flattened; it says the rest of the segmentation.
        """
        words = words_of(text)
        data, scores, differ, _ = self._segment(words, self.learn([words])[0])
        return b"".join(data), scores, differ

    def each(self, text: str, words: list[str], found: list[tuple[bytes, float, float]]) -> tuple[list[bytes], list[float], bool]:
        """Pieces and scores of the N best segmentations of a text, given its words and theirs, and whether all give it again."""
        data, scores, differ, choices = self._segment(words, found)
        out = [b"".join(data)]
        back = same = self.pieces.decoded(np.frombuffer(out[0], "<u4").tolist()) == text
        for d in differ[1:]:
            parts, begin, equal = [], 0, True
            for i, choice in sorted(zip(d[::2], d[1::2])):
                at = sum(map(len, data[:i]))
                parts += [out[0][begin:at], np.array(choices[i][choice], "<u4").tobytes()]
                begin = at + len(data[i])
                equal = equal and self.pieces.spelling(choices[i][choice]) == self.pieces.spelling(np.frombuffer(data[i], "<u4").tolist())
            out.append(b"".join([*parts, out[0][begin:]]))
            # Where the words that differ have the same bytes, so do the texts.
            back = back and (same if equal else self.pieces.decoded(np.frombuffer(out[-1], "<u4").tolist()) == text)
        return out, scores, back

    def _segment(self, words: list[str], known: list[tuple[bytes, float, float]]) -> tuple[list[bytes], list[float], list[list[int]], dict[int, list[tuple[int, ...]]]]:
        """What ``segment`` gives, by word, and the choices of the words that differ somewhere."""
        if not words:
            return [], [0.0], [[]], {}
        data, scores, gaps = zip(*known)
        total = math.fsum(scores)
        if len(gaps) > self.n:
            # The n - 1 cheapest words to change are enough for n - 1 further segmentations.
            leads = np.array(gaps)
            places = np.flatnonzero(leads <= np.partition(leads, self.n - 2)[self.n - 2]).tolist()
        else:
            places = list(range(len(gaps)))
        places = sorted(places, key=lambda i: (gaps[i], i))[: max(1, self.n - 1)]
        lists, choices = [], {}
        for i in places:
            found = self._n_best(words[i])
            lists.append([s - found[0][0] for s, _ in found])
            choices[i] = [p for _, p in found]
        heap, seen, out = [(0.0, (0,) * len(places))], set(), []
        while heap and len(out) < self.n:
            cost, choice = heapq.heappop(heap)
            if choice in seen:
                continue
            seen.add(choice)
            out.append((cost, choice))
            for k, options in enumerate(lists):
                if choice[k] + 1 < len(options):
                    after = (*choice[:k], choice[k] + 1, *choice[k + 1 :])
                    heapq.heappush(heap, (-math.fsum(lists[j][c] for j, c in enumerate(after)), after))
        differ = [[x for i, c in zip(places, choice) if c for x in (i, c)] for _, choice in out]
        return data, [total - cost for cost, _ in out], differ, choices

    def spelled(self, text: str, differ: list[int]) -> list[int]:
        """All piece numbers of one of a text's segmentations."""
        words = words_of(text)
        parts = [x[0] for x in self.learn([words])[0]]
        for i, choice in zip(differ[::2], differ[1::2]):
            parts[i] = np.array(self.pieces.n_best(words[i], choice + 1)[-1][1], "<u4").tobytes()
        return np.frombuffer(b"".join(parts), "<u4").tolist()


def _shares(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts (null: empty) of at most 512 rows and, but for a single text, ``CHARACTERS`` characters."""
    docs, values, size = [], [], 0
    for k in range(batch.num_rows):
        value = batch.column(1)[k].as_py() or ""
        if docs and (len(docs) == 512 or size + len(value) > CHARACTERS):
            yield docs, values
            docs, values, size = [], [], 0
        docs.append(batch.column(0)[k].as_py())
        values.append(value)
        size += len(value)
    if docs:
        yield docs, values


def _lists(rows: list[list[bytes]]) -> pa.Array:
    """Arrow lists of lists of the numbers in ``rows``."""
    each = [x for row in rows for x in row]
    inner = np.cumsum([0, *(len(x) // 4 for x in each)])
    outer = np.cumsum([0, *(len(row) for row in rows)])
    numbers = pa.array(np.frombuffer(b"".join(each), "<i4"))
    return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), pa.ListArray.from_arrays(pa.array(inner, pa.int32()), numbers))


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, n: int = BEST, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_chars, n_pieces, ids_crc32, scores, round_trip, each_pieces, each_crc32[, ids]): the N best segmentations.

    ``scores`` are their log probabilities in order, ``ids`` the pieces of each, ``each_pieces`` and
    ``each_crc32`` their counts and digests; ``n_pieces`` and ``ids_crc32`` are those of the best.
    ``round_trip`` says that decoding any of them gives the text again.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter.of(path, n)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["doc_id", "n_chars", "n_pieces", "ids_crc32", "scores", "round_trip", "each_pieces", "each_crc32", "ids"]
        for batch in batches:
            for docs, values in _shares(batch):
                texts = [words_of(value) for value in values]
                rows, ids = [], []
                for doc, value, words, found in zip(docs, values, texts, segmenter.learn(texts)):
                    each, scores, back = segmenter.each(value, words, found)
                    sums, sizes = [zlib.crc32(x) for x in each], [len(x) // 4 for x in each]
                    rows.append([doc, len(value), sizes[0], sums[0], scores, back, sizes, sums])
                    if with_ids:
                        ids.append(each)
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                if with_ids:
                    columns.append(_lists(ids))
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, n_chars long, n_pieces long, ids_crc32 long, scores array<double>, round_trip boolean, each_pieces array<long>, each_crc32 array<long>"
    return slim.mapInArrow(run, schema + (", ids array<array<int>>" if with_ids else ""))


def decoded(rows: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """``rows`` with ``out``: the text of an array of piece numbers; null stays null, unknown numbers are empty."""
    path = path or vocabulary()
    held: list[Pieces] = []

    @F.pandas_udf("string")
    def decode(column):  # noqa: ANN001, ANN202
        if not held:
            held.append(Pieces(path))
        return column.map(lambda x: None if x is None else held[0].decode([int(i) for i in x]))

    return rows.withColumn(out, decode(F.col(ids)))
