"""Language of words and documents by a linear-chain conditional random field.

A text is the sequence of its letter runs. The weight of a label for a word is the sum over the
word's features: its affixes, its character bigrams and trigrams, the word itself, and the lexicons
(per language, the words that several training documents of it hold). Learned transitions tie
neighbours, so words that several languages share follow their surroundings, and a switch of
language inside a text costs what it cost in training. Forward-backward gives every word its label
probabilities; a document's language is the one with the largest sum of them, its score that sum's
share.

Training uses a bounded sample: per language the ``SAMPLE`` documents with the least hash of their
id, and of each at most ``SEGMENTS`` runs of ``RUN`` words, chosen by hash from the whole text.
Half of the training sequences are spliced from runs of different languages: that is where the
transitions are learned. The sample is as large for any input; prediction reads every whole text.

Cases: texts that are null or have no letter are ``und`` with score 1; without a training document
every text is ``und`` with score 0; with one language every text with a letter gets it; long texts
are processed whole, padded together with others of like length; rows that repeat an id get a row
each; a null id is never learned from; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm import bytesets
from chartloom.llm.tables import remainder

SAMPLE = 200
SEGMENTS = 4
RUN = 40
LEXICON_DOCUMENTS = 3
SIZE = 1 << 15
ROUNDS = 40
PENALTY = 1e-3
#: Words whose weights a worker remembers; padded words worked on at a time.
REMEMBERED = 200_000
CELLS = 150_000
WORD = re.compile(r"[^\W\d_]+")
#: What that still holds besides letters: numbers such as ½, ² and ①.
NUMBERS = re.compile("[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()) + "]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    words = WORD.findall(text.lower()) if text else []
    if words and not "".join(words).isalpha():  # rare, and told at once
        words = [w for run in words for w in NUMBERS.split(run) if w]
    return words


def _hashed(kind: int, *letters: np.ndarray) -> np.ndarray:
    """Feature numbers of n-grams given letter by letter."""
    x = np.full(len(letters[0]), kind, np.uint64)
    for c in letters:
        x = x * np.uint64(0x100000001B3) + c
    return (bytesets.mix(x) & np.uint64(SIZE - 1)).astype(np.int64)


def features(words: list[str], lexicons: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, one word after the other, and how many each has.

    ``lexicons`` gives each listed word the set of its languages as bits. All words are hashed at once: their
    letters lie in one array, with a mark before and after each word.
    """
    n = len(words)
    letters = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    starts = np.cumsum(sizes + 2) - sizes - 1  # of the letters; a mark on each side
    ends = starts + sizes
    owner = np.repeat(np.arange(n), sizes + 2)
    flat, owners = [], []

    def add(kind: int, at: np.ndarray, of: np.ndarray, width: int) -> None:
        flat.append(_hashed(kind, *(letters[at + k] for k in range(width))))
        owners.append(of)

    for width in (2, 3):
        at = np.flatnonzero(owner[: 1 - width] == owner[width - 1 :])
        add(width, at, owner[at], width)
    for width in (1, 2, 3, 4):
        long = np.flatnonzero(sizes >= width)
        if width < 4:
            add(10 + width, starts[long], long, width)
        add(20 + width, ends[long] - width, long, width)
    whole = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, n)
    bits = np.fromiter((lexicons.get(w, 0) for w in words), np.uint64, n)
    plain = np.fromiter(map(str.isascii, words), np.uint64, n)
    for kind, values in ((30, whole), (31, bits), (32, plain)):
        flat.append(_hashed(kind, values))
        owners.append(np.arange(n))
    flat, owners = np.concatenate(flat), np.concatenate(owners)
    return flat[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=n)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray, learn: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of padded sequences (time, sequence, label) and, to ``learn`` from, the expected transitions.

    Sequences are right-padded; padding has probability 0. Values are scaled at each step.
    """
    steps, n, _ = scores.shape
    weight = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(moves)
    alpha, beta = np.empty_like(weight), np.empty_like(weight)
    alpha[0] = np.exp(start) * weight[0]
    alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a = (alpha[t - 1] @ move) * weight[t]
        alpha[t] = a / a.sum(axis=1, keepdims=True)
    beta[-1] = 1
    for t in range(steps - 2, -1, -1):
        b = (beta[t + 1] * weight[t + 1]) @ move.T
        b /= b.sum(axis=1, keepdims=True)
        beta[t] = np.where((t + 1 < lengths)[:, None], b, 1)
    inside = (np.arange(steps)[:, None] < lengths)[:, :, None]
    found = alpha * beta
    found /= found.sum(axis=2, keepdims=True)
    found = np.where(inside, found, 0)
    expected = np.zeros_like(moves)
    if steps > 1 and learn:
        pair = np.einsum("tbi,ij,tbj->tbij", alpha[:-1], move, beta[1:] * weight[1:]) if steps * n <= CELLS else None
        if pair is not None:
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            expected = (pair * inside[1:, :, :, None]).sum(axis=(0, 1))
    return found, expected


class Model:
    """Languages, feature weights, start and transition weights, lexicons."""

    def __init__(self, languages: list[str], lexicons: dict[str, int]):
        k = len(languages)
        self.languages, self.lexicons = languages, lexicons
        self.weights = np.zeros((SIZE, k), np.float32)
        self.start, self.moves = np.zeros(k), np.eye(k) * 2.0

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        flat, sizes = features(words, self.lexicons)
        return np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0)


def train(samples: list[tuple[str, list[list[str]]]]) -> Model | None:
    """A model from (language, runs of words) of the sampled documents."""
    languages = sorted({lang for lang, runs in samples if any(runs)})
    if not languages:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    seen = [Counter() for _ in languages]
    for lang, runs in samples:
        seen[number.get(lang, 0)].update({w for run in runs for w in run} if lang in number else ())
    lexicons: dict[str, int] = {}
    for i, counts in enumerate(seen):
        for w, c in counts.items():
            if c >= LEXICON_DOCUMENTS:
                lexicons[w] = lexicons.get(w, 0) | (1 << i)
    model = Model(languages, lexicons)
    pool = [(number[lang], run) for lang, runs in samples if lang in number for run in runs if run]
    if len(languages) == 1:
        return model
    rng = np.random.Generator(np.random.PCG64(1))
    sequences = []
    for k, (i, run) in enumerate(pool):
        tagged = [(w, i) for w in run]
        if k % 2:
            j, other = pool[int(rng.integers(len(pool)))]
            cut, into = int(rng.integers(len(run) + 1)), int(rng.integers(len(other) + 1))
            tagged = tagged[:cut] + [(w, j) for w in other[into:][: RUN - cut]] + tagged[cut + RUN // 2 :]
        if tagged:
            sequences.append(tagged[:RUN])
    vocabulary: dict[str, int] = {}
    n, steps, labels = len(sequences), max(map(len, sequences)), len(languages)
    words, gold = np.zeros((steps, n), np.int64), np.zeros((steps, n), np.int64)
    lengths = np.array([len(s) for s in sequences])
    for b, s in enumerate(sequences):
        for t, (w, i) in enumerate(s):
            words[t, b], gold[t, b] = vocabulary.setdefault(w, len(vocabulary)), i
    flat, sizes = features(list(vocabulary), lexicons)
    at, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(steps)[:, None] < lengths
    hot = np.eye(labels)[gold] * inside[:, :, None]
    moved = np.zeros((labels, labels))
    np.add.at(moved, (gold[:-1][inside[1:]], gold[1:][inside[1:]]), 1)
    parameters = [model.weights.astype(float), model.start, model.moves]
    momentum, energy = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, ROUNDS + 1):
        scores = np.add.reduceat(parameters[0][flat], at, axis=0)[words]
        gradient = [np.zeros_like(p) for p in parameters]
        for b in range(0, n, max(1, CELLS // steps)):
            part = slice(b, b + max(1, CELLS // steps))
            found, expected = forward_backward(scores[:, part], lengths[part], parameters[1], parameters[2])
            missing = hot[:, part] - found
            gradient[1] += missing[0].sum(axis=0)
            gradient[2] -= expected
            for i in range(labels):
                per_word = np.bincount(words[:, part].ravel(), weights=missing[:, :, i].ravel(), minlength=len(sizes))
                gradient[0][:, i] += np.bincount(flat, weights=per_word[owner], minlength=SIZE)
        gradient[2] += moved
        for k, p in enumerate(parameters):
            g = gradient[k] / n - PENALTY * p
            momentum[k] = 0.9 * momentum[k] + 0.1 * g
            energy[k] = 0.99 * energy[k] + 0.01 * g * g
            p += 0.15 * (momentum[k] / (1 - 0.9**step)) / (np.sqrt(energy[k] / (1 - 0.99**step)) + 1e-8)
    model.weights = parameters[0].astype(np.float32)
    return model


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, list[list[str]]]]:
    """The bounded training sample: at most SAMPLE * SEGMENTS runs of RUN words per language."""
    slim = docs.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    known = slim.where(remainder("_id", 3).isin(0, 2)).where("_lang is not null and _text is not null")
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    chosen = known.select("_id", "_lang").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE)
    chosen = chosen.select(F.col("_id").alias("_chosen"), F.col("_lang").alias("_cl"))
    texts = known.join(chosen, F.expr("_id = _chosen and _lang = _cl"), "left_semi")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text_ in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                words = words_of(text_)
                pieces = range(0, len(words), RUN)
                first = sorted(pieces, key=lambda k: (zlib.crc32(f"{doc} {k}".encode()), k))[:SEGMENTS]
                out.append([" ".join(words[k : k + RUN]) for k in sorted(first)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], ["id", "lang", "runs"])

    rows = texts.select(F.col("_id").cast("long"), "_lang", "_text").mapInArrow(runs, "id long, lang string, runs array<string>").collect()
    rows.sort(key=lambda r: (r["lang"], r["id"], r["runs"]))
    return [(r["lang"], [x.split(" ") for x in r["runs"] if x]) for r in rows]


class Labeller:
    """Label probabilities of texts, with the weights of words remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)), np.float32)

    def _numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.number) > REMEMBERED:
            self.number, self.scores = {}, self.scores[:0]
        known = self.number
        new = sorted(set().union(*texts).difference(known))
        if new:
            for w in new:
                known[w] = len(known)
            self.scores = np.concatenate([self.scores, self.model.word_scores(new)])
        return [np.fromiter(map(known.__getitem__, t), np.int64, len(t)) for t in texts]

    def probabilities(self, texts: list[list[str]]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, probabilities of its words) for every text with a word."""
        order = sorted((k for k, t in enumerate(texts) if t), key=lambda k: len(texts[k]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and len(texts[order[stop]]) * (stop + 1 - at) <= CELLS:
                stop += 1
            group = order[at:stop]
            numbers = self._numbers([texts[k] for k in group])
            lengths = np.array([len(x) for x in numbers])
            padded = np.zeros((lengths.max(), len(group)), np.int64)
            for b, x in enumerate(numbers):
                padded[: len(x), b] = x
            found = _posteriors(self.scores[padded], lengths, self.model.start, self.model.moves)
            for b, k in enumerate(group):
                yield k, found[: lengths[b], b]
            at = stop


def _posteriors(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    start, moves = start.astype(scores.dtype), moves.astype(scores.dtype)
    return forward_backward(scores, lengths, start, moves, learn=False)[0] if scores.shape[2] > 1 else np.ones_like(scores)


def predicted(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", by_word: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, n_switches[, words]): the language of every text.

    ``n_switches`` counts neighbouring words with different likeliest languages; ``by_word`` adds
    the words of each text with their languages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model) if model else None
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                texts = [words_of(t) for t in part.column(1).to_pylist()]
                n = len(texts)
                lang, score, switches = ["und"] * n, [1.0 if labeller else 0.0] * n, [0] * n
                tagged: list[list[dict]] = [[] for _ in texts]
                for k, p in labeller.probabilities(texts) if labeller else ():
                    share = p.mean(axis=0)
                    best, each = int(share.argmax()), p.argmax(axis=1)
                    lang[k], score[k] = model.languages[best], float(min(1.0, share[best]))
                    switches[k] = int((each[1:] != each[:-1]).sum())
                    if by_word:
                        tagged[k] = [{"word": w, "lang": model.languages[i], "p": float(q)} for w, i, q in zip(texts[k], each, p.max(axis=1))]
                columns = [part.column(0), pa.array(lang), pa.array(score, pa.float64()), pa.array(switches, pa.int64())]
                names = ["doc_id", "lang_pred", "score", "n_switches"]
                if by_word:
                    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())]))
                    columns, names = [*columns, pa.array(tagged, kind)], [*names, "words"]
                yield pa.RecordBatch.from_arrays(columns, names)

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, lang_pred string, score double, n_switches long" + (", words array<struct<word:string,lang:string,p:double>>" if by_word else "")
    return slim.mapInArrow(run, schema)


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_switches), learned from documents that aren't held out."""
    out = predicted(docs, train(sample(docs)))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "n_switches")
