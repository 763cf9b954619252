"""Spelling variants of the words of a corpus, by blocked Gram matrices of letter counts.

Two words are *near* if exactly one code point is inserted, deleted or replaced between them. Their letter counts x and y then
have a squared distance |x|^2 + |y|^2 - 2 x.y of at most 2, and their lengths differ by at most one.

* **Blocks.** Words lie in cells: their length, and how many of their letters fall into each of some groups of
  letters. The words of a cell are cut into blocks of at most ``BLOCK`` words. An edit changes at most one group by one each way, so a
  block has near words only in its own cell, in cells of its length that differ by one letter moved between two groups,
  and in cells one letter longer. Every such pair of blocks meets in an equality join, once.
* **Gram matrices.** For a pair of blocks one product of their count matrices gives all squared distances; pairs within 2
  are verified letter by letter. Products have at most ``BLOCK`` x ``WIDE`` entries, whatever the input.
* **Groups.** Letters are dealt to groups by frequency. The number of groups grows until a word's cell holds
  ``CELL`` words on average, so that the work per word stays the same as the vocabulary grows. It changes which products
  are made, not the result: a large cell only has more blocks.

Near words are counted per block, then summed per word; a word's *form* is its near word of largest n (ties: least in code-point
order) if that is at least twice its own n. ``root`` follows forms by pointer doubling; n at least doubles
at each step, so rounds grow with the logarithm of the logarithm of the largest n.

Cases: null and empty texts have no words; a null id is written as the empty text; repeated rows count again; a word
without near words has n_near 0, no form, and is its own root; an empty table gives an empty result; further columns are
ignored. Long texts and long words are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.checks import crc32
from chartloom.llm.tables import stored

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a block, words beside it in one product, code points of a block.
BLOCK, WIDE, POINTS = 1024, 8192, 1 << 20
#: Words in the cell of an average word, and the most groups of letters.
CELL, GROUPS = 384, 24


def counted(docs: DataFrame, least_length: int = 5, least_count: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case; where 97 divides the crc32 of ``<doc_id>:<run>``, one letter is lost."""
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(LETTERS), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), run.alias("raw")).where(F.length("raw") >= least_length)
    # translate is slow, and most runs have no capital
    low = F.when(F.lower("raw") == F.col("raw"), F.col("raw")).otherwise(F.translate("raw", UPPER, LOWER))
    runs = runs.select("id", low.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % 97 == 0, lost).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _cell(groups: list[str]) -> Column:
    """Length and letters in each group but the last, which is the rest."""
    inside = [F.length("word") - F.length(F.translate("word", g, "")) for g in groups[:-1]]
    return F.array(F.length("word"), *inside)


def _groups(letters: list[tuple[str, int]], k: int) -> list[str]:
    """The letters dealt to ``k`` groups, the most frequent first, each to the group with least so far."""
    weight, groups = [0] * k, [""] * k
    for letter, n in letters:
        g = weight.index(min(weight))
        weight[g] += n
        groups[g] += letter
    return groups


def _cells(words: DataFrame) -> tuple[list[str], DataFrame]:
    """Groups of letters that make cells of ``CELL`` words, and the words with their cells."""
    letter = F.explode(F.split("word", "")).alias("letter")
    # the letters of most use, at most 1024: any others count with the last group
    top = words.select(letter).groupBy("letter").agg(F.count(F.lit(1)).alias("n")).where("letter <> ''").orderBy(F.desc("n"), "letter").limit(1024)
    letters = [(r.letter, r.n) for r in top.collect()]
    k = 4
    while True:
        groups = _groups(letters, k)
        celled = words.withColumn("cell", _cell(groups))
        size = celled.groupBy("cell").agg(F.count(F.lit(1)).cast("double").alias("n")).agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("s")).first().s
        if not size or size <= CELL or k >= min(GROUPS, len(letters)):
            return groups, celled
        # a further group cuts a cell by a third or more
        k = min(k + max(1, int(np.log(size / CELL) / np.log(2.5))), GROUPS, len(letters))


def _blocks(celled: DataFrame, k: int) -> DataFrame:
    """(id, cell, targets, n, letters, counts): blocks of words of one cell, and the cells whose words they are held against."""

    def targets(cell: list[int]) -> list[list[int]]:
        length, *inside = cell
        sizes = [*inside, length - sum(inside)]
        out = [cell]
        for a in range(k):
            if sizes[a]:
                for b in range(k):
                    if b != a:
                        moved = list(sizes)
                        moved[a] -= 1
                        moved[b] += 1
                        if moved < sizes:
                            out.append([length, *moved[:-1]])
                out.append([length - 1, *(s - (j == a) for j, s in enumerate(sizes[:-1]))])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, cell, words, counts = TaskContext.get().partitionId() << 40, None, [], []

        def block() -> pa.RecordBatch:
            columns = [[number], [cell], [targets(cell)], [len(words)], ["".join(words)], [np.array(counts, "<i8").tobytes()]]
            kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.int32(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "cell", "targets", "n", "letters", "counts"])

        for batch in batches:
            for this, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if words and (this != cell or len(words) == BLOCK or len(words) * cell[0] > POINTS):
                    yield block()
                    number, words, counts = number + 1, [], []
                cell = this
                words.append(word)
                counts.append(n)
        if words:
            yield block()

    dealt = celled.select("cell", "word", "n").repartitionByRange("cell", "word").sortWithinPartitions("cell", "word")
    return dealt.mapInArrow(run, "id long, cell array<int>, targets array<array<int>>, n int, letters string, counts binary")


class Words:
    """Words of one length: code points, letter counts and frequencies."""

    def __init__(self, length: int, parts: list[tuple[str, bytes]]):
        points = np.frombuffer("".join(p[0] for p in parts).encode("utf-32-le"), "<u4")
        self.length, self.points = length, points.reshape(-1, length)
        self.n = np.concatenate([np.frombuffer(p[1], "<i8") for p in parts])
        #: Letters counted by code point modulo 256: where two letters share a column, distances only get smaller.
        at = np.repeat(np.arange(len(self.points)) << 8, length) | (points & 255)
        counts = np.bincount(at, minlength=len(self.points) << 8).reshape(-1, 256)
        self.counts = counts.astype(np.float32 if length < 2048 else np.float64)
        self.half = (self.counts * self.counts).sum(axis=1) / 2
        self.text = self.points.copy().view(f"<U{length}").ravel() if length else np.array([""] * len(self.points))

    def __len__(self) -> int:
        return len(self.points)


def close_pairs(a: Words, b: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of near words of ``a`` and ``b``; ``b`` has the length of ``a`` or one more."""
    if a is b or a.length == b.length:
        used = (a.counts.any(axis=0)) & (b.counts.any(axis=0))
    else:
        used = b.counts.any(axis=0) & a.counts.any(axis=0)
    gram = a.counts[:, used] @ b.counts[:, used].T
    # |x|^2 + |y|^2 - 2 x.y <= 2
    gram -= a.half[:, None]
    i, j = np.nonzero(gram >= (b.half - 1)[None, :])
    if a is b:
        i, j = i[i < j], j[i < j]
    found = []
    step = max(1, (1 << 22) // max(a.length, 1))
    for k in range(0, len(i), step):
        x, y = a.points[i[k : k + step]], b.points[j[k : k + step]]
        if a.length == b.length:
            found.append((x != y).sum(axis=1) == 1)
        else:
            ahead, behind = x == y[:, :-1], x == y[:, 1:]
            same = lambda m: np.where(m.all(axis=1), a.length, (~m).argmax(axis=1))
            found.append(same(ahead) + same(behind[:, ::-1]) >= a.length)
    keep = np.concatenate(found) if found else np.zeros(0, bool)
    return i[keep], j[keep]


_PARTIAL = "word string, n_near long, form_n long, form string"


def _told(own: Words, other: Words, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Per word of ``own`` with near words in ``other``: how many, and the most frequent."""
    names, place = np.unique(other.text[j], return_inverse=True)
    order = np.lexsort((place, -other.n[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    many = np.diff(np.append(first, len(i)))
    text = lambda w, k: pa.array(w.text[k].tolist(), pa.string())
    return pa.RecordBatch.from_arrays([text(own, i[first]), pa.array(many), pa.array(other.n[j[first]]), text(other, j[first])], ["word", "n_near", "form_n", "form"])


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, length, letters, counts, other length, other letters, other counts): near words of pairs of blocks.

    Rows of one block that come one after the other are one product.
    """
    now, mine, held, size = None, None, [], 0

    def multiplied() -> Iterator[pa.RecordBatch]:
        theirs = Words(now[1], held)
        i, j = close_pairs(mine, theirs)
        if len(i):
            yield _told(mine, theirs, i, j)
            yield _told(theirs, mine, j, i)

    for batch in batches:
        for a, b, length, letters, counts, far, other, other_counts in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (now != (a, far) or size > WIDE * far):
                yield from multiplied()
                held, size = [], 0
            if now is None or now[0] != a:
                mine = Words(length, [(letters, counts)])
            now = (a, far)
            if a == b:
                i, j = close_pairs(mine, mine)
                if len(i):
                    yield _told(mine, mine, np.concatenate([i, j]), np.concatenate([j, i]))
                continue
            held.append((other, other_counts))
            size += len(other)
    if held:
        yield from multiplied()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) for the words (word, n) that have near words: ``form`` is the most frequent of them."""
    groups, celled = _cells(words)
    blocks = stored(_blocks(celled, len(groups)), "blocks")
    left = blocks.select(F.col("id").alias("a"), F.col("cell").alias("target"), F.col("cell")[0].alias("length"), F.col("letters").alias("own"), F.col("counts").alias("own_n"))
    right = blocks.select(F.col("id").alias("b"), "cell", F.explode("targets").alias("target"), "letters", "counts")
    pairs = left.join(right, "target").where((F.col("target") != F.col("cell")) | (F.col("a") <= F.col("b")))
    pairs = pairs.select("a", "b", "length", "own", "own_n", F.col("cell")[0].alias("far"), "letters", "counts")
    found = pairs.mapInArrow(_products, _PARTIAL)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("form_n"), "b.form")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that forms (word, form) lead to."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("w"), F.col("root").alias("r"))
        ahead = stored(now.join(on, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "roots")
        if ahead.where("moved").limit(1).count() == 0:
            return ahead.select("word", "root")
        now = ahead.select("word", "root")


def grouped(words: DataFrame) -> DataFrame:
    """Words (word, n) with their near words counted, their form and the root of their group."""
    words = stored(words.select("word", "n"), "words")
    found = words.join(near_words(words), "word", "left")
    likely = F.col("form_n") >= 2 * F.col("n")
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(likely, F.col("form")).alias("form"), F.when(likely, F.col("form_n")).alias("form_n")), "near")
    ends = roots(found.where("form is not null").select("word", "form"))
    out = found.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Near words share what is left of them without one letter: at the same place (replaced), or one is such a rest (inserted).
SQL = rf"""
with recursive runs as (select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) as run from documents),
alike as (select id, run, count(*) as m from runs where length(run) >= 5 group by all),
hashed as (select run, m, {crc32("id || ':' || run")} as h from alike),
lost as (select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, m from hashed),
words as (select word, cast(sum(m) as bigint) as n from lost where length(word) >= 5 group by word having sum(m) >= 3),
rests as (select word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as p from words)),
pairs as (select a.word, b.word as form, b.n as m from rests a join rests b on a.rest = b.rest and a.p = b.p and a.word <> b.word
  union select a.word, b.word, b.n from rests a join words b on a.rest = b.word union select b.word, a.word, a.n from rests a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, first(form order by m desc, form) as form, max(m) as m from pairs group by word),
formed as (select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.m >= 2 * w.n then b.form end as form, case when b.m >= 2 * w.n then b.m end as form_n from words w left join best b using (word)),
chain as (select word, form as root from formed where form is not null union all select c.word, f.form from chain c join formed f on f.word = c.root where f.form is not null),
lasts as (select c.word, c.root from chain c join formed f on f.word = c.root where f.form is null)
select f.word, f.form, coalesce(l.root, f.word) as root, f.n, f.n_near, f.form_n from formed f left join lasts l using (word)
"""
