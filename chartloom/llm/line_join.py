"""Line dedup by an exact set-similarity join.

A line is the set of its words. A line is removed if an earlier line (of an earlier document, or
higher up in its own) has the same set, or one whose Jaccard similarity is ``PERCENT`` / 100 or
more. Matches are judged on the input: a line that is removed itself still counts as earlier.

1. Rarity: words are counted in ``CELLS`` cells by hash over the whole table. Each set is ordered by
   its words' cells, rarest first; the counts steer the work only, the result is exact for any order.
2. Prefix filter: sets that similar share a word among the first n - ceil(t n) + 1. Those words go
   through one shuffle as 32-bit hashes, with the set's id, its size, the word's place and a 64-bit parity of the set.
3. Filters on sets that share a prefix word: size, place (what can still be common after it), and
   parity (each differing word flips one bit at most). This is a left semi join: it stops at a set's
   first partner, so a group of many variants is passed through and never spelt out as pairs.
4. The few sets with a partner left get their words again, as one string, and meet once per group of
   sets that share prefix words; a second left semi join verifies Jaccard on the words themselves
   against earlier sets.

Equal sets are one row from step 3 on, so copies of a line cost one aggregation. All built-in
expressions; sets count as equal by 96 bits over the 64-bit hashes of their words.

Cases: null text has no lines; lines without words are never removed, nor are lines with fewer than ``least`` distinct words
(``MIN_WORDS`` unless given); a null id comes after all others; rows that repeat an id with another
text are documents of their own, ordered by a hash of their text; equal rows lose nothing to each other;
very long lines are sets like any other; an empty table gives an empty result; further columns stay
as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.blocks import keyed
from chartloom.llm.tables import WORD, fresh, stored, words

PERCENT = 90
#: Least distinct words of a line that can be removed: one, so lines of any length are judged.
MIN_WORDS = 1
CELLS = 1 << 16

#: SQL: words that two sets of a and b words must share, over aliases x and y.
_NEED = "((x.n + y.n) * {p} + {q} - 1) div {q}"


def _weights(rows: DataFrame) -> Column:
    """Rarity of the ``CELLS`` cells as one constant array: the place of each when ordered by the
    words counted in it over the whole table, from -CELLS / 2. The driver sees one number per cell."""
    cells = rows.select(F.explode(words(F.col("text"))).alias("w")).select(F.xxhash64("w").bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("cell"))
    counted = {r["cell"]: r["n"] for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = {k: i for i, k in enumerate(sorted(range(CELLS), key=lambda k: (counted.get(k, 0), k)))}
    return F.split(F.lit(",".join(str(place[k] - CELLS // 2) for k in range(CELLS))), ",").cast("array<int>")


def _lines(rows: DataFrame, weights: Column) -> DataFrame:
    """(key, place, ranked): the distinct words of each line with a word, as numbers that sort by rarity: the place of
    the cell instead of its number on top of the other 48 bits of the hash, so that different hashes stay different."""
    split = rows.select("key", F.posexplode(F.split("text", "\n")).alias("place", "line")).where(F.col("line").rlike(WORD))
    cell = lambda w: F.get(weights, F.xxhash64(w).bitwiseAND(F.lit(CELLS - 1)).cast("int")).cast("long")
    rank = lambda w: F.shiftleft(cell(w), 48).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 16))
    return split.select("key", "place", F.sort_array(F.array_distinct(F.transform(words(F.col("line")), rank))).alias("ranked"))


def _sets(lines: DataFrame, percent: int, least: int) -> DataFrame:
    """(key, place, set_id, check, n, parity, prefix) of each line."""
    n = F.size("ranked")
    prefix = n - F.expr(f"(size(ranked) * {percent} + 99) div 100").cast("int") + 1
    # Where words are told apart by 32 bits, more sets meet; none that share a word are missed.
    shared = F.transform(F.slice("ranked", F.lit(1), prefix), lambda c: F.hash(c))
    # A set below this size can only match an equal one.
    alone = n * 100 < (n + 1) * percent
    return lines.select(
        "key",
        "place",
        F.xxhash64("ranked").alias("set_id"),
        F.hash("ranked").alias("check"),
        n.alias("n"),
        F.expr("aggregate(ranked, 0L, (a, c) -> a ^ shiftleft(1L, cast(c & 63 as int)))").alias("parity"),
        F.when(alone | (n < least), F.array().cast("array<int>")).otherwise(shared).alias("prefix"),
    )


def _alike(percent: int) -> str:
    """SQL: different sets x and y that may be similar by size and parity."""
    need = _NEED.format(p=percent, q=100 + percent)
    sizes = f"x.n * 100 >= y.n * {percent} and y.n * 100 >= x.n * {percent}"
    return f"x.set_id <> y.set_id and {sizes} and bit_count(x.parity ^ y.parity) <= x.n + y.n - 2 * ({need})"


def _filters(percent: int) -> str:
    need = _NEED.format(p=percent, q=100 + percent)
    return f"x.t = y.t and least(x.n - x.pos, y.n - y.pos) >= {need} and {_alike(percent)}"


def _met(sets: DataFrame, percent: int, least: int) -> DataFrame:
    """(set_id, first, times, n, parity, groups): sets that occur twice, or that pass the filters with another set.

    ``groups`` (null without a partner) name the groups of sets with a partner that share a prefix word. Words shared by
    the same sets make one group, so similar sets meet about once later on, not once for every word of their prefixes.
    """
    prefixes = sets.select("set_id", "n", "parity", F.posexplode("prefix").alias("pos", "t"))
    # Equal sets become one row. Size, place and parity are the set's own: as aggregates they keep the join above
    # the aggregation, so that both sides share one shuffle.
    once = prefixes.repartition("t").groupBy("t", "set_id").agg(F.min("pos").alias("pos"), F.max("n").alias("n"), F.max("parity").alias("parity"))
    near = once.alias("x").join(once.alias("y"), F.expr(_filters(percent)), "left_semi")
    members, mixed = Window.partitionBy("t"), F.xxhash64("set_id", F.lit(1))
    group = F.xxhash64(F.count(F.lit(1)).over(members), F.bit_xor("set_id").over(members), F.bit_xor(mixed).over(members))
    partners = near.select("set_id", "n", "parity", group.alias("group"))
    partners = partners.groupBy("set_id").agg(F.max("n").alias("n"), F.max("parity").alias("parity"), F.collect_set("group").alias("groups"))
    first = F.min(F.struct("key", "place", "check")).alias("first")
    firsts = sets.where(F.col("n") >= least).groupBy("set_id").agg(first, F.count(F.lit(1)).alias("times"))
    return firsts.join(partners.hint("merge"), "set_id", "left").where("times > 1 or groups is not null")


def _similar(rows: DataFrame, few: DataFrame, percent: int) -> DataFrame:
    """(set_id): those of ``few`` with a similar set that occurs earlier."""
    # Their words, from the documents that hold their first occurrences.
    sets = F.collect_list(F.struct("first.place", "set_id", "n", "parity", "groups")).alias("_sets")
    places = few.groupBy(F.col("first.key").alias("_key")).agg(sets).withColumn("_places", F.col("_sets.place"))
    # No broadcast: these places grow with the input.
    held = rows.join(places.hint("merge"), F.col("key") == F.col("_key"))
    told = lambda i: F.get("_sets", (F.array_position("_places", i) - 1).cast("int"))
    at = F.transform(F.split("text", "\n"), lambda x, i: F.when(F.array_contains("_places", i), F.struct(x.alias("line"), told(i).alias("set"))))
    picked = held.select("key", F.explode(F.filter(at, lambda x: x.isNotNull())).alias("l")).select("key", "l.line", "l.set.*")
    # Words hold no blank: as one string they take a fifth of an array's room in a shuffle.
    text = F.array_join(F.array_distinct(words(F.col("line"))), " ")
    listed = stored(picked.select(F.struct("key", "place").alias("first"), "set_id", "n", "parity", "groups", text.alias("words")), "near-sets")
    spread = listed.select("first", "set_id", "n", "parity", "words", F.explode("groups").alias("group"))
    need = _NEED.format(p=percent, q=100 + percent)
    common = f"size(array_intersect(split(x.words, ' '), split(y.words, ' '))) >= {need}"
    verified = f"x.group = y.group and {_alike(percent)} and y.first < x.first and {common}"
    return spread.alias("x").join(spread.alias("y").hint("merge"), F.expr(verified), "left_semi").select("set_id").distinct()


def marked(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, least: int = MIN_WORDS
) -> tuple[DataFrame, DataFrame]:
    """The keyed documents, and (key, place, copy, similar) of every line with a word.

    ``copy``: an earlier line has the same words; ``similar``: an earlier line has a similar set.
    """
    rows = keyed(docs, doc_id, text)
    weights = _weights(rows)
    sets = stored(_sets(_lines(rows, weights), percent, least), "line-sets")
    met = stored(_met(sets, percent, least), "line-sets-met")
    similar = _similar(rows, met.where("groups is not null"), percent)
    # Only sets that occur twice or have a partner say something about a line.
    known = met.select("set_id", "first", "times").join(similar.withColumn("similar", F.lit(True)), "set_id", "left").where("times > 1 or similar")
    known = known.select(F.col("set_id").alias("_set"), "first", F.coalesce("similar", F.lit(False)).alias("_similar"))
    lines = sets.select("key", "place", "set_id", "check").join(known.hint("merge"), F.col("set_id") == F.col("_set"), "left")
    # A set of the same id with another check is another set: neither a copy nor similar.
    same = F.col("check") == F.col("first.check")
    return rows, lines.select(
        "key",
        "place",
        F.coalesce(same & (F.struct("key", "place") != F.struct("first.key", "first.place")), F.lit(False)).alias("copy"),
        F.coalesce(same & F.col("_similar"), F.lit(False)).alias("similar"),
    )


def line_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_copies, n_similar, n_removed): one row per document."""
    rows, lines = marked(docs, doc_id, text, percent, least)
    # Equal rows have one key and repeat their places; one shuffle by key serves both steps.
    each = lines.repartition("key").groupBy("key", "place").agg(F.max("copy").alias("copy"), F.max("similar").alias("similar"))
    count = lambda c: F.sum(c.cast("long"))
    per = each.groupBy(F.col("key").alias("_key")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        count(F.col("copy")).alias("n_copies"),
        count(F.col("similar")).alias("n_similar"),
        count(F.col("copy") | F.col("similar")).alias("n_removed"),
    )
    out = rows.select("key", "id").join(per, F.col("key") == F.col("_key"), "left")
    return out.select(F.col("id").alias("doc_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "n_copies", "n_similar", "n_removed")])


def deduplicated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, removed: str = "lines_removed", left: str = "lines_left"
) -> DataFrame:
    """``docs`` without removed lines in ``text``; two columns more, all others stay.

    ``removed`` counts the lines taken out; ``left`` the lines with a word that remain, null where
    nothing was taken out.
    """
    rows, lines = marked(docs, doc_id, text, percent)
    bad = F.col("copy") | F.col("similar")
    # Equal rows have one key and repeat their places: sets count them once.
    per = lines.groupBy("key").agg(F.collect_set(F.when(bad, F.col("place"))).alias("places"), F.countDistinct("place").alias("n")).where("size(places) > 0")
    k, i, h, p, n, own = fresh(docs, "_key", "_id", "_hash", "_places", "_lines", "_own")
    ids = rows.select(F.col("key").alias(k), F.col("id").alias(i), F.xxhash64(F.coalesce("text", F.lit(""))).alias(h)).dropDuplicates([k])
    per = per.select(F.col("key").alias("_k"), F.col("places").alias(p), F.col("n").alias(n)).join(ids, F.col("_k") == F.col(k)).select(i, h, p, n)
    keyed_docs = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = keyed_docs.join(per, F.col(doc_id).cast("long").eqNullSafe(F.col(i)) & (F.col(own) == F.col(h)), "left")
    rest = F.filter(F.split(text, "\n"), lambda x, at: ~F.array_contains(F.col(p), at))
    clean = F.when(F.col(p).isNull(), F.col(text)).otherwise(F.array_join(rest, "\n"))
    return joined.select(
        *[clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.size(p), F.lit(0)).alias(removed),
        F.when(F.col(p).isNotNull(), F.col(n) - F.size(p)).alias(left),
    )
