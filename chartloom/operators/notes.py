"""Words, chunks, tagging and span bookkeeping on note texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.text import inner_span, snippet, strip_space
from chartloom.operators.lists import first_per_key, sample_per_group, seeded_order
from chartloom.operators.spans import BLOCK, containment_join, either_contains_join, overlap_join
from chartloom.session import cut_lineage, cut_to_files

WORDS_PER_ROW = 32
GROUPS_PER_SUM = 64
EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def word_pieces(text) -> Column:
    """Words with the white space before them; their lengths add up to offsets."""
    return F.regexp_extract_all(text, F.lit(r"(\s*\S+)"), F.lit(1))


def _chars(pieces: Column) -> Column:
    return F.length(F.array_join(pieces, ""))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, x: a + x)


def with_words(notes: DataFrame) -> DataFrame:
    """Notes with their words (``_p``) and the characters before every 32nd word (``_off``).

    Lengths are added up by group of words, then by group of groups, so that the work stays
    close to linear for a text of any length. Arrays enter a lambda only where they are used
    twice or passed as its argument, otherwise the optimizer computes them again per element.
    """
    n, m = WORDS_PER_ROW, GROUPS_PER_SUM
    df = notes.select("*", word_pieces(F.col("text")).alias("_p"))
    last = F.floor(F.greatest(F.size("_p") - 1, F.lit(0)) / n).cast("int")
    df = df.withColumn(
        "_len", F.transform(F.sequence(F.lit(0), last), lambda g: _chars(F.slice(F.col("_p"), g * n + 1, F.lit(n))))
    )
    tops = F.sequence(F.lit(0), F.floor((F.size("_len") - 1) / m).cast("int"))
    df = df.withColumn("_top", F.transform(tops, lambda t: _sum(F.slice(F.col("_len"), t * m + 1, F.lit(m)))))
    top_off = F.transform("_top", lambda x, t: _sum(F.slice(F.col("_top"), F.lit(1), t)))

    def inside(o, t):
        lens = F.slice(F.col("_len"), t * m + 1, F.lit(m))
        size = F.least(F.lit(m), F.size("_len") - t * m)
        return F.transform(F.sequence(F.lit(0), size - 1), lambda i: o + _sum(F.slice(lens, F.lit(1), i)))

    return df.withColumn("_off", F.flatten(F.transform(top_off, inside))).drop("_len", "_top")


def word_rows(notes: DataFrame, extra: int = 0) -> DataFrame:
    """Notes cut into rows of ``WORDS_PER_ROW`` words: note_id, offset, pieces.

    ``pieces`` also holds the ``extra`` words after the row, for phrases that cross it.
    """
    n = WORDS_PER_ROW
    rows = F.transform(
        "_off", lambda o, g: F.struct(o.alias("offset"), F.slice(F.col("_p"), g * n + 1, F.lit(n + extra)).alias("pieces"))
    )
    # explode_outer: the filter derived from explode would compute the words twice
    return with_words(notes.select("note_id", "text")).select("note_id", F.explode_outer(rows).alias("r")).select(
        "note_id", "r.offset", "r.pieces"
    )


def spread(notes: DataFrame, key: str = "note_id") -> DataFrame:
    """Notes dealt by id where they lie in fewer files than there are cores.

    Pattern searches cost far more than reading: a few files are read by a few tasks. Inputs of many files are left alone,
    their texts are not shuffled.
    """
    cores = notes.sparkSession.sparkContext.defaultParallelism
    return notes if len(notes.inputFiles()) >= cores else notes.repartition(cores, key)


#: Bits of a filter per key, and of a filter at most (one megabyte, whatever the list).
BITS_PER_KEY, MOST_BITS = 16, 1 << 23


def bit_filter(keys: DataFrame, key: str):  # noqa: ANN201
    """A test ``Column -> Column`` that is true for every value of ``key``, and for few others.

    One bit per hash, in a literal of the plan: at most a megabyte. A longer list fills more of
    the bits, so that more others pass; no key is ever lost.
    """
    n = keys.select(key).distinct().count()
    bits = 1 << 10
    while bits < min(n * BITS_PER_KEY, MOST_BITS):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    data = bytearray(bits // 8)
    for r in keys.select(place(F.col(key)).alias("p")).distinct().toLocalIterator():
        data[r.p >> 3] |= 1 << (r.p & 7)
    held = F.lit(bytes(data))

    def passes(value: Column) -> Column:
        p = place(value)
        byte = F.conv(F.hex(F.substring(held, (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("getbit", byte, (p % 8).cast("int")) == 1

    return passes


def tag_terms(notes: DataFrame, terms: DataFrame, max_words: int = 3) -> DataFrame:
    """Phrases of a term list in notes: note_id, span_start, span_end, lexical_variant, term, label.

    ``terms`` is (term, label); phrases of up to ``max_words`` words are compared in lower
    case without the punctuation around them. Where the text is read, a bit filter of the first words of the terms
    picks the words at which phrases are made at all, and a second one, of whole terms, the phrases that
    meet the list in an equality join: what is moved for the join are hits. They are written first, and a term is offered to each
    share of the phrases that holds it, so that a frequent term is spread over tasks.
    """
    keyed = cut_lineage(terms.select(F.lower("term").alias("_key"), "term", "label").distinct())
    bare = lambda c: F.regexp_replace(c, EDGE, "")
    starts = bit_filter(keyed.select(bare(F.split(F.col("_key"), " ")[0]).alias("f")), "f")
    known = bit_filter(keyed, "_key")
    rows = word_rows(spread(notes), max_words - 1)

    words = rows.select("*", F.posexplode_outer(F.slice("pieces", 1, WORDS_PER_ROW)).alias("i", "w")).where("w is not null")
    # A phrase that begins with a word of punctuation alone is the shorter one that begins behind it.
    words = words.withColumn("_bare", bare(F.lower("w"))).where(F.col("_bare") != "").where(starts(F.col("_bare")))
    raws = [
        F.when(F.col("i") + k <= F.size("pieces"), F.array_join(F.slice("pieces", F.col("i") + 1, F.lit(k)), "")) if k > 1 else F.col("w")
        for k in range(1, max_words + 1)
    ]
    at = (F.col("offset") + _chars(F.slice("pieces", F.lit(1), F.col("i")))).alias("at")
    phrases = words.select("note_id", at, F.explode_outer(F.array(*raws)).alias("raw")).where("raw is not null")
    left = F.regexp_replace("raw", r"^[^\p{L}\p{N}]+", "")
    phrases = phrases.select(
        "note_id",
        (F.col("at") + F.length("raw") - F.length(left)).alias("span_start"),
        F.regexp_replace(left, r"[^\p{L}\p{N}]+$", "").alias("lexical_variant"),
    ).where("lexical_variant <> ''")
    key = F.regexp_replace(F.lower("lexical_variant"), r"\s+", " ")
    shares = int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64("note_id", "span_start"), F.lit(shares)).cast("int")
    phrases = cut_to_files(phrases.withColumns({"_key": key, "_share": share}).where(known(F.col("_key"))), "phrases")
    offered = phrases.select("_key", "_share").distinct().join(keyed.hint("merge"), "_key")
    # The hints: measured by the texts they are cut from, or by their files, the phrases might be broadcast.
    hits = phrases.join(offered.hint("merge"), ["_key", "_share"])
    # A phrase that lost an outer word to punctuation equals a shorter phrase: keep one of them. With the keys of the join, which
    # follow from the others, equal rows are known to lie in one task already.
    return hits.select(
        "note_id", "span_start", (F.col("span_start") + F.length("lexical_variant")).alias("span_end"), "lexical_variant", "term", "label",
        "_key", "_share",
    ).distinct().drop("_key", "_share")


def _chunks(ends: Column, size: Column, max_tokens: int, one_sentence: bool) -> Column:
    """(s, e) word ranges from sentence ends, one pass over the sentences of a note.

    Only the numbers of a note leave the JVM, in Arrow batches: where a chunk begins depends on all before it.
    """

    @F.pandas_udf("array<int>")
    def bounds(ends: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for found, n in zip(ends, sizes):
            start, cuts = 0, [0]
            for end in (*found, n):
                if end - start > max_tokens:
                    cuts += [*range(start + max_tokens, end, max_tokens), end]
                elif one_sentence and end > start:
                    cuts.append(end)
                start = cuts[-1]
            out.append(cuts if start == n else [*cuts, n])
        return pd.Series(out)

    cuts = bounds(ends, size)
    pairs = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    return pairs


def chunk_notes(
    notes: DataFrame, spans: DataFrame | None = None, max_tokens: int = 512, one_sentence: bool = False
) -> DataFrame:
    """Notes cut into chunks of at most ``max_tokens`` words that end with sentences where they can.

    A sentence ends at a word that ends with ``.``. A sentence start inside a span of
    ``spans`` (note_id, span_start, span_end) is ignored. When the words gathered so far and
    the next sentence are too many, they are cut every ``max_tokens`` words up to the end of
    that sentence. ``max_tokens`` 0 keeps notes whole.
    """
    df = with_words(spread(notes.select("note_id", "text")))
    size, n = F.size("_p"), WORDS_PER_ROW

    def before(word):
        """Characters before a word and the white space ahead of it."""
        g = F.floor(word / n).cast("int")
        return F.coalesce(F.get("_off", g), F.length("text")) + _chars(F.slice("_p", g * n + 1, word - g * n))

    def begin(word):
        return before(word) + F.length(F.regexp_extract(F.get("_p", word), r"^(\s*)", 1))

    if max_tokens <= 0:
        chunks = F.array(F.struct(F.lit(0).alias("s"), size.alias("e")))
    else:
        ends = F.filter(
            F.transform(F.col("_p"), lambda w, i: F.when(w.endswith("."), i + 1)),
            lambda e: e.isNotNull() & (e < F.size("_p")),
        )
        if spans is not None:
            points = df.select(
                "note_id", F.explode_outer(F.transform(ends, lambda e: F.struct(e.alias("end"), begin(e).cast("int").alias("at")))).alias("x")
            ).where("x is not null")
            points = points.select("note_id", "x.end", F.col("x.at").alias("span_start"), (F.col("x.at") + 1).alias("span_end"))
            inside = containment_join(
                spans.select("note_id", "span_start", "span_end"), points, "note_id", "inner", inner_suffix="_p"
            )
            gone = inside.select(F.col("note_id_p").alias("note_id"), F.col("end_p").alias("end")).distinct()
            # At most the sentence starts of one note, which is itself a single value.
            gone = gone.groupBy("note_id").agg(F.collect_set("end").alias("_gone"))
            df = df.join(gone, "note_id", "left")
            ends = F.when(F.col("_gone").isNull(), ends).otherwise(F.array_except(ends, "_gone"))
        df = df.withColumn("_cuts", _chunks(ends, size, max_tokens, one_sentence))
        chunks = F.col("_cuts")

    def cut(c):
        lo, hi = begin(c["s"]), before(c["e"])
        text = F.substring("text", lo + 1, hi - lo)
        return F.struct(
            c["s"].alias("start"), c["e"].alias("end"), lo.cast("int").alias("span_start"), hi.cast("int").alias("span_end"), text.alias("text")
        )

    out = df.select("note_id", F.explode_outer(F.transform(chunks, cut)).alias("c")).where("c is not null").select("note_id", "c.*")
    name = F.concat_ws("-", "note_id", F.col("start").cast("string"), F.col("end").cast("string"))
    return out.select("note_id", name.alias("chunk_id"), "start", "end", "span_start", "span_end", "text")


def rebase_spans(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans clipped to the chunks they meet, with offsets inside the chunk."""
    c = chunks.select("note_id", "chunk_id", "span_start", "span_end")
    pairs = overlap_join(spans, c, "note_id", b_suffix="_c")
    lo, hi = F.col("span_start_c"), F.col("span_end_c")
    kept = pairs.where((F.col("span_end") > lo) & (F.col("span_start") < hi))
    keep = [x for x in spans.columns if x not in ("span_start", "span_end")]
    return kept.select(
        F.col("chunk_id_c").alias("chunk_id"),
        *keep,
        F.greatest(F.col("span_start") - lo, F.lit(0)).alias("span_start"),
        (F.least(F.col("span_end"), hi) - lo).alias("span_end"),
    )


def chunks_with_label(chunks: DataFrame, chunk_spans: DataFrame, label: str) -> DataFrame:
    """Chunks that hold an entity of a label."""
    return chunks.join(chunk_spans.where(F.col("label") == label).select("chunk_id").distinct(), "chunk_id", "left_semi")


def attach_notes(entities: DataFrame, how: str = "inner", note_label: str = "AnnotatorNotes") -> DataFrame:
    """Entity rows with the comment that refers to them inside the same file.

    Comment rows carry the entity id in ``span`` and their text in ``term``.
    """
    notes = entities.where(F.col("label") == note_label).select("source", F.col("span").alias("ann_id"), F.col("term").alias("annotation"))
    return entities.where(F.col("label") != note_label).join(notes, ["source", "ann_id"], how)


def map_labels(df: DataFrame, mapping: Mapping[str, str], label: str = "label") -> DataFrame:
    """Labels renamed by a mapping; rows with other labels go."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.where(F.col(label).isin(list(mapping))).withColumn(label, table[F.col(label)])


def locate_inner(df: DataFrame, term: str = "term", inner: str = "term_to_norm") -> DataFrame:
    """Span and text narrowed to ``inner`` where the term contains it."""
    text, start, end = inner_span(term, inner, "span_start", "span_end")
    return df.withColumns({term: text, "span_start": start.cast("int"), "span_end": end.cast("int")})


def add_snippets(df: DataFrame, width: int = 50, text: str = "text") -> DataFrame:
    """Snippet around each span and the span's offsets in it."""
    cut, start, end = snippet(text, "span_start", "span_end", width)
    return df.withColumns({"snippet": cut, "snippet_start": start, "snippet_end": end})


def _tiles(a: Column, b: Column) -> Column:
    """(level, block) of the dyadic blocks that together are the range from ``a`` to before ``b``, at most two of a level."""

    def at(k: Column) -> Column:
        low = -F.call_function("shiftright", -a, k)
        high = F.call_function("shiftright", b, k)
        tile = lambda block: F.struct(k.cast("int").alias("level"), block.alias("block"))
        odd = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1
        return F.array(F.when((low < high) & odd(low), tile(low)), F.when((low < high) & odd(high), tile(high - 1)))

    top = F.ceil(F.log2((b - a).cast("double"))).cast("int") + 1
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), top), at)), lambda x: x.isNotNull())


def _met(spans: DataFrame, key: str) -> DataFrame:
    """Distinct rows with ``_met``: whether the positions of a span meet those of another one of its note.

    Spans are sorted inside (note, position block), where the farthest end before and the next start tell; what reaches over
    the edge of a block is told by one row per block. Notes are told apart by a hash: two notes of one hash may only
    mark too many.
    """
    start, end = F.col("span_start").cast("long"), F.col("span_end").cast("long")
    filled = end > start
    low = F.when(filled, start * 2).when(end.isNotNull(), start * 2 - 1)
    block = F.coalesce(F.floor(low / (2 * BLOCK)), F.xxhash64(*spans.columns))
    rows = spans.select("*", F.xxhash64(key).alias("_note"), block.alias("_block"), low.alias("_low"), F.when(filled, end * 2 - 2).otherwise(low).alias("_high"))
    # Equal rows lie in one block: the rows are shuffled once for both.
    rows = rows.repartition("_note", "_block").distinct()

    inside, along = Window.partitionBy("_note", "_block").orderBy("_low"), Window.partitionBy("_note").orderBy("_block")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    edges = rows.where("_low is not null").groupBy("_note", "_block").agg(F.max("_high").alias("_high"), F.min("_low").alias("_low"))
    edges = edges.select(
        "_note", "_block", F.max("_high").over(before(along)).alias("_reach_out"), F.lead("_low").over(along).alias("_next_out")
    )
    rows = rows.withColumns({"_reach": F.max("_high").over(before(inside)), "_next": F.lead("_low").over(inside)})
    rows = rows.join(edges.hint("merge"), ["_note", "_block"], "left")
    meets = (F.col("_low") <= F.greatest("_reach", "_reach_out")) | (F.col("_high") >= F.least("_next", "_next_out"))
    return rows.select(*spans.columns, F.coalesce(meets, F.lit(False)).alias("_met"))


def resolve_overlaps(spans: DataFrame, key: str = "note_id") -> DataFrame:
    """Spans that survive a greedy choice: longest first, earlier start on ties (then by the other columns), none overlapping.

    Spans that meet no other one stay. The others are chosen in rounds: a span stays if no better span that is still open
    overlaps it; open spans that overlap one that stays go.
    A better span is at least as long, so it overlaps exactly where it covers the first or the last position of the
    other. What covers a position is found by equality joins: each span is cut into dyadic blocks, the best span of each block
    is a partial minimum, and a position lies in one block of each level. So nothing is compared pair by
    pair, a long span costs a few rows more, and a crowded place no more than others. Rounds end when no span is
    open; each settles at least the best open span of every run of overlapping ones. What is written between
    steps are the columns of ``spans`` and the best spans of blocks; blocks and positions of a span are made where they are used.

    Positions are doubled, so that an empty span is the gap before its position: it goes if a span lies on both
    sides. Repeated rows are one; spans without a start or an end stay.
    """
    columns = spans.columns
    ties = [c for c in columns if c not in ("span_start", "span_end", key)]
    start, end = F.col("span_start").cast("long"), F.col("span_end").cast("long")
    order = F.struct((start - end).alias("n"), start.alias("s"), *[F.col(c) for c in ties])
    filled = end > start
    points = F.when(filled, F.array_distinct(F.array(start * 2, end * 2 - 2))).otherwise(F.array(start * 2 - 1))
    same = lambda: F.col(key).eqNullSafe(F.col("_key")) & (F.col("level") == F.col("_l")) & (F.col("block") == F.col("_b"))

    def judged(df: DataFrame, by: DataFrame) -> DataFrame:
        """Rows of ``df`` with ``_lost``: whether a better span of ``by`` lies at their first or last position."""
        tiles = by.where(filled).select(F.col(key).alias("_key"), order.alias("_o"), F.explode(_tiles(start * 2, end * 2 - 1)).alias("t"))
        blocks = tiles.groupBy("_key", F.col("t.level").alias("_l"), F.col("t.block").alias("_b")).agg(F.min("_o").alias("_best"))
        blocks = cut_to_files(blocks, "blocks")
        levels = sorted(r._l for r in blocks.select("_l").distinct().collect())  # at most 64
        rows = df.select(*columns, F.lit(False).alias("_lost"))
        if not levels:
            return rows
        at = df.select(*columns, F.explode(points).alias("p")).select("*", F.explode(F.array(*map(F.lit, levels))).alias("level"))
        at = at.select(*columns, "level", F.call_function("shiftright", "p", "level").alias("block"))
        # The hint: files of few bytes may hold many blocks.
        lost = at.join(blocks.hint("merge"), same()).where(F.col("_best") < order).select(*columns, F.lit(True).alias("_lost"))
        return cut_to_files(rows.unionByName(lost).groupBy(*columns).agg(F.max("_lost").alias("_lost")), "judged")

    found = cut_to_files(_met(spans, key), "spans")
    kept, open_ = found.where("not _met").select(*columns), found.where("_met").select(*columns)
    while not open_.isEmpty():
        first = judged(open_, open_)
        stays = first.where("not _lost").select(*columns)
        kept = kept.unionByName(stays)
        open_ = judged(first.where("_lost").select(*columns), stays).where("not _lost").select(*columns)
    return kept


def precision_sample(predictions: DataFrame, others: DataFrame, notes: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """``n`` predictions per concept with the entities around them, in a snippet of the note.

    predictions (concept, source, span_start, span_end); others (source, term, label,
    annotation, span_start, span_end); notes (source, text). One row per nearby entity,
    the first per term; offsets are those inside the snippet.
    """
    picked = sample_per_group(predictions, "concept", ["source", "span_start", "span_end"], n, seed)
    picked = picked.select("concept", "source", "span_start", "span_end")
    near = either_contains_join(picked, others, "source", b_suffix="_e")
    keys = ["concept", "source", "span_start", "span_end", "term_e"]
    near = first_per_key(near, keys, ["span_start_e", "span_end_e", "label_e", "annotation_e"])
    with_text = near.join(notes.select("source", "text"), "source")
    cut, lo, _ = snippet("text", "span_start", "span_end")
    shift = F.col("span_start") - lo
    return with_text.select(
        "concept", "source", "span_start", "span_end", cut.alias("snippet"),
        F.col("term_e").alias("term"), F.col("label_e").alias("label"), F.col("annotation_e").alias("annotation"),
        (F.col("span_start_e") - shift).alias("snippet_start"), (F.col("span_end_e") - shift).alias("snippet_end"),
    )


def discrepancy_sample(
    flags: DataFrame, results: DataFrame, notes: DataFrame, concept: str, n: int = 10, seed: int = 42
) -> DataFrame:
    """Visits whose patient is positive in the tables but not in the texts: evidence and notes to read.

    flags (patient_num, <concept> positive_nlp, <concept> positive_tabular); results are the
    structured rows with ``<concept> positive``; notes (encounter_num, instance_num).
    """
    name = f"{concept} positive"
    patients = flags.where(~F.col(f"`{name}_nlp`") & F.col(f"`{name}_tabular`")).select("patient_num")
    rows = results.where(F.col(f"`{name}`")).join(patients, "patient_num", "left_semi")
    stays = rows.select("encounter_num").distinct().withColumn("_h", seeded_order(seed, "encounter_num"))
    stays = stays.orderBy("_h", "encounter_num").limit(n).select("encounter_num")
    evidence = F.concat_ws(
        " | ", "name_char", F.coalesce(F.col("value").cast("string"), F.lit("")), "unit", F.coalesce("tval_char", F.lit(""))
    )
    kept = rows.join(stays, "encounter_num").select("encounter_num", "patient_num", evidence.alias("evidence"))
    docs = notes.select("encounter_num", "instance_num").distinct()
    return kept.join(docs, "encounter_num", "left").withColumn("concept", F.lit(concept))
