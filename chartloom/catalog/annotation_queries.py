"""Standoff annotations and note preparation."""

from pyspark.sql import functions as F

from chartloom.catalog.registry import query
from chartloom.operators import lists as L
from chartloom.operators import notes as N
from chartloom.operators import spans as S
from chartloom.session import cut_lineage, scratch
from chartloom.sources import standoff as B


@query(
    "standoff_entities",
    "A2 H13",
    "standoff_line",
    r""", m as (select source, line, regexp_extract(line, '^(.\d+)\t([^ ]+) ([^\t]+)\t(.*)$', ['ann_id', 'label', 'span', 'term']) as r
        from standoff_line where regexp_matches(line, '^(.\d+)\t([^ ]+) ([^\t]+)\t(.*)$'))
      select r.ann_id as ann_id, case when contains(r.span, ';') then right(r.term, 11) || ' ' || left(r.term, length(r.term) - 12) else r.term end as term,
        r.label as label, source,
        case when contains(r.span, ';') then split_part(split_part(r.span, ';', 2), ' ', 1) || ' ' || split_part(split_part(r.span, ';', 1), ' ', 2)
          else r.span end as span from m""",
)
def standoff_entities(t):
    return B.parse_lines(t.stored("standoff_line"))


@query(
    "standoff_full_entities",
    "A3",
    "standoff_line",
    r"""select source, regexp_extract(line, '^(T\d+)', 1) as entity_id, split_part(split_part(line, chr(9), 2), ' ', 1) as label,
        split_part(line, chr(9), 3) as text, cast(len(string_split(line, ';')) as bigint) as n_fragments
        from standoff_line where regexp_matches(line, '^(T\d+)\t([^\s]+)([^\t]+)\t(.*)$')""",
)
def standoff_full_entities(t):
    return B.parse_full(t.stored("standoff_line")).entities.select(
        "source", "entity_id", "label", "text", F.size("fragments").cast("long").alias("n_fragments")
    )


@query(
    "standoff_full_others",
    "A3",
    "standoff_line",
    r"""select source, 'attribute' as kind, split_part(line, chr(9), 1) as id, split_part(split_part(line, chr(9), 2), ' ', 1) as label,
          split_part(split_part(line, chr(9), 2), ' ', 2) as target, split_part(split_part(line, chr(9), 2), ' ', 3) as value
        from standoff_line where line like 'A%'
        union all
        select source, 'relation', split_part(line, chr(9), 1), 'Linked', regexp_extract(line, 'Arg1:(\S+)', 1), regexp_extract(line, 'Arg2:(\S+)', 1)
        from standoff_line where line like 'R%'
        union all
        select source, 'event', split_part(line, chr(9), 1), 'Test;Value', regexp_extract(line, 'Test:(\S+)', 1), regexp_extract(line, 'Value:(\S+)', 1)
        from standoff_line where line like 'E%'
        union all
        select source, 'note', split_part(line, chr(9), 1), '', regexp_extract(line, 'AnnotatorNotes (\S+)', 1), split_part(line, chr(9), 3)
        from standoff_line where line like '#%'
        union all
        select source, 'bad', line, '', '', '' from standoff_line where line like 'T% broken'""",
)
def standoff_full_others(t):
    s = B.parse_full(t.stored("standoff_line"))
    empty = F.lit("")

    def rows(df, kind, ident, label, target, value):
        cols = dict(id=ident, label=label, target=target, value=value)
        return df.select("source", F.lit(kind).alias("kind"), *[F.coalesce(c, empty).alias(n) for n, c in cols.items()])

    c = F.col
    return L.union_sources(
        rows(s.attributes, "attribute", c("attribute_id"), c("label"), c("target_id"), c("value")),
        rows(s.relations, "relation", c("relation_id"), c("relation_label"), c("from_entity_id"), c("to_entity_id")),
        rows(s.events, "event", c("event_id"), F.array_join("arguments.label", ";"), c("arguments")[0]["entity_id"], c("arguments")[1]["entity_id"]),
        rows(s.notes, "note", c("comment_id"), empty, c("entity_id"), c("comment")),
        rows(s.bad_lines, "bad", c("line"), empty, empty, empty),
    )


@query(
    "fragments_flat",
    "A4 F1",
    "standoff_line",
    r""", m as (select source, line, cast(regexp_extract(line, '^T(\d+)', 1) as bigint) as k, split_part(line, chr(9), 2) as p, split_part(line, chr(9), 3) as lexical_variant
        from standoff_line where regexp_matches(line, '^(T\d+)\t([^\s]+)([^\t]+)\t(.*)$')),
      r as (select *, row_number() over (partition by source order by k, split_part(p, ' ', 1), lexical_variant) as rn, rank() over (partition by source order by k) as rk from m),
      f as (select source, rn, split_part(p, ' ', 1) as label, lexical_variant, unnest(string_split(substr(p, instr(p, ' ') + 1), ';')) as fr from r)
      select replace(source, '.ann', '') as note_id, label, cast(split_part(fr, ' ', 1) as int) as begin, cast(split_part(fr, ' ', 2) as int) as "end", lexical_variant, cast(rn - 1 as bigint) as index from f""",
)
def fragments_flat(t):
    lines = t.stored("standoff_line")
    full = B.parse_full(lines)
    texts = lines.select("source", F.lit("").alias("text")).distinct()
    return B.notes_and_fragments(full.entities, texts)[1]


@query(
    "entity_numbers",
    "E3 A6",
    "mention",
    "select source, term, span_start, row_number() over (partition by source order by span_start, span_end, term) as rn from mention",
)
def entity_numbers(t):
    return L.number_within(t.mention, ["source"], "span_start", ["span_end", "term"]).select("source", "term", "span_start", "rn")


@query(
    "standoff_written_lines",
    "A6 E3",
    "note_text",
    r"""select note_id, cast(1 as bigint) as entity_no, 'T1' || chr(9) || 'HEAD 0 ' || cast(length(first) as varchar) || chr(9) || first as line
      from (select note_id, regexp_extract(text, '^(\S+)', 1) as first from note_text where regexp_matches(text, '^\S')) h""",
)
def standoff_written_lines(t):
    first = F.regexp_extract("text", r"^(\S+)", 1)
    notes = t.note_text.where(F.col("text").rlike(r"^\S"))
    frag = F.array(F.struct(F.lit(0).alias("begin"), F.length(first).alias("end")))
    ents = notes.select("note_id", F.lit("e1").alias("entity_id"), F.lit("HEAD").alias("label"), frag.alias("fragments"))
    return B.standoff_lines(ents, t.note_text).select("note_id", "entity_no", "line")


@query(
    "comments_attached",
    "C17",
    "standoff_entity",
    """select e.source, e.ann_id, e.term, e.label, n.term as annotation
       from (select * from standoff_entity where label <> 'AnnotatorNotes') e
       join (select source, span, term from standoff_entity where label = 'AnnotatorNotes') n on e.source = n.source and e.ann_id = n.span""",
)
def comments_attached(t):
    return N.attach_notes(t.standoff_entity).select("source", "ann_id", "term", "label", "annotation")


@query(
    "attributes_repaired",
    "H33",
    "standoff_line",
    """select source, case when line like 'A%' and contains(line, 'Negation') and not ends_with(line, ' Neg') then rtrim(line) || ' Neg' else line end as line
       from standoff_line""",
)
def attributes_repaired(t):
    return B.repair_attributes(t.stored("standoff_line"))


@query(
    "labels_overridden",
    "H34",
    "standoff_line",
    """, a as (select distinct source, regexp_extract(line, 'T(\\d+)', 1) as id, 'Device' as v from standoff_line where line like 'A%Tech T%')
       select l.source, case when a.v is not null and regexp_matches(l.line, '^T\\d+\\tChemical_and_drugs ') then replace(l.line, 'Chemical_and_drugs', 'Device') else l.line end as line
       from standoff_line l left join a on l.source = a.source and l.line like 'T%' and regexp_extract(l.line, 'T(\\d+)', 1) = a.id
       where not (l.line like 'A%Tech T%')""",
)
def labels_overridden(t):
    return B.override_labels(t.stored("standoff_line"))


@query(
    "annotated_documents",
    "H35",
    "standoff_line",
    """select distinct cast(o_orderkey as varchar) || '.ann' as source from orders
       where cast(o_orderkey as varchar) || '.ann' in (select source from standoff_line)""",
)
def annotated_documents(t):
    docs = t.orders.select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".ann")).alias("source"))
    return B.drop_unannotated(docs, t.stored("standoff_line"))


TERMS = [("de", "P"), ("the", "D"), ("of the", "PD"), ("le", "D"), ("and", "C"), ("pour", "P")]


_TAGS = r""", p as (select note_id, unnest(regexp_extract_all(text, '\s*\S+')) as piece, generate_subscripts(regexp_extract_all(text, '\s*\S+'), 1) as i from note_text),
      w as (select *, sum(length(piece)) over (partition by note_id order by i) - length(piece) as at_ from p),
      g as (select note_id, at_, piece as raw from w
        union all select note_id, at_, piece || nxt from (select *, lead(piece) over (partition by note_id order by i) as nxt from w) where nxt is not null),
      c as (select note_id, at_, raw, regexp_replace(raw, '^[^\p{L}\p{N}]+', '') as l from g),
      d as (select note_id, at_ + length(raw) - length(l) as span_start, regexp_replace(l, '[^\p{L}\p{N}]+$', '') as lexical_variant from c),
      terms as (select * from (values ('de', 'P'), ('the', 'D'), ('of the', 'PD'), ('le', 'D'), ('and', 'C'), ('pour', 'P')) v(term, label)),
      tagged as (select distinct note_id, cast(span_start as int) as span_start, cast(span_start + length(lexical_variant) as int) as span_end, lexical_variant, term, label
      from d join terms on term = regexp_replace(lower(lexical_variant), '\s+', ' ', 'g'))"""


@query("term_tagging", "R1", "note_text", _TAGS + " select * from tagged")
def term_tagging(t):
    terms = t.spark.createDataFrame(TERMS, "term string, label string")
    return N.tag_terms(t.note_text, terms, 2)


def _chunked(inside: str = "false") -> str:
    """Check text: chunks of 128 words; a sentence end is left out where ``inside`` holds for the word behind it."""
    return rf""", begins as (select note_id, i - 1 as k, at_, at_ + length(piece) - length(regexp_replace(piece, '^\s+', '')) as b from w),
      sizes as (select note_id, max(i) as n from p group by note_id),
      ends as (select x.note_id, x.i as e from p x join sizes z using (note_id) join begins y on y.note_id = x.note_id and y.k = x.i where ends_with(x.piece, '.') and not ({{inside}})
        union all select note_id, n from sizes),
      chain as (with recursive c as (select note_id, cast(0 as bigint) as s, min(e) as e from ends where e > 128 group by note_id
        union all select c.note_id, c.e, min(n.e) from c join ends n on n.note_id = c.note_id and n.e > c.e + 128 group by c.note_id, c.e) select * from c),
      ranges as (select note_id, s + k * 128 as s, least(s + k * 128 + 128, e) as e from (select *, unnest(range(cast(ceil((e - s) / 128) as bigint))) as k from chain)
        union all select z.note_id, coalesce(max(c.e), 0), any_value(z.n) from sizes z left join chain c using (note_id) group by z.note_id having coalesce(max(c.e), 0) < any_value(z.n)),
      bounds as (select r.note_id, cast(r.s as int) as start, cast(r.e as int) as "end", cast(a.b as int) as span_start, cast(coalesce(b.at_, length(t.text)) as int) as span_end, t.text
        from ranges r join note_text t using (note_id) join begins a on a.note_id = r.note_id and a.k = r.s left join begins b on b.note_id = r.note_id and b.k = r.e),
      chunks as (select note_id, note_id || '-' || cast(start as varchar) || '-' || cast("end" as varchar) as chunk_id, start, "end", span_start, span_end,
        substr(text, span_start + 1, span_end - span_start) as text from bounds)""".replace("{inside}", inside)


_IN_SPAN = "exists (select 1 from tagged s where s.note_id = y.note_id and s.span_start <= y.b and s.span_end > y.b)"


@query("note_chunks", "H36", "note_text", _TAGS + _chunked() + " select * from chunks")
def note_chunks(t):
    return N.chunk_notes(t.note_text, max_tokens=128)


@query("note_chunks_beside_entities", "H36", "note_text", _TAGS + _chunked(_IN_SPAN) + " select * from chunks")
def note_chunks_beside_entities(t):
    return N.chunk_notes(t.note_text, _doc_spans(t), max_tokens=128)


@query(
    "sentence_chunks",
    "H36",
    "note_text",
    r""", p as (select note_id, unnest(regexp_extract_all(text, '\s*\S+')) as piece, generate_subscripts(regexp_extract_all(text, '\s*\S+'), 1) as i from note_text),
      s as (select *, coalesce(sum(case when ends_with(piece, '.') then 1 else 0 end) over (partition by note_id order by i rows between unbounded preceding and 1 preceding), 0) as sent from p)
      select note_id, cast(min(i) - 1 as int) as start, cast(max(i) as int) as "end",
        regexp_replace(string_agg(piece, '' order by i), '^\s+', '') as text from s group by note_id, sent""",
)
def sentence_chunks(t):
    return N.chunk_notes(t.note_text, max_tokens=1_000_000, one_sentence=True).select("note_id", "start", "end", "text")


def _doc_spans(t):
    terms = t.spark.createDataFrame(TERMS, "term string, label string")
    # Stands for an entity table on storage, which the operators read more than once.
    return cut_lineage(N.tag_terms(t.note_text, terms, 2).select("note_id", "span_start", "span_end", "label"))


@query(
    "chunk_spans",
    "H37 K4",
    "note_text",
    _TAGS
    + _chunked()
    + """ select chunk_id, start, "end" from chunks c where exists (select 1 from tagged s where s.note_id = c.note_id and s.label = 'PD' and s.span_end > c.span_start and s.span_start < c.span_end)""",
)
def chunk_spans(t):
    chunks = N.chunk_notes(t.note_text, max_tokens=128)
    spans = N.rebase_spans(chunks, _doc_spans(t))
    return N.chunks_with_label(chunks, spans, "PD").select("chunk_id", "start", "end")


@query(
    "rebased_mentions",
    "H37",
    "mention",
    """, c as (select distinct source, cast(floor(span_start / 1000) * 1000 as int) as lo from mention
         union select distinct source, cast(floor(span_end / 1000) * 1000 as int) from mention)
       select m.source || '@' || cast(c.lo as varchar) as chunk_id, m.term, greatest(m.span_start - c.lo, 0) as span_start,
         least(m.span_end, c.lo + 1000) - c.lo as span_end
       from mention m join c on m.source = c.source and m.span_end > c.lo and m.span_start < c.lo + 1000""",
)
def rebased_mentions(t):
    m = t.mention.withColumnRenamed("source", "note_id")
    lo = [(F.floor(F.col(c) / 1000) * 1000).cast("int").alias("span_start") for c in ("span_start", "span_end")]
    chunks = m.select("note_id", lo[0]).union(m.select("note_id", lo[1])).distinct()
    chunks = chunks.select(
        "note_id", "span_start", (F.col("span_start") + 1000).alias("span_end"),
        F.concat_ws("@", "note_id", F.col("span_start").cast("string")).alias("chunk_id"),
    )
    return N.rebase_spans(chunks, m).select("chunk_id", "term", "span_start", "span_end")


@query(
    "inner_terms_located",
    "H38",
    "mention",
    """select source, case when instr(term, 'anti') > 0 then 'anti' else term end as term,
       case when instr(term, 'anti') > 0 then span_start + instr(term, 'anti') - 1 else span_start end as span_start,
       case when instr(term, 'anti') > 0 then span_start + instr(term, 'anti') + 3 else span_end end as span_end from mention""",
)
def inner_terms_located(t):
    df = t.mention.withColumn("term_to_norm", F.lit("anti"))
    df = N.locate_inner(df)
    return df.select("source", "term", F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"))


@query(
    "context_snippets",
    "H39",
    "note_text",
    """, s as (select note_id, text, instr(text, ' de ') as p from note_text where instr(text, ' de ') > 0)
       select note_id, substr(text, greatest(p - 50, 0) + 1, least(p + 2 + 51, length(text)) - greatest(p - 50, 0)) as snippet,
         cast(p - greatest(p - 50, 0) as int) as snippet_start, cast(p + 2 - greatest(p - 50, 0) as int) as snippet_end from s""",
)
def context_snippets(t):
    at = F.position(F.lit(" de "), F.col("text"))
    df = t.note_text.where(at > 0).withColumns({"span_start": at, "span_end": at + 2})
    return N.add_snippets(df).select("note_id", "snippet", "snippet_start", "snippet_end")


SECTIONS = {"src0": "SECTION_motif", "src1": "SECTION_antecedent", "src2": "SECTION_histoire"}


@query(
    "section_labels",
    "H40",
    "note_text",
    """select note_id, case origin when 'src0' then 'SECTION_motif' when 'src1' then 'SECTION_antecedent' else 'SECTION_histoire' end as label
       from note_text where origin in ('src0', 'src1', 'src2')""",
)
def section_labels(t):
    return N.map_labels(t.note_text.select("note_id", F.col("origin").alias("label")), SECTIONS)


#: Spans of one run of overlapping ones are folded one by one, the longest first.
_RESOLVED = """, spans as (select distinct note_id, span_start, span_end, label from tagged),
  opened as (select *, coalesce(span_start >= max(span_end) over (partition by note_id order by span_start, span_end, label rows between unbounded preceding and 1 preceding), true) as opens from spans),
  islands as (select *, sum(opens::int) over (partition by note_id order by span_start, span_end, label rows unbounded preceding) as island from opened),
  lists as (select note_id, list({'s': span_start, 'e': span_end, 'l': label} order by span_end - span_start desc, span_start, label) as l from islands group by note_id, island),
  folded as (select note_id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda kept, x: case when len(list_filter(kept, lambda k: k.s < x[1].e and x[1].s < k.e)) = 0 then kept || x else kept end)) as r from lists)"""


@query("overlaps_resolved", "E5", "note_text", _TAGS + _RESOLVED + " select note_id, r.s as span_start, r.e as span_end, r.l as label from folded")
def overlaps_resolved(t):
    return N.resolve_overlaps(_doc_spans(t))


@query(
    "overlap_join",
    "C5",
    "mention",
    """, p as (select source, term, span_start + 5 as span_start, span_end + 5 as span_end from mention)
       select m.source, m.span_start, m.span_end, p.span_start as span_start_b, p.span_end as span_end_b, p.term as term_b
       from mention m join p on m.source = p.source and m.span_start <= p.span_end and m.span_end >= p.span_start""",
)
def overlaps(t):
    p = t.mention.withColumns({"span_start": F.col("span_start") + 5, "span_end": F.col("span_end") + 5})
    return S.overlap_join(t.mention, p).select("source", "span_start", "span_end", "span_start_b", "span_end_b", "term_b")


@query(
    "exact_span_join",
    "C6",
    "mention inner_mention",
    """select m.source, m.term, m.span_start, m.span_end, i.term as term_b from mention m
       join (select source, term, span_start, span_end + 4 as span_end from inner_mention) i
       on m.source = i.source and m.span_start = i.span_start and m.span_end = i.span_end""",
)
def exact_spans(t):
    inner = t.inner_mention.withColumn("span_end", F.col("span_end") + 4)
    return S.exact_span_join(t.mention, inner).select("source", "term", "span_start", "span_end", "term_b")


@query(
    "either_contains",
    "C21 E2",
    "mention inner_mention",
    """, p as (select m.source, m.span_start, m.span_end, i.term as term_b, i.span_start as span_start_b, i.span_end as span_end_b
         from inner_mention m join mention i on m.source = i.source
         and ((m.span_start <= i.span_start and m.span_end >= i.span_end) or (m.span_start >= i.span_start and m.span_end <= i.span_end)))
       select * exclude (rn) from (select *, row_number() over (partition by source, span_start, span_end, term_b order by span_start_b, span_end_b) as rn from p) where rn = 1""",
)
def either_contains(t):
    pairs = S.either_contains_join(t.inner_mention, t.mention).select(
        "source", "span_start", "span_end", "term_b", "span_start_b", "span_end_b"
    )
    return L.first_per_key(pairs, ["source", "span_start", "span_end", "term_b"], ["span_start_b", "span_end_b"])


@query(
    "failed_gold_spans",
    "C20",
    "mention inner_mention",
    """select source, span_start, span_end, term from mention m where not exists (
       select 1 from inner_mention i where i.source = m.source and i.span_start = m.span_start)""",
)
def failed_gold_spans(t):
    return S.unmatched(t.mention, t.inner_mention, ["source", "span_start"]).select("source", "span_start", "span_end", "term")


@query(
    "label_counts",
    "D27",
    "entity",
    "select label, cast(count(*) as bigint) as n, count(distinct source) as docs from entity group by label",
)
def label_counts(t):
    from chartloom.operators.score import frequency

    return frequency(t.entity, "label", "source")


@query(
    "precision_sample",
    "K3 C21 H39 E6",
    "note_text",
    None,
)
def precision_sample(t):
    spans = _doc_spans(t).withColumnRenamed("note_id", "source")
    preds = spans.where("label = 'PD'").withColumn("concept", F.col("label"))
    others = spans.withColumns({"term": F.col("label"), "annotation": F.lit("")})
    return N.precision_sample(preds, others, t.note_text.withColumnRenamed("note_id", "source"))


@query(
    "seeded_order",
    "F3",
    "note_text",
    """select note_id, cast(concat('0x', substr(md5('42:' || note_id), 1, 15)) as bigint) as shuffle_key from note_text""",
)
def seeded_order(t):
    return L.shuffle_docs(t.note_text, "note_id").select("note_id", "shuffle_key")


@query("first_documents", "F2")
def first_documents(t):
    return L.limit_docs(t.note_text, 100).select("note_id")


@query(
    "sample_per_source",
    "E6",
    "note_text",
    """select origin, note_id from (select origin, note_id, row_number() over (partition by origin
       order by cast(concat('0x', substr(md5('42:' || origin || ':' || note_id), 1, 15)) as bigint), note_id) as k from note_text) where k <= 10""",
)
def sample_per_source(t):
    return L.sample_per_group(t.note_text, "origin", ["note_id"], 10).select("origin", "note_id")


@query(
    "unique_rows_only",
    "E4",
    "",
    "select p_name, p_type from part group by p_name, p_type having count(*) = 1 union all select p_name || '!', p_brand from part group by p_name, p_brand, p_size having count(*) = 1",
)
def unique_rows_only(t):
    a = L.keep_unique_only(t.part.select("p_name", "p_type"))
    b = L.keep_unique_only(t.part.select("p_name", "p_brand", "p_size"))
    return a.union(b.select(F.concat(F.col("p_name"), F.lit("!")), "p_brand"))


@query(
    "membership_split",
    "G5",
    "note_text",
    """select note_id, case when note_id in (select cast(doc_id as varchar) from labels) then 'test' else 'train' end as part from note_text""",
)
def membership_split(t):
    ids = t.labels.select(F.col("doc_id").cast("string").alias("note_id"))
    test, train = L.split_by_membership(t.note_text, ids, "note_id")
    return test.select("note_id", F.lit("test").alias("part")).union(train.select("note_id", F.lit("train").alias("part")))


@query("common_concepts", "G2", "", "select c_custkey as k from customer intersect select s_suppkey from supplier")
def common_concepts(t):
    return L.common_concepts(t.customer.select(F.col("c_custkey").alias("k")), t.supplier.select(F.col("s_suppkey").alias("k")), "k")


@query(
    "sources_united",
    "G1",
    "",
    """select n_name as name, cast(n_regionkey as varchar) as region, '' as segment from nation
       union all select c_name, '', c_mktsegment from customer""",
)
def sources_united(t):
    a = t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))
    b = t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return L.union_sources(a, b).na.fill("")


# --- files in folders: notes of one name in two folders ------------------------------------------


def _folder(t):
    """The notes of ``folder_note`` as ``.txt`` and ``.ann`` files; the folder's address."""
    root = scratch(t.spark, "notes")
    root = root if "://" in root else f"file://{root}"
    first = F.concat(F.lit("T1\tBIO 0 11\tHemoglobine\n"))
    whole = F.concat(F.lit("T2\tBIO_comp 0 "), (F.col("k") + 17).cast("string"), F.lit("\t"), F.substring_index("text", "\n", 1), F.lit("\n"))
    flag = F.when(F.col("odd") == 1, F.lit("A1\tNegation T2 Neg\n")).otherwise(F.lit(""))
    notes = t.folder_note
    B.export_files(notes.select(F.concat("note_id", F.lit(".ann")).alias("path"), F.concat(first, whole, flag).alias("content")), root)
    B.export_files(notes.select(F.concat("note_id", F.lit(".txt")).alias("path"), F.col("text").alias("content")), root)
    return root


@query(
    "folder_entities",
    "A2 H13",
    "folder_note",
    """select note_id || '.ann' as source, 'T1' as ann_id, 'BIO' as label, 'Hemoglobine' as term, '0 11' as span from folder_note
       union all select note_id || '.ann', 'T2', 'BIO_comp', split_part(text, chr(10), 1), '0 ' || cast(k + 17 as varchar) from folder_note""",
)
def folder_entities(t):
    return B.read_standoff(t.spark, _folder(t)).select("source", "ann_id", "label", "term", "span")


@query(
    "folder_full_entities",
    "A3",
    "folder_note",
    """select note_id || '.ann' as source, 'T1' as entity_id, 'BIO' as label, 'Hemoglobine' as text, cast(11 as int) as "end", cast(0 as bigint) as attributes from folder_note
       union all select note_id || '.ann', 'T2', 'BIO_comp', split_part(text, chr(10), 1), cast(k + 17 as int), cast(odd as bigint) from folder_note""",
)
def folder_full_entities(t):
    full = B.read_standoff_full(t.spark, _folder(t))
    counted = full.attributes.groupBy("source", F.col("target_id").alias("entity_id")).agg(F.count("*").alias("attributes"))
    out = full.entities.join(counted, ["source", "entity_id"], "left")
    return out.select(
        "source", "entity_id", "label", "text", F.element_at("fragments", -1)["end"].alias("end"), F.coalesce("attributes", F.lit(0)).alias("attributes")
    )


@query("folder_notes", "A5", "folder_note", "select note_id, text from folder_note")
def folder_notes(t):
    return B.discover_notes(t.spark, _folder(t))


@query(
    "standoff_sink",
    "A6",
    "folder_note",
    """select note_id, cast(1 as bigint) as entity_no, cast(0 as bigint) as attribute_no,
         'T1' || chr(9) || 'Chemical_and_drugs 12 ' || cast(17 + k as varchar) || ';' || cast(18 + k as varchar) || ' ' || cast(21 + k as varchar) || chr(9)
           || substr(text, 13, 5 + cast(k as int)) || ' CRP' as line from folder_note
       union all select note_id, 1, 1, 'A1' || chr(9) || 'Negation T1 Neg' from folder_note where odd = 1
       union all select note_id, 1, cast(1 + odd as bigint), 'A' || cast(1 + odd as varchar) || chr(9) || 'Tech T1 None' from folder_note""",
)
def standoff_sink(t):
    """An entity over a line break and its attributes, written and read back."""
    notes = t.folder_note
    frag = F.array(F.struct(F.lit(12).alias("begin"), (F.col("k") + 21).cast("int").alias("end")))
    ents = notes.select("note_id", F.lit("e").alias("entity_id"), F.lit(B.DRUG_LABEL).alias("label"), frag.alias("fragments"))
    attrs = notes.where("odd = 1").select("note_id", F.lit("e").alias("entity_id"), F.lit("Negation").alias("label"), F.lit("Neg").alias("value"))
    attrs = attrs.union(notes.select("note_id", F.lit("e"), F.lit("Tech"), F.lit(None).cast("string")))
    path = scratch(t.spark, "standoff")
    B.write_standoff(B.standoff_lines(ents, notes.select("note_id", "text"), attrs), path)
    return t.spark.read.parquet(path).select("note_id", "entity_no", "attribute_no", "line")
