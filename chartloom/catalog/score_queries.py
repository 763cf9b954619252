"""Scores, bootstraps, splits, result sinks."""

from pyspark.sql import functions as F

from chartloom.catalog.registry import query
from chartloom.operators import draws as D
from chartloom.operators import match as M
from chartloom.operators import resample as B
from chartloom.operators import score as S
from chartloom.session import scratch
from chartloom.sources.tables import write_scores, write_step

EXACT = """, g as (select source, label, span_start, span_end, count(*) as n from (select distinct source, label, span_start, span_end from gold_span) group by all),
  p as (select source, label, span_start, span_end, count(*) as n from (select distinct source, label, span_start, span_end from pred_span) group by all),
  counts as (select coalesce(g.source, p.source) as source, coalesce(g.label, p.label) as label,
    cast(sum(case when p.n is not null then g.n else 0 end) as bigint) as tp, cast(sum(case when g.n is null then p.n else 0 end) as bigint) as fp,
    cast(sum(case when p.n is null then g.n else 0 end) as bigint) as fn
    from g full join p on g.source = p.source and g.label = p.label and g.span_start = p.span_start and g.span_end = p.span_end group by 1, 2)"""
NEEDS = "gold_span pred_span"
COLS = ["source", "label", "span_start", "span_end"]


def spans(t):
    return t.gold_span.select(*COLS), t.pred_span.select(*COLS)


def counts(t):
    return S.match_counts(*spans(t))


@query("exact_match_counts", "D15", NEEDS, EXACT + " select * from counts")
def exact_match_counts(t):
    return counts(t)


@query(
    "inclusive_match_counts",
    "D15",
    NEEDS,
    """, g as (select distinct source, label, span_start, span_end from gold_span), p as (select distinct source, label, span_start, span_end from pred_span),
       r as (select source, label, exists (select 1 from p where p.source = g.source and p.label = g.label and p.span_start <= g.span_start and p.span_end >= g.span_end) as hit, 'g' as side from g
         union all select source, label, exists (select 1 from g where p.source = g.source and p.label = g.label and p.span_start <= g.span_start and p.span_end >= g.span_end), 'p' from p)
       select source, label, cast(count_if(side = 'g' and hit) as bigint) as tp, cast(count_if(side = 'p' and not hit) as bigint) as fp,
         cast(count_if(side = 'g' and not hit) as bigint) as fn from r group by 1, 2""",
)
def inclusive_match_counts(t):
    return S.match_counts(*spans(t), exact=False)


@query(
    "precision_recall_f1",
    "D16 F1",
    NEEDS,
    EXACT
    + """, l as (select label, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from counts group by label),
       a as (select * from l union all select 'Overall', sum(tp), sum(fp), sum(fn) from l),
       r as (select label, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, cast(tp + fn as bigint) as n_entity,
         case when tp + fp <> 0 then tp / (tp + fp) * 100 when tp = 0 then 100 else 0 end as precision, case when tp + fn <> 0 then tp / (tp + fn) * 100 when tp = 0 then 100 else 0 end as recall from a)
       select label, tp, fp, fn, n_entity, round(precision, 6) as precision, round(recall, 6) as recall,
         round(case when precision + recall <> 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) as f1 from r""",
)
def precision_recall_f1(t):
    per_label = counts(t).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    out = S.prf(S.add_overall(per_label))
    return out.withColumns({c: F.round(c, 6) for c in S.METRICS})


QUALIFIERS = ["Certainty", "Negation"]
_QUAL = """, g as (select distinct source, span_start, span_end, case when Certainty not in ('Certain') then 'Certainty_' || Certainty end as c0,
      case when Negation not in ('False') then 'Negation_' || Negation end as c1 from gold_span where label = 'Chemical_and_drugs'),
  p as (select distinct source, span_start, span_end, case when Certainty not in ('Certain') then 'Certainty_' || Certainty end as c0,
      case when Negation not in ('False') then 'Negation_' || Negation end as c1 from pred_span where label = 'Chemical_and_drugs'),
  j as (select g.source, g.c0 as g0, g.c1 as g1, p.c0 as p0, p.c1 as p1 from g join p on g.source = p.source and g.span_start = p.span_start and g.span_end = p.span_end),
  ga as (select * from g where not exists (select 1 from p where g.source = p.source and g.span_start = p.span_start and g.span_end = p.span_end)),
  pa as (select * from p where not exists (select 1 from g where g.source = p.source and g.span_start = p.span_start and g.span_end = p.span_end)),
  r as (""" + " union all ".join(
    f"""select source, g{i} as label, case when g{i} is not distinct from p{i} then 1 else 0 end as tp, 0 as fp, case when g{i} is not distinct from p{i} then 0 else 1 end as fn from j
        union all select source, p{i}, 0, 1, 0 from j where g{i} is distinct from p{i}
        union all select source, c{i}, 0, 0, 1 from ga union all select source, c{i}, 0, 1, 0 from pa"""
    for i in (0, 1)
) + """), qcounts as (select source, label, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from r where label is not null group by 1, 2)"""


@query("qualifier_counts", "D17 D15", NEEDS, _QUAL + " select * from qcounts")
def qualifier_counts(t):
    return S.qualifier_counts(t.gold_span, t.pred_span, QUALIFIERS)


@query(
    "qualifier_counts_by_name",
    "D17",
    NEEDS,
    _QUAL
    + " select source, split_part(label, '_', 1) as label, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from qcounts group by 1, 2",
)
def qualifier_counts_by_name(t):
    return S.qualifier_counts(t.gold_span, t.pred_span, QUALIFIERS, by_name=True)


#: Draws of the published intervals.
N_DRAW, N_ACCURACY, N_SPLIT = 5000, 1000, 5000


def _scattered(draws: str, seed: int, docs: str) -> str:
    """Check text: (draw, source, y), the whole number of each document in each draw."""
    return f""", dn as (select source, cast(concat('0x', substr(md5(source), 6, 14)) as bigint) % {D.PRIME} as h from {docs}),
  df as (select draw, 1 + cast(concat('0x', substr(md5('{seed}:' || cast(draw as varchar)), 1, 14)) as bigint) % {D.PRIME - 1} as a,
    cast(concat('0x', substr(md5('{seed}:' || cast(draw as varchar)), 15, 14)) as bigint) % {D.PRIME} as b from (select unnest({draws}) as draw)),
  sx as (select draw, source, (h * a + b) % {D.PRIME} as x from dn cross join df),
  sy as (select draw, source, x, x * x % {D.PRIME} as xx from sx),
  scattered as (select draw, source, xx * xx % {D.PRIME} * x % {D.PRIME} as y from sy)"""


def _draws(index_of: str, n_draw: int) -> str:
    """Check text: (draw, source, w), how often a draw takes a document: weights, then single picks by MD5."""
    steps = range(D.STEPS)
    return f""", ix as (select source, row_number() over (order by cast(concat('0x', substr(md5(source), 1, 5)) as bigint), source) - 1 as idx
      from (select distinct source from {index_of})),
  nn as (select count(*) as n from ix),
  st as (select greatest(0.0, 1 - 8 / sqrt(n)) as r, cast(1 as double) as t0, t0 as s0, {", ".join(f"t{k - 1} * r / {k} as t{k}, s{k - 1} + t{k} as s{k}" for k in steps if k)} from nn),
  sk as (select {", ".join(f"cast(floor({D.PRIME} * (exp(-r) * s{k}) + 0.5) as bigint) as k{k}" for k in steps)} from st)
  {_scattered(f"generate_series(1, {n_draw - 1})", 7, "ix")},
  ws as (select draw, source, {" + ".join(f"(y >= k{k})::int" for k in steps)} as w from scattered cross join sk),
  lack as (select draw, cast((select n from nn) - sum(w) as bigint) as m from ws group by draw),
  slots as (select draw, unnest(generate_series(1, m)) as slot from lack),
  picks as (select draw, cast(concat('0x', substr(md5('7:' || cast(draw as varchar) || ':' || cast(slot as varchar)), 1, 8)) as bigint) % (select n from nn) as idx from slots),
  taken as (select draw, source, w from ws where w > 0 union all select p.draw, ix.source, 1 from picks p join ix using (idx))"""


DRAWS = (
    EXACT
    + _draws("counts", N_DRAW)
    + """, draws as (select draw, label, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from (
      select 0 as draw, label, tp, fp, fn from counts
      union all select p.draw, c.label, w * c.tp, w * c.fp, w * c.fn from taken p join counts c on c.source = p.source) group by 1, 2)"""
)


@query("document_bootstrap", "D18", NEEDS, DRAWS + " select cast(draw as bigint) as draw, label, tp, fp, fn from draws")
def document_bootstrap(t):
    return B.bootstrap_docs(counts(t), N_DRAW, 7)


@query(
    "bootstrap_intervals",
    "D18 D20",
    NEEDS,
    DRAWS
    + """, o as (select * from draws union all select draw, 'Overall', sum(tp), sum(fp), sum(fn) from draws group by draw),
       m as (select draw, label, tp / (tp + fp) * 100 as p, tp / (tp + fn) * 100 as r from o)
       select label, round_even(max(case when draw = 0 then p end), 2) as precision, round_even(quantile_cont(p, 0.025), 2) as precision_lo, round_even(quantile_cont(p, 0.975), 2) as precision_hi,
         round_even(max(case when draw = 0 then r end), 2) as recall, round_even(quantile_cont(r, 0.025), 2) as recall_lo, round_even(quantile_cont(r, 0.975), 2) as recall_hi from m group by label""",
)
def bootstrap_intervals(t):
    out = B.scored_intervals(counts(t), N_DRAW, 7)
    return out.select("label", *[m + s for m in ("precision", "recall") for s in ("", "_lo", "_hi")])


@query(
    "interval_texts",
    "D20",
    NEEDS,
    DRAWS
    + """, o as (select * from draws union all select draw, 'Overall', sum(tp), sum(fp), sum(fn) from draws group by draw),
       m as (select draw, label, tp / (tp + fp) * 100 as p, tp / (tp + fn) * 100 as r, 2 * tp / (2 * tp + fp + fn) * 100 as f from o),
       t as (select label, """
    + ", ".join(
        f"""cast(round_even(max(case when draw = 0 then {c} end), 2) as varchar) || ' [' || cast(round_even(quantile_cont({c}, 0.025), 2) as varchar) || '-'
         || cast(round_even(quantile_cont({c}, 0.975), 2) as varchar) || ']' as {n}"""
        for c, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))
    )
    + " from m group by label) select * from t",
)
def interval_texts(t):
    return B.interval_text(B.scored_intervals(counts(t), N_DRAW, 7)).select("label", *S.METRICS)


@query("entity_bootstrap", "D19")
def entity_bootstrap(t):
    per_label = counts(t).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return B.bootstrap_entities(per_label, N_DRAW, 7)


def _codes(t):
    r = t.code_result
    one = [F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c)) for c in ("pred_code", "gold_code")]
    return r.select("source", "model", "score", one[0].alias("label"), one[1].alias("annotation"))


_HIT = "(pred_code is not null and {})"


@query(
    "code_scores",
    "D22 D25",
    "code_result",
    """select source, model, cast(count_if(coalesce(pred_code = gold_code, false)) as bigint) as tp, cast(count_if(pred_code is not null and pred_code <> gold_code) as bigint) as fp,
       cast(count_if(not coalesce(pred_code = gold_code, false)) as bigint) as fn from code_result group by 1, 2""",
)
def code_scores(t):
    return S.normalisation_counts(_codes(t), ["source", "model"])


@query(
    "code_scores_hierarchical",
    "D22 H17",
    "code_result",
    """select model, cast(count_if(coalesce(starts_with(pred_code, gold_code), false)) as bigint) as tp, cast(count_if(pred_code is not null and not starts_with(pred_code, gold_code)) as bigint) as fp,
       cast(count_if(not coalesce(starts_with(pred_code, gold_code), false)) as bigint) as fn from code_result group by 1""",
)
def code_scores_hierarchical(t):
    return S.normalisation_counts(_codes(t), ["model"], hierarchical=True)


@query(
    "score_gates",
    "B12",
    "code_result",
    """select model, 'blank' as mode, cast(count_if(pred_code is not null and score >= 0.5) as bigint) as kept, cast(count(*) as bigint) as n from code_result group by model
       union all select model, 'drop', cast(count_if(pred_code is not null) as bigint), cast(count(*) as bigint) from code_result where score >= 0.5 group by model""",
)
def score_gates(t):
    def tally(mode):
        df = M.score_gate(_codes(t), 0.5, mode)
        return df.groupBy("model").agg(F.count_if(F.size("label") > 0).alias("kept"), F.count("*").alias("n")).withColumn("mode", F.lit(mode))

    return tally("blank").unionByName(tally("drop"))


@query(
    "accuracy_intervals",
    "D21",
    "code_result",
    """, counts as (select source, cast(count_if(coalesce(pred_code = gold_code, false)) as bigint) as hits, cast(count(*) as bigint) as n from code_result group by 1)"""
    + _draws("code_result", N_ACCURACY)
    + """, d as (select draw, sum(hits) / sum(n) as a from (select 0 as draw, hits, n from counts
        union all select p.draw, w * c.hits, w * c.n from taken p join counts c on c.source = p.source) group by draw)
       select round_even(max(case when draw = 0 then a end), 3) as accuracy, round_even(quantile_cont(a, 0.025), 3) as accuracy_lo, round_even(quantile_cont(a, 0.975), 3) as accuracy_hi from d""",
)
def accuracy_intervals(t):
    c = S.normalisation_counts(_codes(t), ["source"])
    c = c.select("source", F.col("tp").alias("hits"), (F.col("tp") + F.col("fn")).alias("n"))
    return B.accuracy_intervals(c, N_ACCURACY, 7)


@query(
    "end_to_end_scores",
    "D23",
    "code_gold_span code_pred_span",
    """, p as (select pr.*, exists (select 1 from code_gold_span g where g.source = pr.source and g.span_start = pr.span_start and g.span_end = pr.span_end) as known,
         exists (select 1 from code_gold_span g where g.source = pr.source and g.span_start = pr.span_start and g.span_end = pr.span_end and g.code = pr.code) as hit from code_pred_span pr),
       r as (select source, hit::int as tp, (not hit)::int as fp, (known and not hit)::int as fn from p
         union all select source, 0, 0, (not exists (select 1 from code_pred_span pr where g.source = pr.source and g.span_start = pr.span_start and g.span_end = pr.span_end))::int from code_gold_span g)
       select source, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from r group by 1""",
)
def end_to_end_scores(t):
    gold = t.code_gold_span.withColumn("annotation", F.array("code"))
    pred = t.code_pred_span.withColumn("label", F.array("code"))
    return S.end_to_end_counts(gold, pred)


def _value_sql(strict):
    return f""", p as (select pr.*, exists (select 1 from value_gold g where g.source = pr.source and g.span_start <= pr.span_end and g.span_end >= pr.span_start) as seen,
         exists (select 1 from value_gold g where g.source = pr.source and g.span_start <= pr.span_end and g.span_end >= pr.span_start and g.value = pr.value) as hit from value_pred pr),
       r as (select source, hit::int as tp, (not hit)::int as fp, 0 as fn from p where seen or {strict}
         union all select source, 0, 0, 1 from value_gold g where not exists (select 1 from value_pred pr where g.source = pr.source and g.span_start <= pr.span_end and g.span_end >= pr.span_start))
       select source, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from r group by 1"""


@query("value_scores", "D24 C5", "value_gold value_pred", _value_sql("false"))
def value_scores(t):
    return S.value_counts(t.value_gold, t.value_pred)


@query("value_scores_strict", "D24", "value_gold value_pred", _value_sql("true"))
def value_scores_strict(t):
    return S.value_counts(t.value_gold, t.value_pred, strict=True)


_MODELS = """, g as (select m.model, g.* from (select distinct source, label, span_start, span_end from gold_span) g, (select unnest(generate_series(0, 2)) as model) m),
  p as (select span_start % 3 as model, source, label, span_start, span_end from (select distinct source, label, span_start, span_end from pred_span)),
  c as (select coalesce(g.model, p.model) as model, coalesce(g.label, p.label) as label,
      cast(count_if(g.source is not null and p.source is not null) as bigint) as tp, cast(count_if(g.source is null) as bigint) as fp, cast(count_if(p.source is null) as bigint) as fn
      from g full join p on g.model = p.model and g.source = p.source and g.label = p.label and g.span_start = p.span_start and g.span_end = p.span_end group by 1, 2)"""


def models(t):
    gold, pred = spans(t)
    gold = gold.withColumn("model", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    pred = pred.withColumn("model", F.pmod("span_start", F.lit(3)))
    c = S.match_counts(gold, pred, keys=["model", "source", "label"])
    return c.groupBy("model", "label").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])


@query("model_comparison", "D25", NEEDS, _MODELS + " select cast(model as bigint) as model, label, tp, fp, fn from c")
def model_comparison(t):
    return models(t).withColumn("model", F.col("model").cast("long"))


@query(
    "best_models",
    "D29 D28",
    NEEDS,
    _MODELS
    + """, s as (select model, label, unnest(['precision', 'recall']) as metric, unnest([round(case when tp + fp <> 0 then tp / (tp + fp) * 100 when tp = 0 then 100 else 0 end, 6), round(tp / (tp + fn) * 100, 6)]) as summary from c)
       select cast(model as bigint) as model, label, metric, summary, summary = max(summary) over (partition by label, metric) as best from s""",
)
def best_models(t):
    scored = S.prf(models(t)).withColumns({"model": F.col("model").cast("long"), "precision": F.round("precision", 6), "recall": F.round("recall", 6)})
    long = S.long_scores(scored.select("model", "label", "precision", "recall"), ["model", "label"], ["precision", "recall"])
    return S.flag_best(long, ["label", "metric"], "summary")


@query(
    "wide_score_table",
    "D28",
    NEEDS,
    _MODELS
    + """ select label, max(case when model = 0 then tp end) as "0_tp", max(case when model = 1 then tp end) as "1_tp", max(case when model = 2 then tp end) as "2_tp" from c group by label""",
)
def wide_score_table(t):
    out = S.wide_scores(models(t), ["label"], "model", [0, 1, 2], "tp")
    return out.withColumnsRenamed({str(i): f"{i}_tp" for i in range(3)})


@query(
    "score_texts_parsed",
    "D28",
    NEEDS,
    EXACT
    + """, l as (select label, cast(sum(tp) as bigint) as tp, cast(sum(fn) as bigint) as fn from counts group by label)
       select label, 'recall' as metric, cast(tp as varchar) || ' [' || cast(fn as varchar) || '-' || cast(tp + fn as varchar) || ']' as summary,
         cast(tp as double) as value, cast(fn as double) as lower, cast(tp + fn as double) as upper from l""",
)
def score_texts_parsed(t):
    c = counts(t).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"))
    s = [F.col(x).cast("string") for x in ("tp", "fn")]
    text = F.concat(s[0], F.lit(" ["), s[1], F.lit("-"), (F.col("tp") + F.col("fn")).cast("string"), F.lit("]"))
    return S.long_scores(c.select("label", text.alias("recall")), ["label"], ["recall"])


@query(
    "error_taxonomy",
    "D26",
    "review",
    """, a as (select *, coalesce(comment, '') as said from review),
       og as (select * from a where label = 'BIO_gold' and said not in ('neg', 'infra seuil, non significatif', 'pas de mention')),
       e as (select disease, concept, stay, 'Close to threshold' as error_type from a where said in ('neg', 'infra seuil, non significatif')
         union all select disease, concept, stay, 'No mention' from a where said = 'pas de mention'
         union all select disease, concept, stay, 'NER fails' from og where not exists (select 1 from a p where p.label <> 'BIO_gold' and p.span = og.span and p.source = og.source and p.disease = og.disease)
         union all select disease, concept, stay, 'Norm fails' from og where exists (select 1 from a p where p.label <> 'BIO_gold' and p.span = og.span and p.source = og.source))
       select x.disease, x.concept, error_type, stays, total_stays from (select disease, concept, error_type, count(distinct stay) as stays from e group by 1, 2, 3) x
       join (select disease, concept, count(distinct stay) as total_stays from a group by 1, 2) y on x.disease = y.disease and x.concept = y.concept""",
)
def error_taxonomy(t):
    return S.error_taxonomy(t.review)


_SPLIT = (
    """, dd as (select distinct source from doc_label_count), nn as (select cast(floor(0.2 * count(*)) as bigint) as k, 4 / sqrt(count(*)) as e from dd)"""
    + _scattered(f"generate_series(0, {N_SPLIT - 1})", 3, "dd")
    + f""", lowest as (select draw, count(*) as n from scattered cross join nn where y < (0.2 - e) * {D.PRIME} group by draw),
  rk as (select s.draw, source, row_number() over (partition by s.draw order by y, source) + coalesce(l.n, 0) as rk from scattered s cross join nn left join lowest l on l.draw = s.draw
    where y >= (0.2 - e) * {D.PRIME} and y < (0.2 + e) * {D.PRIME}),
  tt as (select draw, source from scattered cross join nn where y < (0.2 - e) * {D.PRIME} union all select draw, source from rk where rk <= (select k from nn)),
  tot as (select name, sum(n) as total from doc_label_count group by name),
  got as (select tt.draw, c.name, sum(c.n) as n from tt join doc_label_count c on tt.source = c.source group by 1, 2),
  cost as (select d.draw, cast(sum(floor(abs(coalesce(got.n, 0) / tot.total - 0.2::double) * 1000 + 0.5)) as bigint) / 1000 as cost from (select unnest(generate_series(0, {N_SPLIT - 1})) as draw) d cross join tot
    left join got on got.draw = d.draw and got.name = tot.name group by d.draw),
  best as (select draw from cost order by cost, draw limit 1)"""
)


@query("split_costs", "K1", "doc_label_count", _SPLIT + " select cast(draw as int) as draw, cost from cost")
def split_costs(t):
    c = t.doc_label_count
    return B.balanced_split(c.select("source"), c, draws=N_SPLIT, seed=3)[1]


@query(
    "balanced_split",
    "K1 E7",
    "doc_label_count",
    _SPLIT + " select source, case when source in (select source from tt where draw = (select draw from best)) then 'test' else 'train' end as part from dd",
)
def balanced_split(t):
    c = t.doc_label_count
    return B.balanced_split(c.select("source"), c, draws=N_SPLIT, seed=3)[0]


@query("stored_step", "A10 A11", NEEDS, EXACT + " select * from counts")
def stored_step(t):
    return write_step(counts(t), scratch(t.spark, "counts"), ["label"]).select("source", "label", "tp", "fp", "fn")


@query("document_score_lines", "A13", NEEDS, EXACT + " select * from counts")
def document_score_lines(t):
    path = scratch(t.spark, "scores")
    c = counts(t)
    write_scores(c, path)
    return t.spark.read.schema(c.schema).json(path)


@query("written_notes", "A7", "note_text", "select origin as disease, note_id, md5(text) as text_md5 from note_text")
def written_notes(t):
    from chartloom.sources.standoff import write_notes

    path = scratch(t.spark, "notes")
    write_notes(t.note_text.withColumnRenamed("origin", "disease"), path)
    back = t.spark.read.schema("note_id string, text string, disease string").parquet(path)
    return back.select("disease", "note_id", F.md5("text").alias("text_md5"))
