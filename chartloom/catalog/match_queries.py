"""Names to codes, vocabularies, code lists."""

from pyspark.sql import functions as F

from chartloom.catalog.cohort_queries import DRUG_NEEDS, DRUGS, LAB_NEEDS, LABS, drugs, labs
from chartloom.catalog.registry import query
from chartloom.functions import text as X
from chartloom.operators import codes as K
from chartloom.operators import lists as L
from chartloom.operators import match as M
from chartloom.operators import vocab as V
from chartloom.session import scratch
from chartloom.sources.codelists import code_table
from chartloom.sources.tables import read_dictionary, read_vocabulary

KEYS = ["source", "span_start", "term"]


def flat(df, *extra):
    """Matched rows with their arrays as text."""
    return df.select(
        *KEYS, *extra, F.array_join("label", ";").alias("label"), F.array_join("norm_term", ";").alias("norm_term"),
        F.round(F.coalesce("score", F.lit(-1.0)), 9).alias("score"),
    )


@query(
    "exact_matches",
    "C14 H15 B17 D3",
    "drug_mention dictionary",
    """, m as (select * from drug_mention where Tech <> 'True'),
       d as (select norm_term, array_to_string(list_sort(list(label)), ';') as label from dictionary group by norm_term)
       select source, span_start, term, coalesce(label, '') as label, coalesce(norm_term, '') as norm_term,
         case when norm_term is null then -1.0::double else 1.0::double end as score
       from m left join d on lower(trim(term)) = norm_term""",
)
def exact_matches(t):
    return flat(M.match_terms(M.drop_flagged(t.drug_mention, "Tech"), t.dictionary, "exact"))


def _fuzzy_sql(score: str, where: str) -> str:
    return f""", terms as (select distinct lower(trim(term)) as k from drug_mention),
       names as (select distinct norm_term from dictionary),
       p as (select k, norm_term, {score} as score from terms, names where {where}),
       b as (select * from p qualify score = max(score) over (partition by k)),
       d as (select k, round(score, 9) as score, array_to_string(list_sort(list(label)), ';') as label,
         array_to_string(list_sort(list(distinct norm_term)), ';') as norm_term from b join dictionary using (norm_term) group by k, score)
       select source, span_start, term, coalesce(label, '') as label, coalesce(norm_term, '') as norm_term, coalesce(score, -1.0) as score
       from drug_mention left join d on lower(trim(term)) = k"""


_JARO = ("jaro_winkler_similarity(k, norm_term)", "jaro_winkler_similarity(k, norm_term) > 0.8")


@query(
    "edit_distance_matches",
    "C12 C15 E1 H18 D3",
    "drug_mention dictionary",
    _fuzzy_sql("1 - levenshtein(k, norm_term) / greatest(length(k), length(norm_term))", "levenshtein(k, norm_term) < 10"),
)
def edit_distance_matches(t):
    return flat(M.match_terms(t.drug_mention, t.dictionary, "lev"))


@query(
    "jaro_winkler_matches",
    "C13 C15 E1 H19",
    "drug_mention dictionary",
    _fuzzy_sql(*_JARO),
)
def jaro_winkler_matches(t):
    return flat(M.match_terms(t.drug_mention, t.dictionary, "jaro_winkler", 0.8))


@query(
    "aliases_resolved",
    "C24",
    "",
    """select p_partkey, case p_type when 'PROMO' then 'glucocorticoid' when 'SMALL' then 'rituximab' when 'LARGE' then 'prevenar'
       else lower(p_type) end as name from part""",
)
def aliases_resolved(t):
    raw = F.when(F.col("p_type") == "PROMO", "Corticostéroïde".replace("ï", "i")).when(F.col("p_type") == "SMALL", " RTX ").when(
        F.col("p_type") == "LARGE", "prevenar13"
    ).otherwise(F.col("p_type"))
    return t.part.select("p_partkey", M.canonical_name(X.mention_key(raw)).alias("name"))


@query(
    "hybrid_matches",
    "C22",
    "drug_mention dictionary",
    _fuzzy_sql(*_JARO).split("select source, span_start, term, coalesce")[0]
    + """ select source, span_start, term, case when score >= 0.99 then label else 'N' end as label,
         case when score >= 0.99 then norm_term else 'other' end as norm_term,
         case when score >= 0.99 then score else 0.5::double end as score
       from drug_mention left join d on lower(trim(term)) = k""",
)
def hybrid_matches(t):
    fuzzy = M.match_terms(t.drug_mention, t.dictionary, "jaro_winkler", 0.8)
    neural = t.drug_mention.select(
        "source", "span_start", "span_end", F.array(F.lit("N")).alias("label"), F.array(F.lit("other")).alias("norm_term"), F.lit(0.5).alias("score")
    )
    return flat(M.hybrid_match(fuzzy, neural, 0.99))


@query(
    "nearest_vectors",
    "C16 F4 H20 R2",
    "vector vocab_vector",
    """, u as (select id, list_transform(vec, lambda x: x::double) as v from vector),
       w as (select vocab_id, label, norm_term, list_transform(vec, lambda x: x::double) as v from vocab_vector),
       p as (select id, vocab_id, label, norm_term, list_dot_product(u.v, w.v) / sqrt(list_dot_product(u.v, u.v)) / sqrt(list_dot_product(w.v, w.v)) as score from u, w)
       select id, vocab_id, label, norm_term, round(score, 6) as score from (select *, row_number() over (partition by id order by score desc, vocab_id) as rn from p) where rn = 1""",
)
def nearest_vectors(t):
    return M.nearest_concept(t.vector, t.vocab_vector).withColumn("score", F.round("score", 6))


@query(
    "unit_vector_norms",
    "H20",
    "vector",
    "select id, round(list_dot_product(list_transform(vec, lambda x: x::double), list_transform(vec, lambda x: x::double)), 6) as squared, 1.0::double as unit from vector",
)
def unit_vector_norms(t):
    u = X.unit_vector("vec")
    return t.vector.select("id", F.round(X.dot("vec", "vec"), 6).alias("squared"), F.round(X.dot(u, u), 6).alias("unit"))


@query(
    "list_terms_matched",
    "R3",
    "dictionary",
    """, p as (select o_orderkey as row_id, unnest(list_value('red bolt brand1', 'zzz', 'red bolt brand1', lower(replace(o_orderpriority, '-', ' ')))) as term,
         unnest(list_value(0, 1, 2, 3)) as position from orders),
       d as (select norm_term, array_to_string(list_sort(list(label)), ';') as label from dictionary group by norm_term)
       select row_id, position, term, coalesce(label, '') as label from p left join d on term = norm_term""",
)
def list_terms_matched(t):
    df = t.orders.select(
        F.col("o_orderkey").alias("row_id"),
        F.array(F.lit("red bolt brand1"), F.lit("zzz"), F.lit("red bolt brand1"), F.lower(F.replace("o_orderpriority", F.lit("-"), F.lit(" ")))).alias("terms"),
    )
    out = M.match_list_terms(df, "terms", lambda long: M.match_terms(long, t.dictionary, "exact"), "row_id")
    return out.select("row_id", "position", "term", F.array_join("label", ";").alias("label"))


def _clean_sql(c: str) -> str:
    words = "|".join(X.LAB_STOPWORDS)
    spelled = f"lower({c})"
    for a, b in [("-", " "), ("ag ", "antigene "), ("ac ", "anticorps "), ("antigenes ", "antigene "), ("anticorps ", "antibody ")]:
        spelled = f"replace({spelled}, '{a}', '{b}')"
    stop = f"regexp_replace({spelled}, '(?i)\\b(?:{words})\\b', '', 'g')"
    special = f"regexp_replace({stop}, '[^a-zA-Z0-9\\s]', ' ', 'g')"
    return f"trim(regexp_replace({special}, ' +', ' ', 'g'))"


@query(
    "vocabulary_text",
    "H14",
    "vocab_row",
    f"select str, {_clean_sql(chr(39) + 'Ac anti-' + chr(39) + ' || str')} as clean from vocab_row",
)
def vocabulary_text(t):
    return t.vocab_row.select("str", X.clean_vocab_text(F.concat(F.lit("Ac anti-"), "str"), stopwords=X.LAB_STOPWORDS).alias("clean"))


@query(
    "codes_per_synonym",
    "D2 B16",
    "vocab_row",
    f""", c as (select distinct {_clean_sql('str')} as s, code from vocab_row union select '42', 'X'),
       k as (select * from c where s <> '' and not regexp_matches(s, '^\\d+$'))
       select s as str, array_to_string(list_sort(list(code)), ';') as codes from k group by s""",
)
def codes_per_synonym(t):
    rows = t.vocab_row.select("code", "str").union(t.spark.createDataFrame([("X", "42")], "code string, str string"))
    return V.codes_per_synonym(rows).select("str", F.array_join("codes", ";").alias("codes"))


@query(
    "lab_vocabulary",
    "H24 G2 C18",
    "vocab_row vocab_type",
    """select distinct concept_id, str from vocab_row where language in ('FRE', 'ENG') and concept_id in (
         select concept_id from vocab_row where vocabulary = 'SNOMEDCT_US' intersect select concept_id from vocab_type where type_id = 'T059')""",
)
def lab_vocabulary(t):
    return V.build_vocabulary(t.vocab_row, "SNOMEDCT_US", t.vocab_type, "T059")


@query(
    "drug_vocabulary",
    "H24 C18",
    "vocab_row",
    """, c as (select distinct concept_id, code from vocab_row where vocabulary = 'ATC'),
       s as (select distinct concept_id, str from vocab_row where language in ('FRE', 'ENG') and concept_id in (select concept_id from c))
       select code, str from s join c using (concept_id)""",
)
def drug_vocabulary(t):
    return V.map_codes(V.build_vocabulary(t.vocab_row, "ATC"), V.vocabulary_codes(t.vocab_row, "ATC")).select("code", "str")


@query(
    "vocabulary_file",
    "A8",
    "vocab_row",
    "select concept_id, language, vocabulary, code, str from vocab_row",
)
def vocabulary_file(t):
    blank = F.lit("x")
    at = {0: "concept_id", 1: "language", 11: "vocabulary", 13: "code", 14: "str"}
    line = F.concat_ws("|", *[F.col(at[i]) if i in at else blank for i in range(18)], F.lit(""))
    path = scratch(t.spark, "vocabulary")
    t.vocab_row.select(line.alias("value")).write.mode("overwrite").text(path)
    return read_vocabulary(t.spark, path)


@query("dictionary_files", "A9 A10", "dictionary", "select label, norm_term, 'csv' as fmt from dictionary union all select label, norm_term, 'json' from dictionary")
def dictionary_files(t):
    csv, js = scratch(t.spark, "dictionary-csv"), scratch(t.spark, "dictionary-json")
    t.dictionary.write.mode("overwrite").csv(csv, header=True)
    t.dictionary.write.mode("overwrite").json(js)
    schema = "label string, norm_term string"
    a = read_dictionary(t.spark, csv, "csv", schema).withColumn("fmt", F.lit("csv"))
    return a.unionByName(read_dictionary(t.spark, js, "json", schema).withColumn("fmt", F.lit("json")))


@query(
    "truncated_dictionary",
    "H16",
    "dictionary",
    "select distinct left(label, 5) as label, unnest(string_split(norm_term || ',' || label, ',')) as norm_term from dictionary",
)
def truncated_dictionary(t):
    return V.truncate_codes(t.dictionary.withColumn("norm_term", F.concat_ws(",", "norm_term", "label")), 5)


@query(
    "gold_codes",
    "H21",
    "gold_code",
    """, c as (select distinct source, span_start, case split_part(trim(annotation), ':', -1) when 'NaN' then null when 'H02AB07' then 'H02AB'
         when 'HO2' then 'H02' when 'C0428472' then 'C0428472 ; C0392885' else split_part(trim(annotation), ':', -1) end as a from gold_code)
       select source, span_start, array_to_string(list_sort(list_distinct(string_split(a, ' ; '))), ';') as annotation from c where a is not null""",
)
def gold_codes(t):
    return V.clean_gold_codes(t.gold_code).withColumn("annotation", F.array_join("annotation", ";"))


@query(
    "hierarchical_code_hits",
    "H17",
    "dictionary",
    """select label, norm_term, case when substr(label, 1, 5) = 'H02AB' and right(label, 1) = '3' then true else right(label, 1) in ('1', '3') end as hit_prefix,
       right(label, 1) in ('1', '3') as hit_equal from dictionary""",
)
def hierarchical_code_hits(t):
    gold = F.array(F.lit("H02AB01"), F.lit("H02AB03"))
    pred = F.array(F.col("label"))
    return t.dictionary.select(
        "label", "norm_term", X.codes_hit(F.array(F.concat("label", F.lit("X9"))), gold, True).alias("hit_prefix"), X.codes_hit(pred, gold).alias("hit_equal")
    )


@query(
    "product_keys",
    "H22",
    "",
    """select p_partkey, lower(split_part(upper(p_type) || ' A/B ' || p_name, ' ', 1)) as name,
         regexp_matches(p_type || ' ' || p_brand || case when p_size > 25 then ' A/B' else '' end, '[A-Z]+/[A-Z]+') as combination from part""",
)
def product_keys(t):
    label = F.concat_ws(" ", "p_type", "p_brand", F.when(F.col("p_size") > 25, F.lit("A/B")))
    return V.product_names(t.part.withColumn("l", label).withColumn("code", F.col("p_partkey")), "code", "l").select(
        F.col("code").alias("p_partkey"), "name", "combination"
    )


@query(
    "drug_dictionary",
    "H23 E4",
    "vocab_row",
    """, a as (select p_brand as code, lower(p_name) as name from part),
       b as (select p_brand as code, lower(split_part(p_type, ' ', 1)) as name from part),
       c as (select code, lower(str) as name from vocab_row group by code, str having count(*) = 1),
       d as (select * from a union select * from b union select * from c)
       select code, name, row_number() over (partition by code order by name) as position from d""",
)
def drug_dictionary(t):
    d = V.build_dictionary(
        V.classification_names(t.part, "p_brand", "p_name"),
        V.product_names(t.part, "p_brand", "p_type"),
        V.synonym_names(t.vocab_row, "code", "str"),
    )
    return V.dictionary_names(d)


@query(
    "synonyms_added",
    "C23",
    "gold_code vocab_row",
    """, g as (select source, span_start, annotation from gold_code),
       f as (select code, min(str) as n from vocab_row group by code)
       select source, span_start, annotation, coalesce(n, '') as names from g left join f on code = 'Brand#' || right(annotation, 1)""",
)
def synonyms_added(t):
    df = t.gold_code.withColumn("codes", F.array(F.concat(F.lit("Brand#"), F.expr("right(annotation, 1)"))))
    return V.add_synonyms(df, t.vocab_row, "codes").select("source", "span_start", "annotation", F.array_join("names", ";").alias("names"))


LAB_CODES = {
    "lupus": {"Hemoglobin": ["RED_BOLT", "RED_GEAR", "RED_ROD"], "CRP": ["BLUE_RING", "RED_ROD"]},
    "takayasu": {"Hemoglobin": ["RED_BOLT"], "CRP": ["COLD_ANVIL", "HOT_GIZMO"]},
}
DRUG_CODES = {
    "lupus": {"Glucocorticoids": ["H02AB", "H02AB01", "H02AB02"], "Plaquenil": ["P01BA02"]},
    "takayasu": {"Glucocorticoids": ["H02AB03", "H02AB"], "Other": ["H02AB05"]},
}


def values(config, prefix=""):
    rows = [(d, c, prefix + k) for d, cs in config.items() for c, ks in cs.items() for k in ks]
    return "(select * from (values " + ", ".join(f"('{d}', '{c}', '{k}')" for d, c, k in rows) + ") v(disease, concept, code))"


LAB_LIST, DRUG_LIST = values(LAB_CODES, "LAB:"), values(DRUG_CODES)


def lab_codes(t):
    return code_table(t.spark, LAB_CODES, "LAB:")


def drug_codes(t):
    return code_table(t.spark, DRUG_CODES)


@query(
    "labs_by_code",
    "A12 C7",
    LAB_NEEDS,
    LABS + f", cl as {LAB_LIST} select l.instance_num, l.disease, l.concept_cd, c.concept from labs l join cl c on l.disease = c.disease and l.concept_cd = c.code",
)
def labs_by_code(t):
    return K.filter_by_codes(labs(t), lab_codes(t), "concept_cd").select("instance_num", "disease", "concept_cd", "concept")


_PREFIX = (
    DRUGS
    + f""", cl as {DRUG_LIST}, u as (
       select d.disease, d.instance_num, d.valueflag_cd, c.concept, 'full' as match_level from drugs d join cl c on d.disease = c.disease and d.valueflag_cd = c.code
       union all select d.disease, d.instance_num, left(d.valueflag_cd, 5), c.concept, 'prefix' from drugs d join cl c on d.disease = c.disease and left(d.valueflag_cd, 5) = c.code)"""
)


@query("drugs_by_code_prefix", "C8", DRUG_NEEDS, _PREFIX + " select * from u")
def drugs_by_code_prefix(t):
    out = K.filter_by_code_prefix(drugs(t), drug_codes(t), "valueflag_cd")
    return out.select("disease", "instance_num", "valueflag_cd", "concept", "match_level")


@query(
    "drugs_by_code_prefix_once",
    "C8",
    DRUG_NEEDS,
    _PREFIX + " select distinct disease, instance_num, concept from u",
)
def drugs_by_code_prefix_once(t):
    out = K.filter_by_code_prefix(drugs(t), drug_codes(t), "valueflag_cd", dedup=True)
    return out.select("disease", "instance_num", "concept").distinct()


@query(
    "matched_drugs_by_code",
    "D3 C7",
    "drug_mention dictionary",
    f""", cl as {DRUG_LIST},
       e as (select m.source, m.span_start, m.term, d.label from drug_mention m join dictionary d on d.norm_term = lower(trim(m.term))),
       j as (select c.disease, e.source, e.span_start, e.term, c.concept, e.label from e join cl c on c.code = e.label)
       select disease, source, span_start, term, concept, array_to_string(list_sort(list(label)), ';') as label from j group by all""",
)
def matched_drugs_by_code(t):
    matched = M.match_terms(t.drug_mention, t.dictionary, "exact").select("source", "span_start", "term", "label")
    per_disease = matched.withColumn("disease", F.explode(F.array(*[F.lit(d) for d in sorted(DRUG_CODES)])))
    return K.filter_code_lists(per_disease, drug_codes(t), "label").withColumn("label", F.array_join("label", ";"))


@query(
    "tied_best_names",
    "E1",
    "dictionary",
    """select label, norm_term from (select *, rank() over (partition by label order by length(norm_term) desc) as r from dictionary) where r = 1""",
)
def tied_best_names(t):
    df = t.dictionary.withColumn("score", F.length("norm_term"))
    return L.keep_top_ties(df, ["label"], "score").select("label", "norm_term")


@query(
    "first_rows",
    "E2",
    "dictionary",
    "select label, min(norm_term) as norm_term from dictionary group by label",
)
def first_rows(t):
    return L.first_per_key(t.dictionary, ["label"], ["norm_term"])
