"""Input tables of the registered queries, derived from the given tables.

Each entry is one SELECT that reads the same in Spark SQL and in ANSI SQL engines, so a
query and its check start from equal inputs. ``{name}`` marks a given table; a bare name
in ``needs`` is another entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_FAMILY = """case l_orderkey % 14 when 0 then 'positif' when 1 then 'negatif' when 2 then 'augmentee' when 3 then 'diminuee'
      when 4 then 'depassee' when 5 then 'normale' when 6 then 'elevee' when 7 then 'basse' when 8 then 'absence' when 9 then 'presence'
      when 10 then 'non significatif' when 11 then 'physiologique' when 12 then 'fluctuante' else 'hemolyse' end"""
_MENTION = f"""case when l_partkey % 17 = 3 then 'Troponine 0,0005 ng/ml (N: 0,0001 - 0,0004)'
      when l_partkey % 17 = 5 then 'Troponine 0,00001 ng/ml (N: 0,0001 - 0,0004)'
      when l_partkey % 17 = 7 then 'Plaquettes 250000000 /l (N: 150000000 - 400000000)'
      when l_partkey % 17 = 9 then 'Plaquettes 12000001 /l (N: 150000000 - 400000000)'
      else case l_linenumber
      when 1 then 'Hemoglobine : ' || cast(cast(l_quantity as int) as string) || ',5 g/dl (N: 12 - 16)'
      when 2 then 'CRP ' || cast(cast(l_quantity as int) as string) || 'mg/l'
      when 3 then 'Ac anti-DNA ' || {_FAMILY}
      when 4 then 'Leucocytes ' || cast(cast(l_quantity as int) as string) || ' G/L 12/2019'
      when 5 then 'Proteinurie < 0.' || cast(cast(l_quantity as int) as string) || ' g/24h urinaire'
      when 6 then 'Creatinine ' || cast(cast(l_quantity as int) as string) || ' micromol/l'
      else 'TP ' || cast(cast(l_quantity as int) as string) || ' %' end end"""
_NAME = """case when l_partkey % 17 in (3, 5) then 'Troponine' when l_partkey % 17 in (7, 9) then 'Plaquettes' else case l_linenumber when 1 then 'Hemoglobine' when 2 then 'CRP' when 3 then 'Ac anti-DNA'
      when 4 then 'Leucocytes' when 5 then 'Proteinurie' else 'TP' end end"""

# name -> (entries it reads, SELECT text)
FIXTURES: dict[str, tuple[list[str], str]] = {
    "visit": (
        [],
        """select o_orderkey as encounter_num, o_custkey as patient_num, o_orderdate as start_date,
           cast(18 + o_custkey % 80 as int) as age_visit_in_years_num from {orders}""",
    ),
    "diagnosis": (
        [],
        """select o_orderkey as encounter_num, 'CIM10:' || substr(o_orderpriority, 1, 1) as concept_cd
           from {orders}""",
    ),
    "note": (
        [],
        """select case when doc_id % 9 = 1 then cast(doc_id - 1 as string) else cast(doc_id as string) end as instance_num,
           text as observation_blob, doc_id as encounter_num,
           o_custkey as patient_num, o_orderdate as note_date,
           case lang when 'fr' then 'CR:CRH-HOSPI' when 'en' then 'CR:CRH-S' else 'CR:OTHER' end as concept_cd
           from {documents} join {orders} on doc_id = o_orderkey""",
    ),
    "concept": (
        [],
        """select distinct 'LAB:' || upper(replace(p_name, ' ', '_')) as concept_cd,
           'CODE: ' || p_name || '_x' as name_char from {part}""",
    ),
    "lab": (
        [],
        """select cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string)
             as instance_num,
           'LAB:' || upper(replace(p_name, ' ', '_')) as concept_cd,
           case l_linenumber when 4 then null when 1 then 'g/dl' when 2 then 'mg/dl' else 'mg/l' end as units_cd,
           case when l_linenumber = 6 then null else l_quantity end as nval_num,
           case when l_linenumber = 6 and l_returnflag = 'A' then 'Positif'
                when l_linenumber = 5 then 'PRESENCE' end as tval_char,
           l_discount as quantity_num, cast(20 + l_linenumber as double) as confidence_num,
           l_orderkey as encounter_num, o_custkey as patient_num, l_shipdate as start_date
           from {lineitem} join {part} on l_partkey = p_partkey join {orders} on l_orderkey = o_orderkey""",
    ),
    "drug": (
        [],
        """select cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string)
             as instance_num,
           'MED:' || upper(replace(p_name, ' ', '_')) as concept_cd,
           case when p_type = 'PROMO' then 'H02AB' else 'H02AB0' || cast(p_size % 9 as string) end as valueflag_cd,
           l_orderkey as encounter_num, o_custkey as patient_num, l_shipdate as start_date
           from {lineitem} join {part} on l_partkey = p_partkey join {orders} on l_orderkey = o_orderkey
           where l_linestatus = 'O'""",
    ),
    "drug_concept": (
        [],
        """select distinct 'MED:' || upper(replace(p_name, ' ', '_')) as concept_cd,
           'CODE: ' || p_name || '_x' as name_char from {part}""",
    ),
    "mention": (
        [],
        f"""select distinct cast(l_orderkey as string) || '.ann' as source, {_MENTION} as term,
           cast(l_linenumber * 1000000 + l_partkey * 40 as int) as span_start,
           cast(l_linenumber * 1000000 + l_partkey * 40 + length({_MENTION}) as int) as span_end
           from {{lineitem}}""",
    ),
    "inner_mention": (
        [],
        f"""select distinct cast(l_orderkey as string) || '.ann' as source, {_NAME} as term,
           cast(l_linenumber * 1000000 + l_partkey * 40 as int) as span_start,
           cast(l_linenumber * 1000000 + l_partkey * 40 + length({_NAME}) as int) as span_end
           from {{lineitem}} where l_linenumber <> 6""",
    ),
    "entity": (
        ["mention", "inner_mention"],
        """select source, term, term as lexical_variant, span_start, span_end, 'BIO_comp' as label from mention
           union all
           select source, term, term as lexical_variant, span_start, span_end, 'BIO' as label from inner_mention""",
    ),
    "dictionary": (
        [],
        """select distinct 'H02AB0' || cast(p_size % 9 as string) as label,
           p_name || ' ' || lower(replace(p_brand, '#', '')) as norm_term from {part}""",
    ),
    "lab_name": (
        [],
        """select distinct 'L' || cast(p_partkey % 5 + 1 as string) as label, case p_partkey % 5 when 0 then 'hemoglobine' when 1 then 'crp'
             when 2 then 'ac anti-dna' when 3 then 'plaquettes' else 'troponine' end as norm_term from {part}""",
    ),
    "folder_note": (
        [],
        """select case s_suppkey % 2 when 0 then 'a/' else 'b/x/' end || 'note' || cast(s_suppkey - s_suppkey % 2 as string) as note_id,
           'Hemoglobine ' || cast(s_suppkey as string) || ' g/dl' || chr(10) || 'CRP ' || cast(s_nationkey as string) || ' mg/l' as text,
           s_suppkey % 2 as odd, length(cast(s_suppkey as string)) as k, length(cast(s_nationkey as string)) as c from {supplier}""",
    ),
    "drug_mention": (
        [],
        """select substr(name, 1, k) || substr(name, k + 2) as term, cast(p_partkey as string) || '.ann' as source,
           cast(p_partkey * 10 as int) as span_start, cast(p_partkey * 10 + length(name) - 1 as int) as span_end,
           case when p_size % 5 = 0 then 'Neg' when p_size % 5 = 1 then cast(null as string) else 'Aff' end as Negation,
           case when p_size % 3 = 0 then 'Hypothetical' else 'Certain' end as Certainty,
           case when p_type = 'PROMO' then 'True' else 'False' end as Tech
           from (select *, p_name || ' ' || lower(replace(p_brand, '#', '')) as name,
             cast(p_partkey % length(p_name || ' ' || lower(replace(p_brand, '#', ''))) as int) as k from {part}) p""",
    ),
    "vocab_row": (
        [],
        """select 'C' || cast(p_partkey % 300 as string) as concept_id,
           case when p_size % 3 = 0 then 'FRE' when p_size % 3 = 1 then 'ENG' else 'GER' end as language,
           case when p_type in ('PROMO', 'SMALL') then 'ATC' else 'SNOMEDCT_US' end as vocabulary,
           p_brand as code, p_name || ' ' || lower(p_type) || '-test' as str from {part}""",
    ),
    "vocab_type": (
        [],
        """select distinct 'C' || cast(p_partkey % 300 as string) as concept_id,
           case when p_size > 25 then 'T059' else 'T060' end as type_id from {part}""",
    ),
    "vector": ([], "select vec_id as id, embedding as vec from {embeddings} where vec_id % 2 = 0"),
    "vocab_vector": (
        [],
        """select vec_id as vocab_id, cast(label as string) as label, 'name ' || cast(vec_id as string) as norm_term,
           embedding as vec from {embeddings} where vec_id % 2 = 1""",
    ),
    "gold_code": (
        [],
        """select cast(p_partkey as string) || '.ann' as source, cast(p_partkey * 10 as int) as span_start,
           case when p_size = 1 then 'NaN' when p_size % 7 = 0 then ' cui:H02AB07 ' when p_size % 7 = 1 then 'HO2'
             when p_size % 7 = 2 then 'C0428472' else 'H02AB0' || cast(p_size % 9 as string) end as annotation from {part}""",
    ),
    "text_result": (
        [],
        """select cast(l_orderkey as string) || '_' || cast(l_linenumber as string) || '.ann' as source,
           l_orderkey as encounter_num, o_custkey as patient_num,
           case l_linenumber when 1 then 'Hemoglobin' when 3 then 'Anti-DNA' when 4 then 'Leucocytes' when 5 then 'Anti-DNA' else 'CRP' end as concept,
           case when l_partkey % 17 = 3 then '0.0005' when l_partkey % 17 = 5 then '0.00001' when l_partkey % 17 = 7 then '250000000.0'
             when l_partkey % 17 = 9 then '12000001.0' else case l_linenumber when 1 then cast(cast(l_quantity as int) as string) || '.5' when 2 then cast(cast(l_quantity as int) as string)
             when 4 then '<' || cast(cast(l_quantity as int) as string) when 7 then cast(cast(l_quantity as int) as string) || ',25' end end as value_cleaned,
           case l_linenumber when 1 then '12-16' when 2 then '<5' when 4 then '>10' when 7 then '1,5-30' end as range_value,
           case l_linenumber when 3 then 'positif' when 5 then 'negatif' end as non_digit_value,
           case l_linenumber when 1 then 'g/dl' when 2 then 'mg/l' when 7 then 'MG_per_l' end as unit
           from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    ),
    "struct_result": (
        ["lab"],
        """select instance_num, encounter_num, patient_num,
           case substr(concept_cd, 5, 3) when 'RED' then 'Hemoglobin' when 'BLU' then 'CRP' when 'HOT' then 'Anti-DNA' end as concept,
           nval_num as value, units_cd as unit, confidence_num, tval_char from lab""",
    ),
    "gold_span": (
        [],
        """select distinct cast(l_orderkey as string) as source, case l_linenumber % 3 when 0 then 'BIO' when 1 then 'DISO' else 'Chemical_and_drugs' end as label,
           cast(l_linenumber * 100000 + l_partkey * 10 as int) as span_start, cast(l_linenumber * 100000 + l_partkey * 10 + 6 as int) as span_end,
           case when l_returnflag = 'R' then 'Neg' when l_returnflag = 'A' then 'False' end as Negation,
           case when l_linestatus = 'O' then 'Certain' else 'Hypothetical' end as Certainty
           from {lineitem}""",
    ),
    "pred_span": (
        [],
        """select distinct cast(l_orderkey as string) as source, case l_linenumber % 3 when 0 then 'BIO' when 1 then 'DISO' else 'Chemical_and_drugs' end as label,
           cast(l_linenumber * 100000 + l_partkey * 10 - l_suppkey % 3 as int) as span_start,
           cast(l_linenumber * 100000 + l_partkey * 10 + 6 + l_suppkey % 2 as int) as span_end,
           case when l_discount > 0.05 then 'Neg' end as Negation,
           case when l_tax > 0.04 then 'Certain' else 'Hypothetical' end as Certainty
           from {lineitem} where l_partkey % 7 <> 0""",
    ),
    "code_result": (
        [],
        """select cast(l_orderkey as string) as source, l_linenumber as model,
           case when l_quantity < 5 then null else 'H02AB0' || cast(l_suppkey % 4 as string) end as pred_code,
           case when l_linenumber = 3 then 'H02AB' else 'H02AB0' || cast(l_partkey % 4 as string) end as gold_code,
           cast(l_quantity as double) / 50 as score from {lineitem}""",
    ),
    "code_gold_span": (
        [],
        """select distinct cast(l_orderkey as string) as source, cast(l_linenumber * 1000 as int) as span_start,
           cast(l_linenumber * 1000 + 5 as int) as span_end, 'H02AB0' || cast(l_partkey % 4 as string) as code from {lineitem}""",
    ),
    "code_pred_span": (
        [],
        """select cast(l_orderkey as string) as source, cast(l_linenumber * 1000 + case when l_suppkey % 5 = 0 then 1 else 0 end as int) as span_start,
           cast(l_linenumber * 1000 + 5 as int) as span_end, 'H02AB0' || cast(l_suppkey % 4 as string) as code from {lineitem}""",
    ),
    "value_gold": (
        [],
        """select cast(l_orderkey as string) as source, cast(l_linenumber * 1000 as int) as span_start, cast(l_linenumber * 1000 + 10 as int) as span_end,
           cast(cast(l_quantity as int) as string) || ' g/l' as value from {lineitem} where l_returnflag <> 'R'""",
    ),
    "value_pred": (
        [],
        """select cast(l_orderkey as string) as source, cast(l_linenumber * 1000 + 5 as int) as span_start, cast(l_linenumber * 1000 + 8 as int) as span_end,
           cast(cast(l_quantity as int) + case when l_suppkey % 4 = 0 then 1 else 0 end as string) || ' g/l' as value from {lineitem} where l_returnflag <> 'A'""",
    ),
    "review": (
        [],
        """select case when l_linestatus = 'O' then 'lupus' else 'takayasu' end as disease, 'c' || cast(l_suppkey % 5 as string) as concept,
           l_orderkey as stay, cast(l_orderkey as string) || '.ann' as source, cast(l_partkey as string) as span,
           case when l_tax > 0.03 then 'BIO_gold' else 'BIO' end as label,
           case l_linenumber when 1 then 'neg' when 2 then 'pas de mention' when 3 then 'infra seuil, non significatif' when 4 then 'autre' end as comment
           from {lineitem}""",
    ),
    "doc_label_count": (
        [],
        """select cast(l_orderkey as string) as source, 'L' || cast(l_linenumber as string) as name, cast(count(*) as bigint) as n
           from {lineitem} group by l_orderkey, l_linenumber""",
    ),
    "note_text": (
        [],
        "select cast(doc_id as string) as note_id, text, source as origin from {documents}",
    ),
    "standoff_line": (
        ["mention"],
        """select source, 'T' || i || chr(9) || case n when 7 then 'Chemical_and_drugs' else 'BIO_comp' end || ' ' ||
             case when n = 5 and term like 'Proteinurie%' then cast(span_start + 12 as string) || ' ' || cast(span_end as string) || ';' ||
               cast(span_start as string) || ' ' || cast(span_start + 11 as string)
             else cast(span_start as string) || ' ' || cast(span_end as string) end || chr(9) ||
             case when n = 5 and term like 'Proteinurie%' then substr(term, 13) || ' ' || substr(term, 1, 11) else term end as line
           from (select *, cast(cast(floor(span_start / 40) as bigint) as string) as i, cast(floor(span_start / 1000000) as int) as n from mention) m
           union all
           select source, case n when 1 then 'A' || i || chr(9) || 'Negation T' || i || ' Neg'
             when 3 then 'A' || i || chr(9) || 'Negation T' || i
             when 7 then 'A' || i || chr(9) || 'Tech T' || i || ' Device'
             when 2 then 'R' || i || chr(9) || 'Linked Arg1:T' || i || ' Arg2:T1'
             when 4 then 'E' || i || chr(9) || 'Test:T' || i || ' Value:T2'
             when 5 then 'T' || i || ' broken'
             else '#' || i || chr(9) || 'AnnotatorNotes T' || i || chr(9) || 'C0201357 ; C0201358' end as line
           from (select *, cast(cast(floor(span_start / 40) as bigint) as string) as i, cast(floor(span_start / 1000000) as int) as n from mention) m
           where n <= 7""",
    ),
    "standoff_entity": (
        ["mention"],
        """select 'T' || cast(cast(floor(span_start / 40) as bigint) as string) as ann_id, term, 
             case when span_start >= 7000000 then 'Chemical_and_drugs' else 'BIO_comp' end as label, source,
             cast(span_start as string) || ' ' || cast(span_end as string) as span from mention
           union all
           select '#' || cast(cast(floor(span_start / 40) as bigint) as string), 'C0201357 ; C0201358', 'AnnotatorNotes', source,
             'T' || cast(cast(floor(span_start / 40) as bigint) as string) from mention where span_start < 2000000 or span_start >= 6000000""",
    ),
}


def _order(names, seen=None) -> list[str]:
    seen = [] if seen is None else seen
    for n in names:
        if n not in seen:
            _order(FIXTURES[n][0], seen)
            if n not in seen:
                seen.append(n)
    return seen


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One entry as a DataFrame."""
    if name in BASE:
        return base(spark, sf_dir, name)
    names = _order([name])
    text = "with " + ",\n".join(f"{n} as ({FIXTURES[n][1]})" for n in names) + f"\nselect * from {name}"
    used = {b: base(spark, sf_dir, b) for b in BASE if "{" + b + "}" in text}
    return spark.sql(text, **used)


def check_sql(needs, body: str) -> str:
    """Check query: the entries it needs as common table expressions, then ``body``.

    ``body`` is a SELECT, or ``, name as (...) ... select ...`` to add its own expressions.
    """
    ctes = ",\n".join(f"{n} as ({FIXTURES[n][1]})" for n in _order(needs))
    body = body.strip()
    if body.startswith(","):
        text = ("with " + ctes + body) if ctes else ("with " + body[1:])
    else:
        text = ("with " + ctes + "\n" + body) if ctes else body
    for b in BASE:
        text = text.replace("{" + b + "}", b)
    return text
