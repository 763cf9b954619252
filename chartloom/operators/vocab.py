"""Vocabularies, dictionaries and code cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.text import LAB_STOPWORDS, clean_vocab_text, is_combination, mention_key, product_key
from chartloom.operators.lists import keep_unique_only, number_sorted

# Gold codes and the codes that replace them.
GOLD_CODE_FIXES = {
    "C0005803": "C0337438 ; C0392201",
    "C0017654": "C4544895",
    "C0948769": "C0201485 ; C0201487",
    "C0201487": "C0201485 ; C0201487",
    "C0282056": "C1262035",
    "C1168447": "C0201362",
    "C5190264": "C0201363",
    "C0134596": "C0201532",
    "C4264019": "C1294200",
    "C5201961": "C1266574",
    "NaN": None,
    "HO2": "H02",
    "H02AB07": "H02AB",
    "N03AX16": "N02BF02 ; N03AX16",
    "N03AX12": "N02BF01 ; N03AX12",
    "L01XC02": "L01XC02 ; L01FA01",
    "L01BA01": "L01BA01 ; L04AX03",
    "J07AL0": "J07AL01",
    "P01BA02": "P01BA02 ; M01CA",
    "C3159309": "B01AF01",
    "C0202194": "C0729816 ; C0202194",
    "C1278302": "C1278302 ; C0201476",
    "C0337438": "C0337438 ; C0392201",
    "C1277776": "C1277776 ; C1294978",
    "C1303280 ; C1295005": "C1303280 ; C1295005 ; C1531512",
    "C1295005": "C1303280 ; C1295005 ; C1531512",
    "C0201804": "C0201804 ; C0202150",
    "C0428472": "C0428472 ; C0392885",
    "C0428474": "C0428474 ; C0202117",
    "C0523115": "C0523115 ; C0023508",
    "C0202178": "C0202178 ; C0523826",
    "C1278049": "C1278049 ; C0202035",
    "C0587344": "C0587344 ; C0079611",
    "C0455288": "C0455288 ; C2732404",
    "C0430072": "C0430072 ; C0428539",
    "C0427417": "C0427417 ; C0523631",
}


def build_vocabulary(
    names: DataFrame,
    vocabulary: str,
    types: DataFrame | None = None,
    type_id: str | None = None,
    languages: Sequence[str] = ("FRE", "ENG"),
) -> DataFrame:
    """All synonyms (concept_id, str) of the concepts a vocabulary (and a semantic type) has.

    The concepts are an intersection of ids; their synonyms come from every vocabulary, in
    the given languages.
    """
    concepts = names.where(F.col("vocabulary") == vocabulary).select("concept_id")
    if type_id is not None:
        concepts = concepts.intersect(types.where(F.col("type_id") == type_id).select("concept_id"))
    wanted = names.where(F.col("language").isin(list(languages)))
    return wanted.join(concepts.distinct(), "concept_id", "left_semi").select("concept_id", "str").distinct()


def vocabulary_codes(names: DataFrame, vocabulary: str) -> DataFrame:
    """Distinct (concept_id, code) of one vocabulary."""
    return names.where(F.col("vocabulary") == vocabulary).select("concept_id", "code").distinct()


def map_codes(df: DataFrame, mapping: DataFrame, on: str = "concept_id") -> DataFrame:
    """Rows with the codes their concept maps to (a concept with two codes gives two rows)."""
    return df.join(mapping, on)


def drop_bad_synonyms(df: DataFrame, column: str = "str") -> DataFrame:
    """Without synonyms that are empty or all digits."""
    return df.where((F.col(column) != "") & ~F.col(column).rlike(r"^\d+$"))


def codes_per_synonym(
    vocab: DataFrame, stopwords: Sequence[str] = LAB_STOPWORDS, cased: bool = False, code: str = "code", name: str = "str"
) -> DataFrame:
    """(str, codes): sorted distinct codes of each cleaned synonym."""
    cleaned = vocab.select(F.col(code).alias("code"), clean_vocab_text(name, cased, stopwords).alias("str"))
    pairs = drop_bad_synonyms(cleaned).distinct()
    return pairs.groupBy("str").agg(F.sort_array(F.collect_set("code")).alias("codes"))


def truncate_codes(dictionary: DataFrame, n: int = 7) -> DataFrame:
    """Dictionary (label, norm_term) at the level of the first ``n`` characters of its codes.

    Names of codes that fall together are merged; a name with commas is several names.
    """
    name = F.explode(F.split("norm_term", ",")).alias("norm_term")
    return dictionary.select(F.substring("label", 1, n).alias("label"), name).distinct()


def clean_gold_codes(
    df: DataFrame, column: str = "annotation", fixes: Mapping[str, str | None] = GOLD_CODE_FIXES
) -> DataFrame:
    """Annotator codes as arrays: text after the last ``:``, corrected, split at `` ; ``.

    Rows without a code and repeated rows go.
    """
    code = F.substring_index(F.trim(column), ":", -1)
    pairs = [F.lit(x) for k, v in fixes.items() for x in (k, v if v is not None else "")]
    table = F.create_map(*pairs)
    fixed = F.nullif(F.coalesce(table[code], code), F.lit(""))
    return (
        df.withColumn(column, fixed)
        .where(F.col(column).isNotNull())
        .distinct()
        .withColumn(column, F.array_sort(F.array_distinct(F.split(column, " ; "))))
    )


def classification_names(df: DataFrame, code: str, label: str) -> DataFrame:
    """(code, name) from a classification sheet."""
    return df.select(F.col(code).alias("code"), mention_key(label).alias("name"))


def product_names(df: DataFrame, code: str, label: str) -> DataFrame:
    """(code, name, combination) from product labels: the first word names the product."""
    return df.select(F.col(code).alias("code"), product_key(label).alias("name"), is_combination(label).alias("combination"))


def synonym_names(df: DataFrame, code: str, label: str) -> DataFrame:
    """(code, name) from vocabulary synonyms; a pair that occurs twice is left out altogether."""
    pairs = keep_unique_only(df.select(F.col(code).alias("code"), F.col(label).alias("label")))
    return pairs.select("code", mention_key("label").alias("name"))


def build_dictionary(*sources: DataFrame) -> DataFrame:
    """Distinct (code, name) pairs of all sources."""
    out = sources[0].select("code", "name")
    for s in sources[1:]:
        out = out.unionByName(s.select("code", "name"))
    return out.distinct()


def dictionary_names(dictionary: DataFrame) -> DataFrame:
    """The distinct names of each code, one row each, numbered from 1 in text order."""
    return number_sorted(dictionary.select("code", "name").distinct(), ["code"], ["name"], "position")


def add_synonyms(df: DataFrame, vocab: DataFrame, codes: str = "annotation") -> DataFrame:
    """Rows with a display text: the first synonym (in text order) of each of their codes.

    Equal rows are looked up once and stay as many as they were.
    """
    first = vocab.groupBy("code").agg(F.min("str").alias("_name"))
    once = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_times"))
    long = once.select("*", F.explode_outer(codes).alias("code")).join(first, "code", "left")
    named = long.groupBy(*df.columns, "_times").agg(F.sort_array(F.collect_set("_name")).alias("names"))
    return named.select("*", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int"))).alias("_copy")).drop("_times", "_copy")
