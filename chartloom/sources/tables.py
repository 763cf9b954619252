"""Table sources and sinks: warehouse scans, vocabulary and dictionary files, result folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_tables(spark: SparkSession, folder: str, spec: Mapping[str, Mapping[str, str]]) -> dict[str, DataFrame]:
    """Parquet tables cut to the named columns: ``{table: {new_name: column}}``."""
    out = {}
    for table, columns in spec.items():
        df = spark.read.parquet(f"{folder}/{table}.parquet")
        out[table] = df.select(*[F.col(c).alias(n) for n, c in columns.items()])
    return out


# Positions of the columns used in the two vocabulary files.
NAMES_COLUMNS = {0: "concept_id", 1: "language", 11: "vocabulary", 13: "code", 14: "str"}
NAMES_WIDTH = 18
TYPES_COLUMNS = {0: "concept_id", 1: "type_id"}
TYPES_WIDTH = 6


def read_vocabulary(spark: SparkSession, path: str, kind: str = "names") -> DataFrame:
    """Pipe-delimited vocabulary file, without quoting; ``kind`` is ``names`` or ``types``."""
    columns, width = {"names": (NAMES_COLUMNS, NAMES_WIDTH), "types": (TYPES_COLUMNS, TYPES_WIDTH)}[kind]
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(width + 1)])
    df = spark.read.csv(path, sep="|", schema=schema, quote="", escape="", encoding="UTF-8")
    return df.select(*[F.col(f"_{i}").alias(n) for i, n in columns.items()])


def read_dictionary(spark: SparkSession, path: str, fmt: str = "csv", schema: str | None = None) -> DataFrame:
    """Dictionary table from CSV with a header, or from JSON."""
    if fmt == "csv":
        return spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=False)
    if fmt == "json":
        return spark.read.json(path, schema=schema)
    raise ValueError("fmt is 'csv' or 'json'")


def write_step(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a step's table as parquet and return it as read back."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_sinks(df: DataFrame, path: str, by: str = "disease") -> DataFrame:
    """Write a step once, as one sink per value of ``by``, and return the combined table as read back.

    The folders below ``path`` are the sinks, its root is the combined table: nothing is written twice. Rows of one
    sink are dealt over tasks by a hash of the row, so a disease with most of the rows is no task's file.
    """
    rest = [c for c in df.columns if c != by]
    salt = F.pmod(F.xxhash64(*rest), F.lit(16)) if rest else F.lit(0)
    df.repartition(F.col(by), salt).write.mode("overwrite").partitionBy(by).parquet(path)
    return read_sink(df.sparkSession, path, df.schema, by).select(*df.columns)


def read_sink(spark: SparkSession, path: str, schema: T.StructType, by: str = "disease", value: object = None) -> DataFrame:
    """One sink of ``write_sinks`` (only its folder is read), or all of them where ``value`` is None."""
    held = spark.read.schema(schema).parquet(path)
    return held if value is None else held.where(F.col(by) == F.lit(value))


def write_scores(df: DataFrame, path: str) -> None:
    """Per-document scores as JSON lines."""
    df.write.mode("overwrite").json(path)
