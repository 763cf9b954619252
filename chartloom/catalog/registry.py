"""The registered queries: name, inventory ids, DataFrame builder, check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from chartloom.catalog.fixtures import check_sql, spark_table
from chartloom.session import cut_lineage


class Tables:
    """Attribute access to the given and derived tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return spark_table(self.spark, self.sf_dir, name)

    def stored(self, name: str) -> DataFrame:
        """A derived table written out first, as the files it stands for would be."""
        return cut_lineage(spark_table(self.spark, self.sf_dir, name))


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, ids: str, needs: str = "", sql: str | None = None):
    """Register a builder ``Tables -> DataFrame`` under ``name``."""

    def keep(build):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        text = check_sql(needs.split(), sql) if sql else None
        QUERIES[name] = Query(name, ids, build, text)
        return build

    return keep
