"""Session defaults and the two helpers that touch cluster state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "chartloom", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` overrides any default."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_ready(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # One machine, one process: a folder of its own will do.
        named = f"file://{tempfile.mkdtemp(prefix='chartloom-')}"
    context.setCheckpointDir(named)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder of the session and read it from there.

    Used where a table is read several times (a count that sizes blocks, then the
    work itself). The files are on reliable storage, so a lost executor costs nothing.
    """
    _checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_to_files(df: DataFrame, name: str) -> DataFrame:
    """As ``cut_lineage``, in compressed columns: a fraction of the disk where values repeat.

    Spark's size estimate is then that of the files, far below the rows in memory: joins that must not be broadcast
    need a hint. Checkpoints are written where a column has no type that files can hold.
    """
    if any("void" in t for _, t in df.dtypes):
        return cut_lineage(df)
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files of one run, below the checkpoint folder."""
    _checkpoint_ready(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/chartloom/{name}-{uuid.uuid4().hex}"
