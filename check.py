"""Run registered queries next to their check SQL: ``python check.py [folder] [name ...]``."""

from __future__ import annotations

import sys
import tempfile
import time
import traceback

import duckdb
import pandas as pd

from chartloom.catalog import load
from chartloom.catalog.fixtures import BASE
from chartloom.session import build_session


def _plain(v):
    if v is None or v is pd.NaT:
        return "∅"
    if isinstance(v, float):
        return "∅" if v != v else repr(v)
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_plain(x) for x in v) + "]"
    if isinstance(v, float):
        return "∅" if v != v else repr(v)
    return str(v)


def rows_of(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(_plain(v) for v in row) for row in df.itertuples(index=False))


def connect(sf_dir: str):
    con = duckdb.connect()
    for b in BASE:
        con.execute(f"create view {b} as select * from '{sf_dir}/{b}.parquet'")
    return con


def compare(spark, con, q, sf_dir):
    """Empty text if equal, otherwise what differs."""
    got = q.run(spark, sf_dir).toPandas()
    if q.sql is None:
        return "" if len(got) else "no rows"
    want = con.execute(q.sql).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    kinds = [
        (c, got[c].dtype, want[c].dtype)
        for c in sorted(got.columns)
        if str(got[c].dtype) != str(want[c].dtype)
    ]
    a, b = rows_of(got), rows_of(want)
    if a != b:
        sa, sb = set(a), set(b)
        return f"rows {len(a)} / {len(b)}\n  only spark {sorted(sa - sb)[:3]}\n  only check {sorted(sb - sa)[:3]}\n  cols {sorted(got.columns)} {kinds}"
    return "" if not kinds else f"~types {kinds}"


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(load())
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g", "spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='chartloom-check-')}"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            msg = compare(spark, con, load()[name], sf)
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:1500]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += bool(msg) and not msg.startswith("~")
        print(f"{'ok ' if not msg else 'DIFF'} {name} {time.time() - t0:.1f}s {msg}", flush=True)
    print(f"{len(names)} queries, {bad} differ")
