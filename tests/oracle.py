"""Compare registered queries with their SQL on DuckDB: `python tests/oracle.py [sf] [name ...]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return db


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows in a stable order with engine-neutral cell values."""

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, (bool,)):
            return str(v)
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return repr(v) if not v.is_integer() else repr(int(v))
        if isinstance(v, pd.Timestamp) or hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        if isinstance(v, (list, tuple)):
            return repr([cell(i) for i in v])
        return str(v)

    columns = sorted(df.columns)
    return sorted(tuple(cell(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))


def compare(spark_df, db, sql: str) -> tuple[bool, str]:
    got, want = spark_df.toPandas(), db.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} of {len(a)} rows differ, first {bad[0]} in {sorted(got.columns)}"
    nulls = {c: int(got[c].isna().sum()) for c in got.columns if got[c].isna().any()}
    return True, f"{len(a)} rows, nulls {nulls}"


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    known, oracles = queries(), oracle_sql()
    names = sys.argv[2:] or list(known)
    spark, db = session(), connect(folder)
    failed = []
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                ok, text = compare(known[name](spark, folder), db, oracles[name])
            else:
                ok, text = True, f"{known[name](spark, folder).count()} rows (no SQL)"
        except Exception as error:  # report and go on with the next query
            ok, text = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += [] if ok else [name]
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {text}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")
