"""Compare registered queries with their DuckDB oracle; also runnable as a script.

usage: python tests/oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from metaloom.plans import catalog  # noqa: E402
from metaloom.plans.views import BASE_TABLES  # noqa: E402

TEST_ROOT = "/root/testdata"


def spark_session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("metaloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (float, int)):
        return repr(float(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str):
    """(matches, spark row count, message, spark seconds, duckdb seconds)."""
    t0 = time.time()
    df = catalog.QUERIES[name](catalog.Catalog(spark, sf_dir))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if name not in catalog.ORACLES:
        return None, len(got[1]), "rows only", t1 - t0, 0.0
    result = con.execute(catalog.ORACLES[name])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    t2 = time.time()
    if got[0] != want[0]:
        return False, len(got[1]), f"columns {got[0]} != {want[0]}", t1 - t0, t2 - t1
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        note = f"rows {len(got[1])} vs {len(want[1])}; only spark {sorted(a - b)[:3]}; only duckdb {sorted(b - a)[:3]}"
        return False, len(got[1]), note, t1 - t0, t2 - t1
    return True, len(got[1]), "", t1 - t0, t2 - t1


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args[0] if args else f"{TEST_ROOT}/sf0.001"
    prefixes = args[1:]
    session, connection = spark_session(), duck(sf)
    bad = 0
    for key in catalog.QUERIES:
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        try:
            ok, n, note, ts, td = compare(session, connection, key, sf)
        except Exception as error:  # report and go on with the next query
            ok, n, note, ts, td = False, -1, f"{type(error).__name__}: {str(error)[:600]}", 0, 0
        bad += ok is False
        empty = " EMPTY" if n == 0 else ""
        print(f"{'ok  ' if ok else ('rows' if ok is None else 'FAIL')} {key:40s} {n:8d} spark {ts:6.2f}s duck {td:6.2f}s{empty} {note}", flush=True)
    print("failed:", bad)
