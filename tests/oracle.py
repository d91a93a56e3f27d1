"""Run queries in Spark and in DuckDB and compare. ``python tests/oracle.py [sf] [name ...]``"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(v):
    return (v is None, 0.0 if v is None or (isinstance(v, float) and math.isnan(v)) else v)


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(r[i] for i in order) for r in records]
    return sorted(rows, key=lambda r: [_key(v) for v in r])


def compare(got_columns, got, want_columns, want) -> str | None:
    """None if equal, else what differs. Values are compared exactly."""
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    a, b = _rows(got_columns, got), _rows(want_columns, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        names = sorted(got_columns)
        x, y = bad[0]
        cells = [(n, p, q) for n, p, q in zip(names, x, y) if p != q]
        return f"{len(bad)} of {len(a)} rows differ, first: {cells[:4]}"
    return None


def check(spark, con, name, run, sql, sf_dir) -> tuple[str | None, int, float, float]:
    start = time.time()
    df = run(spark, sf_dir)
    got = df.collect()
    mid = time.time()
    if sql is None:
        return None, len(got), mid - start, 0.0
    result = con.sql(sql)
    types = [str(t) for t in result.types]
    if any("DECIMAL" in t or t == "HUGEINT" for t in types):
        return f"SQL types {types}", len(got), mid - start, 0.0
    want_columns, want = result.columns, result.fetchall()
    return compare(df.columns, [tuple(r) for r in got], want_columns, want), len(got), mid - start, time.time() - mid


if __name__ == "__main__":
    from sensorframe.queries import all_queries, all_sql
    from sensorframe.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    wanted = sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    sqls, failed = all_sql(), []
    for name, run in all_queries().items():
        if wanted and name not in wanted:
            continue
        try:
            problem, n, t_spark, t_sql = check(spark, con, name, run, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            problem, n, t_spark, t_sql = f"{type(e).__name__}: {str(e)[:600]}", -1, 0, 0
        kind = "sql " if name in sqls else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:24s} {n:7d} rows {t_spark:6.2f}s duckdb {t_sql:5.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
