"""Run registered queries and their SQL checks side by side.

    python tests/compare.py [tables folder] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return repr(value)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = sorted(tuple(normal(r[i]) for i in order) for r in rows)
    return [columns[i] for i in order], out


def compare(spark, con, name: str, query, sql: str, folder: str) -> str:
    """Empty text on a match, otherwise what differs."""
    df = query(spark, folder)
    got_cols, got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}"
    return ""


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from textgauge.session import local_session

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.001"
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = duck(folder), oracle_sql(), 0
    for name, query in queries().items():
        if args[1:] and name not in args[1:]:
            continue
        t = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, name, query, sql[name], folder)
            else:
                problem = "" if query(spark, folder).count() else "no rows"
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t:.1f}s {problem}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
