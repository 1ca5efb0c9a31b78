"""Runs registered queries beside their SQL and compares the rows: ``python -m tests.compare [SF_DIR] [NAME...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return float(f"{float(x):.9g}") + 0.0
    return x if isinstance(x, (str, bytes)) else str(x)


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(_cell(r[k]) for k in order) for r in rows)


def differ(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows_of(list(rel.columns), rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} / {sorted(rel.columns)}"
    if got != want:
        return f"{sum(got.values())} / {sum(want.values())} rows; only here {list((got - want).items())[:2]}, only there {list((want - got).items())[:2]}"
    return ""


def main(args: list[str]) -> int:
    import __spark_entry__ as e
    from barlake.session import session

    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark, con = session("local[8]", 8), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, bad = e.queries(), e.oracle_sql(), 0
    for name in args[1:] or queries:
        began = time.time()
        try:
            said = differ(spark, con, name, queries[name], oracles[name], sf_dir) if name in oracles else f"(rows only: {queries[name](spark, sf_dir).count()})"
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:500]}"
        bad += bool(said) and not said.startswith("(rows")
        print(f"{name} {time.time() - began:.1f}s {said or 'same'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
