"""Runs every registered query beside its SQL: python tests/check_oracles.py [sf] [names...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from antecede.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (value + 0.0 if value else 0.0)
    return value


def rows_of(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(normal(r[i]) for i in order)) for r in rows)


SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def compare(df, con, sql: str) -> list[str]:
    """What differs between a Spark result and its SQL; empty if nothing."""
    got, rel = df.collect(), con.sql(sql)
    names, wanted = list(rel.columns), rel.fetchall()
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(set(df.columns) ^ set(names))[:6]}"]
    types = dict(zip(names, map(str, rel.types)))
    odd = [(c, t, types[c]) for c, t in df.dtypes if SAME.get(t, t) != types[c]]
    if odd:
        problems.append(f"types {odd[:4]}")
    a, b = rows_of(df.columns, got), rows_of(names, wanted)
    if a != b:
        lost, extra = sorted(set(b) - set(a)), sorted(set(a) - set(b))
        problems.append(f"rows {len(a)} vs {len(b)}; only SQL {lost[:2]}; only Spark {extra[:2]}")
    return problems


def main() -> int:
    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark, con = local_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            found = compare(df, con, oracles[name]) if name in oracles else [] if df.count() else ["no rows"]
        except Exception as error:  # noqa: BLE001 - report every query
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(found)
        kind = "ok" if name in oracles else "ok (rows only)"
        print(f"{name:22s} {time.time() - start:6.1f}s {'; '.join(found) or kind}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
