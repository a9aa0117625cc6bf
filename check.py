"""Run registered queries against their SQL on one scale: ``python check.py [dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

from cuesheet.registry import all_oracles, all_queries
from cuesheet.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    return repr(value)


def compare(spark_rows, spark_cols, sql_rows, sql_cols):
    if sorted(spark_cols) != sorted(sql_cols):
        return f"columns {sorted(spark_cols)} != {sorted(sql_cols)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}"
    left_at = [spark_cols.index(c) for c in sorted(spark_cols)]
    right_at = [sql_cols.index(c) for c in sorted(sql_cols)]
    left = Counter(tuple(normal(r[i]) for i in left_at) for r in spark_rows)
    right = Counter(tuple(normal(r[i]) for i in right_at) for r in sql_rows)
    if left != right:
        only_left = list((left - right).items())[:3]
        only_right = list((right - left).items())[:3]
        return f"values differ ({sum((left - right).values())})\n   spark {only_left}\n   sql   {only_right}"
    return None


# Column types that say the same on both sides.
SAME_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "float": "FLOAT",
}


def type_notes(df, description):
    """Columns whose types differ between Spark and SQL."""
    sql = {d[0]: str(d[1]) for d in description}
    return [
        f"{name}: {kind} / {sql.get(name)}" for name, kind in df.dtypes if SAME_TYPES.get(kind, kind) != sql.get(name)
    ]


def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'").fetchall()
    return connection


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    queries, oracles = all_queries(), all_oracles()
    spark = local_session()
    connection = duck(sf_dir)
    bad = 0
    for name, query in queries.items():
        if names and name not in names:
            continue
        try:
            begin = time.time()
            df = query(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            seconds = time.time() - begin
            problem, took, notes = None, 0.0, []
            if name in oracles:
                begin = time.time()
                cursor = connection.execute(oracles[name])
                sql_cols = [d[0] for d in cursor.description]
                sql_rows = cursor.fetchall()
                took = time.time() - begin
                problem = compare(rows, df.columns, sql_rows, sql_cols)
                notes = type_notes(df, cursor.description)
            state = "FAIL " + problem if problem else ("ok" if name in oracles else "rows-only")
            state += f" types {notes}" if notes else ""
        except Exception as exc:  # noqa: BLE001 - a report tool
            connection = duck(sf_dir)
            rows, seconds, took, state = [], 0.0, 0.0, f"ERROR {type(exc).__name__}: {str(exc)[:700]}"
            problem = state
        bad += bool(problem)
        print(f"{name:24s} {len(rows):8d} rows {seconds:6.2f}s sql {took:5.2f}s {state}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
