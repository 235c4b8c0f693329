"""Compare registered queries with their SQL: ``python -m tests.oracle_check [name …]``, SF_DIR optional."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from foliate.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (int, bool)):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return int(f) if f.is_integer() else float(f"{f:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(value(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, value(x)) for k, x in v.items()))
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, name, sf_dir):
    """(ok, message) of one query."""
    started = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = df.collect()
    took = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"rows only: {len(got)} ({took:.1f}s)"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(set(columns) ^ set(df.columns))}"
    a, b = rows(df.columns, got), rows(columns, expected)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:2] if len(a) < 200000 else []
        only_b = [x for x in b if x not in set(a)][:2] if len(b) < 200000 else []
        return False, f"{len(a)} vs {len(b)} rows {sorted(columns)}\n  spark {only_a}\n  sql   {only_b}"
    return True, f"{len(a)} rows ({took:.1f}s)"


def main():
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", "check", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in sys.argv[1:] or list(entry.queries()):
        try:
            ok, message = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, message = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, message, flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
