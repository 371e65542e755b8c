"""Run registered queries on Spark and their SQL on DuckDB and compare.

    python tests/oracle.py [sf] [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import logging
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (dt.datetime, dt.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def _kind(value):
    return type(value).__name__


def compare(key, spark_df, con, sql):
    """None when equal, else a short description."""
    cols = spark_df.columns
    left = normal([tuple(r) for r in spark_df.collect()], cols)
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    right = normal(cur.fetchall(), dcols)
    if sorted(cols) != sorted(dcols):
        return f"columns {sorted(cols)} != {sorted(dcols)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"values\n   spark {str(a)[:600]}\n   duck  {str(b)[:600]}"
    if left:
        for a, b, c in zip(left[0], right[0], sorted(cols)):
            if a is not None and b is not None and _kind(a) != _kind(b):
                return f"type of {c}: {_kind(a)} != {_kind(b)}"
    types = dict(spark_df.dtypes)
    want = {"HUGEINT": "-", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    for d in con.execute(f"DESCRIBE {sql}").fetchall():
        expected = want.get(d[1])
        if expected is None or expected != types[d[0]]:
            return f"schema of {d[0]}: spark {types[d[0]]}, duck {d[1]}"
    return None if left else "EMPTY"


def main(argv):
    import __spark_entry__ as entry

    from tidemark.session import build_session

    sf = argv[0] if argv else "0.001"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false", spark__sql__legacy__createHiveTableByDefault="false")
    logging.disable(logging.CRITICAL)
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    keys = argv[1:] or list(queries)
    bad = 0
    for key in keys:
        t0 = time.time()
        try:
            if key in oracle:
                note = compare(key, queries[key](spark, sf_dir), con, oracle[key])
            else:
                n = len(queries[key](spark, sf_dir).collect())
                note = None if n else "EMPTY"
                print(f"   {key}: rows only, {n}")
        except Exception as e:  # noqa: BLE001
            note = f"{type(e).__name__}: {str(e)[:500]}"
        bad += note is not None
        print(f"{'ok  ' if note is None else 'FAIL'} {key} {time.time() - t0:.1f}s {note or ''}", flush=True)
    print("failures:", bad, "of", len(keys))


if __name__ == "__main__":
    main(sys.argv[1:])
