"""Run every registered key in Spark and its oracle SQL in DuckDB and compare
row count, column names, column types and values (order-insensitive).

Usage: python tests/oracle_compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


_TYPE_NAMES = {
    "LongType()": "BIGINT",
    "IntegerType()": "INTEGER",
    "DoubleType()": "DOUBLE",
    "DecimalType(10,2)": "DECIMAL(10,2)",
    "StringType()": "VARCHAR",
    "DateType()": "DATE",
    "BooleanType()": "BOOLEAN",
    "TimestampNTZType()": "TIMESTAMP",
}


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if os.environ.get("ORACLE_EXACT") else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, sf_dir: str, key: str, con=None) -> dict:
    con = con or duck(sf_dir)
    sql = entry.oracle_sql().get(key)
    t0 = time.time()
    df = entry.queries()[key](spark, sf_dir)
    spark_rows = [tuple(r) for r in df.collect()]
    spark_cols = df.columns
    t1 = time.time()
    res = {"key": key, "spark_rows": len(spark_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    cur = con.execute(sql)
    duck_cols = [d[0] for d in cur.description]
    duck_rows = cur.fetchall()
    res["duck_rows"] = len(duck_rows)
    if sorted(spark_cols) != sorted(duck_cols):
        res["status"] = f"COLUMNS spark={sorted(spark_cols)} duck={sorted(duck_cols)}"
        return res
    duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    spark_types = {f.name: _TYPE_NAMES.get(repr(f.dataType), repr(f.dataType)) for f in df.schema.fields}
    if spark_types != duck_types:
        res["status"] = f"TYPES spark={spark_types} duck={duck_types}"
        return res
    a, b = _rows(spark_cols, spark_rows), _rows(duck_cols, duck_rows)
    if len(a) != len(b):
        res["status"] = "ROWCOUNT"
    elif a != b:
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["status"] = f"VALUES {diffs}"
    else:
        res["status"] = "ok"
    return res


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or list(entry.queries())
    from tidemark import build_session

    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    bad = 0
    for key in keys:
        try:
            r = compare(spark, sf_dir, key, con)
        except Exception as exc:  # noqa: BLE001
            r = {"key": key, "status": f"ERROR {type(exc).__name__}: {str(exc)[:400]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
