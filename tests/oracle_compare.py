"""Compare ``queries()`` with ``oracle_sql()`` the way the driver does.

Row count, column names (sorted) and an order-insensitive hash of the values.
Usable from pytest and as a script: ``python tests/oracle_compare.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256()
    for line in lines:
        h.update(line.encode())
        h.update(b"\n")
    return h.hexdigest()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    import __spark_entry__ as entry

    con = con or duck(sf_dir)
    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    spark_cols = list(df.columns)
    spark_rows = [tuple(r) for r in df.collect()]
    spark_sec = time.time() - t0
    out = {"name": name, "spark_rows": len(spark_rows), "spark_sec": round(spark_sec, 2)}
    sql = entry.oracle_sql().get(name)
    if sql is None:
        out["oracle"] = None
        return out
    res = con.execute(sql)
    duck_cols = [d[0] for d in res.description]
    duck_rows = res.fetchall()
    out.update(
        oracle_rows=len(duck_rows),
        columns_match=sorted(spark_cols) == sorted(duck_cols),
        values_match=_digest(spark_cols, spark_rows) == _digest(duck_cols, duck_rows),
    )
    out["ok"] = out["columns_match"] and out["values_match"] and out["spark_rows"] == out["oracle_rows"]
    if not out["columns_match"]:
        out["columns"] = (sorted(spark_cols), sorted(duck_cols))
    return out


def main(argv):
    from pyspark.sql import SparkSession

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    names = argv[2:] or list(entry.queries())
    con = duck(sf_dir)
    bad = 0
    for name in names:
        try:
            res = compare(spark, name, sf_dir, con)
        except Exception as e:  # report and go on
            res = {"name": name, "error": f"{type(e).__name__}: {str(e)[:300]}"}
        if not res.get("ok"):
            bad += 1
        print(res, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
