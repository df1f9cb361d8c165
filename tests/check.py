"""Side-by-side check of the registered queries with their SQL in DuckDB: python tests/check.py SF_DIR [name ...]"""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, [tuple(norm(v) for v in r) for r in df.select(*cols).collect()]


def sql_rows(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]


def key(row):
    return tuple((v is None, str(v)) for v in row)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None):
    cols, got = spark_rows(fn(spark, sf_dir))
    if sql is None:
        return len(got), None
    ecols, exp = sql_rows(con, sql)
    if cols != ecols:
        return len(got), f"columns {cols} vs {ecols}"
    got, exp = sorted(got, key=key), sorted(exp, key=key)
    if got != exp:
        gs, es = set(got), set(exp)
        return len(got), (f"{cols}\n  rows {len(got)} vs {len(exp)}\n  only spark {sorted(gs - es, key=key)[:4]}"
                          f"\n  only sql   {sorted(es - gs, key=key)[:4]}")
    return len(got), None


def main():
    from pyspark.sql import SparkSession

    from slipway.plans.catalog import QUERIES, SQL

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config(
        "spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name, fn in QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            n, error = compare(spark, con, sf_dir, name, fn, SQL.get(name))
        except Exception:
            n, error = -1, traceback.format_exc(limit=2)[-1500:]
        bad += error is not None
        print(f"{'FAIL' if error else 'ok  '} {name} rows={n} {time.time() - start:.1f}s"
              f"{'' if name in SQL else ' (rows only)'} {error or ''}", flush=True)
    print(f"{bad} failures")


if __name__ == "__main__":
    main()
