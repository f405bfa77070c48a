"""Runs registered queries beside their SQL in DuckDB and compares the rows."""

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def compare(spark, con, run, sql, sf_dir):
    """An empty text if both give the same rows, else what differs."""
    df = run(spark, sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} against {names}"
    got = sorted((tuple(plain(r[n]) for n in sorted(names)) for r in df.collect()), key=repr)
    at = [names.index(n) for n in sorted(names)]
    rows = sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)
    if got != rows:
        bad = next((x for x in zip(got, rows) if x[0] != x[1]), None)
        return f"{len(got)} rows against {len(rows)}; first difference {bad}"
    return "" if rows else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = f"/root/testdata/{sys.argv[1]}"
    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(sf), entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [n for n in queries if n in sql]:
        t = time.time()
        try:
            print(name, compare(spark, con, queries[name], sql[name], sf) or "ok", round(time.time() - t, 1), flush=True)
        except Exception as e:
            print(name, "ERROR", str(e)[:400].replace("\n", " "), flush=True)
