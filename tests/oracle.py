"""Holds registered queries against their DuckDB twins: python tests/oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):  # noqa: ANN001, ANN201
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def duck(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def differences(spark, sf_dir: str, run, sql: str) -> str:  # noqa: ANN001
    """Empty if the query and the SQL give the same rows of the same columns."""
    cols, rows = duck(sf_dir, sql)
    df = run(spark, sf_dir)
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(cols)}"
    order = sorted(cols)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in rows), key=repr)
    if got == want:
        return ""
    a, b = set(map(repr, got)), set(map(repr, want))
    return f"{len(got)} rows against {len(want)}; only Spark {sorted(a - b)[:3]}; only DuckDB {sorted(b - a)[:3]}"


def main(args: list[str]) -> int:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (root, os.environ.get("PYTHONPATH", "")) if x)
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle, bad = entry.queries(), entry.oracle_sql(), 0
    for name in args[1:] or oracle:
        t = time.time()
        try:
            said = differences(spark, args[0], queries[name], oracle[name])
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said)
        print(f"{name}: {time.time() - t:.1f} s {said or 'same'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
