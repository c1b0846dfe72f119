"""Run queries next to their SQL in DuckDB and report any difference.

    python -m checks.compare [--sf DIR] [name ...]
"""
from __future__ import annotations

import argparse
import time

import duckdb
import pandas as pd

from checks.oracles import ORACLES
from checks.queries import QUERIES
from tremorline.session import build_session

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages benchmark
    labels conversations""".split()


def _normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if pd.isna(v) else v for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def differences(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} != {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}"
    for ours, theirs in zip(_normal(spark_rows), _normal(sql_rows)):
        if ours != theirs:
            return f"{ours} != {theirs}"
    for name in spark_rows.columns:
        # pandas turns whole numbers with nulls into floats on one side only.
        if len(spark_rows) and not spark_rows[name].hasnans and spark_rows[name].dtype.kind != sql_rows[name].dtype.kind:
            return f"type of {name}: {spark_rows[name].dtype} != {sql_rows[name].dtype}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--cores", default="8")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("checks", f"local[{args.cores}]", **{
        "spark.sql.shuffle.partitions": args.cores, "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"create view {table} as select * from '{args.sf}/{table}.parquet'")
    failed = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            rows = QUERIES[name](spark, args.sf).toPandas()
            seconds = time.time() - start
            problem = differences(rows, db.sql(ORACLES[name]).df()) if name in ORACLES else None
        except Exception as error:  # a check tool reports every query
            rows, seconds, problem = [], time.time() - start, f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        verdict = problem or ("ok" if name in ORACLES else "rows only")
        print(f"{name:28s} {seconds:6.2f}s {len(rows):7d} {verdict}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
