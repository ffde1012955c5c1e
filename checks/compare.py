"""Run registered queries on Spark and DuckDB and report differences.

    python -m checks.compare [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import statements
from checks.queries import registered

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(float(f"{value:.12g}"))
    return repr(value)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = sorted(tuple(_cell(row[i]) for i in order) for row in rows)
    return [columns[i] for i in order], cells


def differences(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str,
                name: str) -> tuple[int, str]:
    """Row count of the Spark result and a description of the mismatch, if any."""
    df = registered()[name](spark, sf_dir)
    ours = _table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(statements()[name])
    theirs = _table([d[0] for d in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return len(ours[1]), f"columns {sorted(set(ours[0]) ^ set(theirs[0]))}"
    if len(ours[1]) != len(theirs[1]):
        return len(ours[1]), f"{len(ours[1])} rows against {len(theirs[1])}"
    for a, b in zip(ours[1], theirs[1]):
        if a != b:
            cells = [(c, x, y) for c, x, y in zip(ours[0], a, b) if x != y]
            return len(ours[1]), f"values {cells[:4]}"
    return len(ours[1]), ""


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in args or registered():
        began = time.time()
        try:
            rows, problem = differences(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            rows, problem = -1, f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok':5}{name:28}{rows:7} rows"
              f"{time.time() - began:7.2f}s  {problem}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
