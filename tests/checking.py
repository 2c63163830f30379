"""Compare registered queries with their SQL: ``python tests/checking.py [dir] [names]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def differences(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when both results have the same columns and rows."""
    names = sorted(df.columns)
    cursor = connection.execute(sql)
    theirs = [c[0] for c in cursor.description]
    if sorted(theirs) != names:
        return f"columns {names} != {sorted(theirs)}"
    order = [theirs.index(n) for n in names]
    expected = sorted((tuple(row[i] for i in order) for row in cursor.fetchall()), key=repr)
    got = sorted((tuple(row) for row in df.select(*names).collect()), key=repr)
    if got == expected:
        return ""
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}"
    pairs = [(g, e) for g, e in zip(got, expected) if g != e]
    return f"{len(pairs)} of {len(got)} rows differ, first {str(pairs[0][0])[:300]} != {str(pairs[0][1])[:300]}"


if __name__ == "__main__":
    import __spark_entry__ as contract

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(contract.oracle_sql())
    spark = session()
    connection = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = contract.queries()[name](spark, sf_dir)
            wrong = differences(df, connection, contract.oracle_sql()[name])
        except Exception as error:
            wrong = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(wrong)
        print(f"{'FAIL' if wrong else 'ok  '} {name} {time.time() - start:.2f}s {wrong}", flush=True)
    missing = set(contract.queries()) - set(contract.oracle_sql())
    print("failed", failed, "without SQL", sorted(missing))
