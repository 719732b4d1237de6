"""Run registered queries next to their SQL: `python -m checks.compare SF_DIR [name ...]`."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.catalog import QUERIES
from checks.oracle import ORACLES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagewatch-checks")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, connection, sf_dir: str, name: str, rows_needed: bool = True) -> str:
    """Empty if both engines agree, else what differs first."""
    frame = QUERIES[name](spark, sf_dir)
    ours = _rows(frame.columns, frame.collect())
    if name not in ORACLES:
        return "" if ours else "no rows"
    result = connection.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    theirs = _rows(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} / {sorted(columns)}"
    if ours == theirs:
        return "" if ours or not rows_needed else "no rows"
    left = [r for r in ours if r not in set(theirs)][:2]
    right = [r for r in theirs if r not in set(ours)][:2]
    return f"{len(ours)} / {len(theirs)} rows\n   spark {left}\n   duckdb {right}"


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, connection = session(), duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            found = differences(spark, connection, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s {found}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
