"""The version store: Parquet files of page versions, partitioned by snapshot date.

Monitor runs and backfills append to it; retention and rollback delete from it.
Dates are the unit of deletion: whole dates lose their folder, and a date that
loses some of its versions is written anew from a staged copy. Readers that
listed the files before a deletion should read the store again after it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pagewatch.schemas import PAGE_VERSIONS


def append_versions(versions: DataFrame, path: str, many_dates: bool = False) -> int:
    """Append page versions to the store; return their number.

    A run has one date, and every task writes one file. A backfill of many
    dates should set `many_dates`: rows are then gathered by date, large dates
    split over several tasks, so that tasks do not write a small file per date.
    """
    if many_dates:
        versions = versions.hint("rebalance", "snapshot_date")
    rows, seen = counted(versions)
    rows.write.mode("append").partitionBy("snapshot_date").parquet(path)
    return seen.get["n"]


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """All stored versions; an absent store reads as empty."""
    try:
        return spark.read.schema(PAGE_VERSIONS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PAGE_VERSIONS)


def append_to_table(versions: DataFrame, table: str, buckets: int | None = None) -> None:
    """Append page versions to a store kept as a managed catalog table.

    With `buckets`, versions of a URL lie in the same bucket of every date:
    pairing and comparing then need no shuffle, also of texts. The number must
    be the same for every append.
    """
    writer = versions.write.mode("append").partitionBy("snapshot_date").format("parquet")
    (writer if buckets is None else writer.bucketBy(buckets, "url")).saveAsTable(table)


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _folder(spark, path)
    return files.exists(place)


def _delete(spark: SparkSession, path: str) -> None:
    files, place = _folder(spark, path)
    files.delete(place, True)


def stored_dates(spark: SparkSession, path: str) -> list[str]:
    """Dates of the store, by its folders: one entry per day of history."""
    files, place = _folder(spark, path)
    if not files.exists(place):
        return []
    names = [entry.getPath().getName() for entry in files.listStatus(place) if entry.isDirectory()]
    return sorted(name.partition("=")[2] for name in names if name.startswith("snapshot_date="))


def counted(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """Rows whose number is known as `n` once they have been written, without a job of its own."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("n")), seen


def replace_dates(spark: SparkSession, path: str, dates: Sequence[str], kept: DataFrame, staging: str) -> int:
    """Replace the rows of whole dates by `kept`, which may be read from the store itself; return its number of rows.

    The rows are first written to `staging`, a new folder, then put in place
    date by date as Spark's dynamic overwrite commits them. Dates that keep no
    row lose their folder.
    """
    rows, seen = counted(kept)
    rows.write.mode("overwrite").partitionBy("snapshot_date").parquet(staging)
    left = stored_dates(spark, staging)
    if left:
        staged = spark.read.schema(PAGE_VERSIONS).parquet(staging)
        writer = staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("snapshot_date").parquet(path)
    for date in set(dates) - set(left):
        _delete(spark, f"{path}/snapshot_date={date}")
    _delete(spark, staging)
    return seen.get["n"]


def expire_versions(spark: SparkSession, path: str, cutoff_key: str) -> int:
    """Delete stored versions older than the cutoff (yyyyMMddHHmmss; equal stays); return their number.

    Whole dates lose their folder, and only the cutoff's own date is written
    anew, if it holds older versions. Running it again changes nothing.
    """
    cutoff_date = cutoff_key[:8]
    old = [date for date in stored_dates(spark, path) if date <= cutoff_date]
    if not old:
        return 0
    rows = read_versions(spark, path).filter(F.col("snapshot_date").isin(old))
    older = rows.filter(F.col("ts_key") < cutoff_key)
    doomed = {r["snapshot_date"]: r["n"] for r in older.groupBy("snapshot_date").agg(F.count("*").alias("n")).collect()}
    for date in old:
        if date < cutoff_date:
            _delete(spark, f"{path}/snapshot_date={date}")
    if cutoff_date in doomed:
        kept = rows.filter((F.col("snapshot_date") == cutoff_date) & (F.col("ts_key") >= cutoff_key))
        replace_dates(spark, path, [cutoff_date], kept, f"{path}-staging/{uuid.uuid4().hex}")
    return sum(doomed.values())


def delete_versions(spark: SparkSession, path: str, doomed: DataFrame, request: str) -> int:
    """Delete the versions that `doomed` (snapshot_date, url, ts_key, id) names; return their number.

    The keys are written once under the name of the request and read from
    there, so a request that was cut short can be run again and a finished one
    changes nothing more. Only dates with a key are written anew; a key names
    a row, and Spark broadcasts keys that turn out small.
    """
    keys_path = f"{path}-deletions/{request}"
    if not exists(spark, f"{keys_path}/_SUCCESS"):
        keys = doomed.select("snapshot_date", "url", "ts_key", "id").distinct()
        keys.write.mode("overwrite").parquet(keys_path)
    keys = spark.read.schema("snapshot_date string, url string, ts_key string, id bigint").parquet(keys_path)
    stored = set(stored_dates(spark, path))
    dates = sorted(stored & {r["snapshot_date"] for r in keys.select("snapshot_date").distinct().collect()})
    if not dates:
        return 0
    rows = read_versions(spark, path).filter(F.col("snapshot_date").isin(dates))
    hit = rows.select("snapshot_date", "url", "ts_key", "id").join(keys, ["snapshot_date", "url", "ts_key", "id"], "left_semi").groupBy("snapshot_date").agg(F.count("*").alias("n"))
    hits = {r["snapshot_date"]: r["n"] for r in hit.collect()}
    if not hits:
        return 0
    kept = rows.filter(F.col("snapshot_date").isin(list(hits))).join(keys, ["snapshot_date", "url", "ts_key", "id"], "left_anti")
    replace_dates(spark, path, list(hits), kept, f"{path}-staging/{uuid.uuid4().hex}")
    return sum(hits.values())


def drop_expired_dates(spark: SparkSession, table: str, cutoff_key: str) -> list[str]:
    """Drop all partitions of a store table dated before the cutoff's date; return their dates.

    Works on the catalog's partition list, one entry per day of history, and
    reads no data.
    """
    name = ".".join(f"`{part.replace('`', '``')}`" for part in table.split("."))
    dates = (
        spark.sql(f"SHOW PARTITIONS {name}")
        .select(F.split_part("partition", F.lit("="), F.lit(2)).alias("date"))
        .filter(F.col("date") < cutoff_key[:8])
        .orderBy("date")
        .collect()
    )
    for row in dates:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (snapshot_date=:date)", {"date": row.date})
    return [row.date for row in dates]
