"""Pages saved as HTML files whose names carry host and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.functions.times import snapshot_date, snapshot_ts, url_from_file_name


def read_saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its name and whole content."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("html")
    )


def saved_snapshots(saved_pages: DataFrame) -> DataFrame:
    """Add url, time key and date from the file name; files without a time are left out."""
    name = F.col("file_name")
    return (
        saved_pages.withColumn("ts_key", snapshot_ts(name))
        .filter(F.col("ts_key").isNotNull())
        .withColumn("url", url_from_file_name(name))
        .withColumn("snapshot_date", snapshot_date(F.col("ts_key")))
    )
