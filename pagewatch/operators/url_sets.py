"""Sets of URLs to monitor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_urls(listed: DataFrame, from_sitemaps: DataFrame) -> DataFrame:
    """Distinct URLs of both inputs, each at its first place; list entries come first.

    The minimum is pre-aggregated in every task, so a URL repeated very often
    still reaches the shuffle once per task.
    """
    both = listed.unionByName(from_sitemaps)
    return both.groupBy("url").agg(F.min("pos").alias("pos")).select("pos", "url")


def sample_urls(urls: DataFrame, k: int = 25, seed: int = 0) -> DataFrame:
    """`k` URLs at random; the same seed picks the same ones, in any engine that has MD5."""
    return urls.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("url"))), "url").limit(k)
