"""Which fetch attempts are usable, and which attempt stands for a URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewatch.functions.text import is_blank, utf16_length

MIN_CONTENT_LENGTH = 1000
ERROR_SCAN_LENGTH = 5000

# Reasons and messages as they appear in reports.
EMPTY = "Empty content"
TOO_SHORT = "Content too short (less than 1000 characters)"
NO_STRUCTURE = "Missing basic HTML structure (html/head/body tags)"
ERROR_WORDS = "Page contains error indicators"
FORBIDDEN = "403 Forbidden after retries"
INVALID_PREFIX = "Invalid content after {n} retries: "
ERROR_PATTERN = "(?i)error|blocked|captcha|access denied"


def is_robots(url: Column) -> Column:
    return F.coalesce(url.contains("robots.txt"), F.lit(False))


def content_problem(html: Column, url: Column) -> Column:
    """Why content is unusable, null if it is fine; cheap tests come first."""
    head = F.substring(html, 1, ERROR_SCAN_LENGTH)
    structured = (
        html.rlike("(?i)<html[^>]*>") & html.rlike("(?i)<head[^>]*>") & html.rlike("(?i)<body[^>]*>")
    )
    return (
        F.when(is_blank(html), F.lit(EMPTY))
        .when(utf16_length(html) < MIN_CONTENT_LENGTH, F.lit(TOO_SHORT))
        .when(is_robots(url), F.lit(None).cast("string"))
        .when(~structured, F.lit(NO_STRUCTURE))
        .when(head.rlike(ERROR_PATTERN), F.lit(ERROR_WORDS))
    )


def content_verdict(html: Column, url: Column) -> Column:
    reason = content_problem(html, url)
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"))


def attempt_verdict(attempts: DataFrame, max_retries: int = 3) -> DataFrame:
    """Add `valid` and `reason` to attempts: fetch error, then 403, then content."""
    prefix = INVALID_PREFIX.format(n=max_retries)
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("status_code") == 403, F.lit(FORBIDDEN))
        .otherwise(F.concat(F.lit(prefix), content_problem(F.col("content"), F.col("url"))))
    )
    return attempts.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def resolve_fetches(attempts: DataFrame, max_retries: int = 3) -> DataFrame:
    """One result per URL: its first valid attempt, else the reason of its last one.

    Ordering valid attempts forwards and, behind them, failed ones backwards
    puts the wanted row first in either case. Asking for that first row only
    lets Spark cut each URL to one row per task before the shuffle, so pages
    of attempts that lose are never sent and a hot URL cannot pile up.
    """
    judged = attempt_verdict(attempts.filter(F.col("attempt") <= max_retries), max_retries)
    slim = judged.select(
        "url",
        "attempt",
        "valid",
        F.nullif("status_code", F.lit(0)).alias("status_code"),
        F.when(F.col("valid"), F.col("content")).alias("html"),
        F.col("reason").alias("error"),
    )
    order = F.when(F.col("valid"), F.col("attempt")).otherwise(-F.col("attempt"))
    best = Window.partitionBy("url").orderBy(
        F.col("valid").desc(), order, F.col("status_code"), F.col("error"), F.xxhash64("html")
    )
    return (
        slim.withColumn("place", F.row_number().over(best))
        .filter("place = 1")
        .select("url", F.col("valid").alias("ok"), "status_code", "html", "error", "attempt")
    )


def split_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successful pages and failed URLs."""
    pages = results.filter("ok").select("url", "status_code", "html")
    failures = results.filter("NOT ok").select("url", "error")
    return pages, failures


def attempt_stats(attempts: DataFrame, max_retries: int = 3) -> DataFrame:
    """Number of attempts per attempt number and outcome."""
    judged = attempt_verdict(attempts.filter(F.col("attempt") <= max_retries), max_retries)
    outcome = F.coalesce(F.col("reason"), F.lit("ok"))
    return judged.groupBy("attempt", outcome.alias("outcome")).agg(F.count("*").alias("attempts"))
