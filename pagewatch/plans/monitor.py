"""The complete jobs on one store: a monitor run, the backfill of saved pages, and the removal of the latest entries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.functions.navigation import DEFAULT_NAV_RULES, NavRules
from pagewatch.operators.audit import audit_pages, issue_rows
from pagewatch.operators.changes import change_rows, compare_versions, major_changes
from pagewatch.operators.extraction import extract_page_fields
from pagewatch.operators.fetches import resolve_fetches, split_results
from pagewatch.operators.report import (
    report_flags,
    report_lines,
    report_subject,
    summary_counts,
)
from pagewatch.operators.versions import PAIR_FIELDS, backfill, exclude_date, newest, version_pairs
from pagewatch.sources.saved_pages import saved_snapshots
from pagewatch.sources.store import append_versions, delete_versions, expire_versions, read_versions


def compare_run(
    versions: DataFrame, run_urls: DataFrame | None = None, fields: Sequence[str] | None = None
) -> DataFrame:
    """Compare the newest two versions of every URL of a run; the values of changes are whole.

    Pages are read once: the texts of the newest two versions of a URL travel
    with its other fields, in the one shuffle by URL. On a store bucketed by URL there is none.
    """
    return compare_versions(version_pairs(versions, run_urls, [*(fields or PAIR_FIELDS), "text"]))


@dataclass(frozen=True)
class MonitorRun:
    """Tables of one run; all read what the run has written and repeat none of its work."""

    pages: DataFrame
    failures: DataFrame
    comparisons: DataFrame
    major: DataFrame
    counts: DataFrame
    lines: DataFrame
    subject: DataFrame
    flags: DataFrame
    kept: DataFrame
    inserted: int
    deleted: int


def _write_once(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    schema = rows.schema
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def monitor_run(
    spark: SparkSession,
    attempts: DataFrame,
    home: str,
    run_key: str,
    nav_rules: NavRules = DEFAULT_NAV_RULES,
    max_retries: int = 3,
    retention_days: int = 30,
) -> MonitorRun:
    """Resolve fetches, store the pages, compare them and report.

    `run_key` is the run's time as yyyyMMddHHmmss; `home` is a folder all
    executors share. Versions, failures and comparisons are each written once
    and read back, so parsing is never repeated and a lost executor costs only
    the tasks it held. A run that was cut short may be started again: pages it
    has stored already are not stored twice, the rest is overwritten. At the
    end versions older than `retention_days` are deleted from the store;
    `kept` is what it holds then, `inserted` and `deleted` count the rows.
    """
    store = f"{home}/versions"
    run_date = F.lit(run_key[:8])

    def stored_pages(versions: DataFrame) -> DataFrame:
        of_run = (F.col("snapshot_date") == run_date) & (F.col("ts_key") == run_key)
        return versions.filter(of_run)

    resolved = _write_once(spark, resolve_fetches(attempts, max_retries), f"{home}/fetches/run_key={run_key}")
    fetched, failed = split_results(resolved)
    missing = fetched.join(
        stored_pages(read_versions(spark, store)).select("url"), "url", "left_anti"
    )
    inserted = append_versions(
        extract_page_fields(missing.withColumn("ts_key", F.lit(run_key)), nav_rules), store
    )
    failures = _write_once(spark, failed, f"{home}/failures/run_key={run_key}")

    stored = read_versions(spark, store)
    pages = stored_pages(stored)
    comparisons = _write_once(
        spark,
        compare_run(stored, pages.select("url")),
        f"{home}/comparisons/run_key={run_key}",
    )
    audited = audit_pages(pages)
    changes, issues = change_rows(comparisons), issue_rows(audited)
    lines = report_lines(audited, comparisons, failures)
    cutoff = dt.datetime.strptime(run_key, "%Y%m%d%H%M%S") - dt.timedelta(days=retention_days)
    deleted = expire_versions(spark, store, cutoff.strftime("%Y%m%d%H%M%S"))
    return MonitorRun(
        pages=pages,
        failures=failures,
        comparisons=comparisons,
        major=major_changes(comparisons),
        counts=summary_counts(issues, changes, failures),
        lines=lines,
        subject=report_subject(lines),
        flags=report_flags(issues, changes, failures, comparisons),
        kept=read_versions(spark, store),
        inserted=inserted,
        deleted=deleted,
    )


def backfill_run(
    saved_pages: DataFrame, existing: DataFrame, today: str, nav_rules: NavRules = DEFAULT_NAV_RULES
) -> DataFrame:
    """New page versions out of saved files; `today` (yyyyMMdd) is left to the monitor."""
    snapshots = exclude_date(saved_snapshots(saved_pages), today)
    fresh = backfill(existing, snapshots)
    return extract_page_fields(fresh.drop("file_name"), nav_rules, backfill=True)


def backfill_store(
    spark: SparkSession,
    saved_pages: DataFrame,
    home: str,
    today: str,
    nav_rules: NavRules = DEFAULT_NAV_RULES,
) -> int:
    """Insert saved pages that the store of `home` doesn't hold yet; return their number. Running it again inserts nothing."""
    store = f"{home}/versions"
    fresh = backfill_run(saved_pages, read_versions(spark, store), today, nav_rules)
    return append_versions(fresh, store, many_dates=True)


def remove_latest_run(spark: SparkSession, home: str, n: int | str, request: str) -> int:
    """Delete the `n` newest versions of the store of `home`; return their number.

    `request` names this removal: running it again under the same name finishes it, or does nothing more.
    """
    store = f"{home}/versions"
    keys = read_versions(spark, store).select("snapshot_date", "url", "ts_key", "id")
    return delete_versions(spark, store, newest(keys, n), request)
