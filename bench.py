"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the cores. Every query
runs once to warm up, then the best of two runs counts, results discarded.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks.catalog import QUERIES

HEADLINE = (
    "visible_texts",
    "page_fields",
    "nav_links",
    "audit_issues",
    "issue_counts",
    "latest_pages",
    "latest_events",
    "page_pairs",
    "all_changes",
    "run_comparisons",
    "major_changes",
    "multiline_diff",
    "content_verdicts",
    "resolved_fetches",
    "merged_urls",
    "sitemap_urls",
    "backfilled_pages",
    "retained_events",
    "remaining_events",
    "summary_counts",
    "report_lines",
    "report_subject",
)
RUNS = 2


def session() -> SparkSession:
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagewatch-bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("pagewatch.input.partitions", cores)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    timings = {}
    for name in HEADLINE:
        seconds(spark, name, sf_dir)
        timings[name] = round(min(seconds(spark, name, sf_dir) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(os.path.normpath(sf_dir)),
                "cores": spark.sparkContext.defaultParallelism,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
