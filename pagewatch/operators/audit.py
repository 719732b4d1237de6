"""The nine audit rules, evaluated inside each page's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.functions.cached import build_once
from pagewatch.functions.text import utf16_length
from pagewatch.operators.rows import unfold
from pagewatch.schemas import ISSUE_TYPE

MAX_TITLE_LENGTH = 60
MAX_DESCRIPTION_LENGTH = 160
CRITICAL = "critical"
MINOR = "minor"


def _rules() -> list[tuple[str, str, Column, Column]]:
    """Severity, rule, condition and message; the order is the one of report lines."""
    status, title, canonical = F.col("status_code"), F.col("title"), F.col("canonical")
    title_length = utf16_length(title)
    bad_status = F.coalesce((status != 0) & (status != 200), F.lit(False))
    no_canonical = F.coalesce(canonical == "", F.lit(True))
    long_description = utf16_length(F.col("meta_description")) > MAX_DESCRIPTION_LENGTH
    # Rule messages as they appear in reports.
    return [
        (
            CRITICAL,
            "http_status",
            bad_status,
            F.concat(F.lit("HTTP Status: "), status.cast("string"), F.lit(" (expected 200)")),
        ),
        (CRITICAL, "title_missing", ~F.col("has_title"), F.lit("Missing or invalid Title")),
        (
            MINOR,
            "title_long",
            F.col("has_title") & (title_length > MAX_TITLE_LENGTH),
            F.concat(
                F.lit("Title too long ("),
                title_length.cast("string"),
                F.lit(' chars): "'),
                title,
                F.lit('"'),
            ),
        ),
        (CRITICAL, "canonical_missing", no_canonical, F.lit("Canonical tag missing")),
        (
            MINOR,
            "canonical_not_self",
            ~no_canonical & ~F.col("is_canonical_self_ref"),
            F.concat(
                F.lit("Canonical not self-referencing (points to: "), canonical, F.lit(")")
            ),
        ),
        (
            CRITICAL,
            "h1_missing",
            ~F.col("has_h1") & ~F.col("multiple_h1s"),
            F.lit("No H1 tag found"),
        ),
        (MINOR, "meta_missing", ~F.col("has_meta_description"), F.lit("Meta description missing")),
        (
            MINOR,
            "meta_long",
            F.col("has_meta_description") & long_description,
            F.lit("Meta description longer than 160 characters"),
        ),
        (MINOR, "h1_multiple", F.col("multiple_h1s"), F.lit("Multiple H1 tags found")),
    ]


RULES = (
    "http_status",
    "title_missing",
    "title_long",
    "canonical_missing",
    "canonical_not_self",
    "h1_missing",
    "meta_missing",
    "meta_long",
    "h1_multiple",
)


def audit_pages(pages: DataFrame) -> DataFrame:
    """Each page's url with the array of its issues; robots.txt pages have none."""
    return pages.select("url", _issue_array().alias("issues"))


@build_once
def _issue_array() -> Column:
    found = [
        F.when(
            condition,
            F.struct(
                F.lit(number).alias("rule_no"),
                F.lit(severity).alias("severity"),
                F.lit(rule).alias("rule"),
                message.alias("message"),
            ),
        )
        for number, (severity, rule, condition, message) in enumerate(_rules(), start=1)
    ]
    issues = F.filter(F.array(*found), lambda i: i.isNotNull())
    nothing = F.array().cast(f"array<{ISSUE_TYPE}>")
    return F.when(F.col("is_robots"), nothing).otherwise(issues)


def issue_rows(audited: DataFrame) -> DataFrame:
    """One row per page and broken rule."""
    return unfold(audited, ["url"], "issues", "rule")


def audit(pages: DataFrame) -> DataFrame:
    return issue_rows(audit_pages(pages))
