"""Page versions out of raw pages: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.functions import markup as M
from pagewatch.functions.cached import build_once
from pagewatch.functions.navigation import DEFAULT_NAV_RULES, NavRules, nav_links_of
from pagewatch.functions.text import utf16_length, ws_trim
from pagewatch.functions.times import snapshot_date
from pagewatch.operators.fetches import is_robots


@build_once
def _parsed_columns(
    nav_rules: NavRules, homepage_only: bool
) -> dict[str, Column]:
    """Fields read from `markup` and `html`."""
    html, markup = F.col("html"), F.col("markup")
    raw_text = ws_trim(F.coalesce(html, F.lit("")))
    return {
        "title": M.title_of(markup),
        "canonical": M.canonical_of(markup),
        "meta_description": M.meta_description_of(markup),
        "h1": M.h1_texts_of(markup),
        "text": F.when(F.col("is_robots"), raw_text).otherwise(
            M.visible_text_of(markup)
        ),
        "nav": nav_links_of(markup, F.col("url"), nav_rules, homepage_only),
    }


@build_once
def _judged_columns(backfill: bool) -> dict[str, Column]:
    """Flags and measures of the parsed fields."""
    text = F.col("text")
    return {
        "has_title": M.has_title(F.col("title"), any_scheme=backfill),
        "is_canonical_self_ref": M.canonical_self_ref(
            F.col("canonical"), F.col("url"), strip_slash=not backfill
        ),
        "has_meta_description": M.has_meta_description(
            F.col("meta_description"), 160 if backfill else None
        ),
        "has_h1": M.has_h1(F.col("h1")),
        "multiple_h1s": M.multiple_h1s(F.col("h1")),
        "text_length": utf16_length(text),
        "text_digest": F.when(F.col("is_robots"), F.sha2(text, 256)),
        "robots_text": F.when(F.col("is_robots"), text),
    }


def extract_page_fields(
    pages: DataFrame,
    nav_rules: NavRules = DEFAULT_NAV_RULES,
    homepage_only: bool = True,
    backfill: bool = False,
) -> DataFrame:
    """Read all audited fields from `html`.

    Needs url, ts_key and html, and keeps other columns; a missing status_code
    becomes null and a missing id is derived from the row. `text` is what
    comparisons look at: the raw file for robots.txt, the visible text
    otherwise. `backfill` applies the stricter rules of loaded files: titles
    with any scheme are no titles, descriptions are limited to 160 characters,
    and self references must match to the last slash.
    """
    rows = pages
    if "status_code" not in rows.columns:
        rows = rows.withColumn("status_code", F.lit(None).cast("int"))
    if "id" not in rows.columns:
        rows = rows.withColumn("id", F.xxhash64("url", "ts_key", "html"))
    rules = tuple(tuple(rule) for rule in nav_rules)
    return (
        rows.withColumns(
            {
                "status_code": F.nullif("status_code", F.lit(0)),
                "snapshot_date": snapshot_date(F.col("ts_key")),
                "is_robots": is_robots(F.col("url")),
                "markup": M.page_markup(F.col("html")),
            }
        )
        .withColumns(_parsed_columns(rules, homepage_only))
        .withColumns(_judged_columns(backfill))
        .drop("markup")
    )
