"""Differences between two versions of a page.

All differences of a pair are found inside its row, so after pairing there is
no further shuffle. Visible texts are not needed to find changes, only their
lengths; pairs that carry `text` give it as the values of a content change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewatch.functions.cached import build_once
from pagewatch.functions.navigation import link_changes
from pagewatch.functions.text import let, one_decimal, or_default, percent_difference
from pagewatch.operators.rows import unfold
from pagewatch.schemas import CHANGE_TYPE, LINK_CHANGES

CONTENT_THRESHOLD = 20.0
EMPTY_VALUE = "(empty)"

ROBOTS = "robotstxt"
CONTENT = "content"
FIELD_TYPES = ("title", "canonical", "h1")
NAV_TYPES = ("nav_removed", "nav_added", "nav_text_changed")
PAGE_TYPES = (CONTENT, *FIELD_TYPES, *NAV_TYPES)
ALL_TYPES = (ROBOTS, *PAGE_TYPES)


def _record(
    kind: str,
    message: Column | None = None,
    percent: Column | None = None,
    old: Column | None = None,
    new: Column | None = None,
    links: Column | None = None,
) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(kind).alias("type"),
        (null if message is None else message).cast("string").alias("message"),
        (null if percent is None else percent).cast("double").alias("percent_diff"),
        (null if old is None else old).cast("string").alias("old_value"),
        (null if new is None else new).cast("string").alias("new_value"),
        (null.cast(LINK_CHANGES) if links is None else links).alias("links"),
    ).cast(CHANGE_TYPE)


def _first_heading(page: Column) -> Column:
    return F.coalesce(F.try_element_at(page["h1"], F.lit(1)), F.lit(""))


def _robots_record(old: Column, new: Column) -> Column:
    percent = F.coalesce(
        percent_difference(old["text_length"], new["text_length"]), F.lit(100.0)
    )
    message = F.concat(
        F.lit("robots.txt content changed ("), one_decimal(percent), F.lit("% difference)")
    )
    return F.when(
        ~old["text_digest"].eqNullSafe(new["text_digest"]),
        _record(ROBOTS, message, percent, old["robots_text"], new["robots_text"]),
    )


def _content_record(old: Column, new: Column, threshold: float, with_texts: bool) -> Column:
    percent = percent_difference(old["text_length"], new["text_length"])
    message = F.concat(
        one_decimal(percent), F.lit("% of visible content difference vs previous version")
    )
    texts = (old["text"], new["text"]) if with_texts else (None, None)
    return F.when(percent > threshold, _record(CONTENT, message, percent, *texts))


def _field_record(kind: str, old: Column, new: Column) -> Column:
    return F.when(
        ~old.eqNullSafe(new),
        _record(kind, old=or_default(old, EMPTY_VALUE), new=or_default(new, EMPTY_VALUE)),
    )


def _nav_records(old: Column, new: Column, kinds: Sequence[str]) -> Column:
    def records(found: Column) -> Column:
        lists = {
            "nav_removed": found["removed"],
            "nav_added": found["added"],
            "nav_text_changed": found["text_changed"],
        }
        return F.array(
            *[F.when(F.size(lists[k]) > 0, _record(k, links=lists[k])) for k in kinds]
        )

    has_links = F.size(old["nav"]) + F.size(new["nav"]) > 0
    return F.when(has_links, let(link_changes(old["nav"], new["nav"]), records)).otherwise(
        F.array().cast(f"array<{CHANGE_TYPE}>")
    )


def _changes(pairs: DataFrame, kinds: Sequence[str], threshold: float) -> Column:
    """Array of the changes of a pair, in report order."""
    return _change_array(tuple(kinds), threshold, "text" in pairs.schema["new"].dataType.names)


@build_once
def _change_array(kinds: Sequence[str], threshold: float, with_texts: bool) -> Column:
    old, new = F.col("old"), F.col("new")
    wide: list[Column] = []
    if CONTENT in kinds:
        wide.append(_content_record(old, new, threshold, with_texts))
    if "title" in kinds:
        wide.append(_field_record("title", old["title"], new["title"]))
    if "canonical" in kinds:
        wide.append(_field_record("canonical", old["canonical"], new["canonical"]))
    if "h1" in kinds:
        wide.append(_field_record("h1", _first_heading(old), _first_heading(new)))
    nothing = F.array().cast(f"array<{CHANGE_TYPE}>")
    page = F.array(*wide) if wide else nothing
    nav_kinds = [k for k in NAV_TYPES if k in kinds]
    if nav_kinds:
        page = F.concat(page, _nav_records(old, new, nav_kinds))
    robots = nothing
    if ROBOTS in kinds:
        robots = F.array(_robots_record(old, new))
    found = F.when(old.isNull(), nothing).when(new["is_robots"], robots).otherwise(page)
    return F.filter(found, lambda c: c.isNotNull())


def compare_versions(
    pairs: DataFrame,
    threshold: float = CONTENT_THRESHOLD,
    kinds: Sequence[str] = ALL_TYPES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per pair: whether it is a first scrape, and its list of changes; with the columns `keep` of the pair.

    Values of a content change are whole texts if the pairs carry `text`, else null.
    """
    return pairs.select(
        "url",
        *keep,
        F.col("old").isNull().alias("first_scrape"),
        _changes(pairs, kinds, threshold).alias("changes"),
        _version_of("old").alias("old_version"),
        _version_of("new").alias("new_version"),
    )


def _version_of(side: str) -> Column:
    page = F.col(side)
    keys = F.struct(*[page[k].alias(k) for k in ("snapshot_date", "ts_key", "id")])
    return F.when(page.isNotNull(), keys)


def changed_only(comparisons: DataFrame) -> DataFrame:
    """Comparisons with at least one change."""
    return comparisons.filter(F.size("changes") > 0)


def change_rows(comparisons: DataFrame) -> DataFrame:
    """One row per change."""
    return unfold(comparisons, ["url"], "changes", "type")


def _changes_of(pairs: DataFrame, kinds: Sequence[str], threshold: float) -> DataFrame:
    return unfold(
        pairs.filter("old IS NOT NULL"), ["url"], _changes(pairs, kinds, threshold), "type"
    )


def robots_changes(pairs: DataFrame) -> DataFrame:
    """Whole old and new files; pairs of robots.txt versions alone are enough."""
    return _changes_of(pairs.filter("new.is_robots"), (ROBOTS,), CONTENT_THRESHOLD)


def content_changes(pairs: DataFrame, threshold: float = CONTENT_THRESHOLD) -> DataFrame:
    """Visible text grew or shrank by more than `threshold` percent; with both texts if the pairs carry them."""
    return _changes_of(pairs.filter("NOT new.is_robots"), (CONTENT,), threshold)


def field_changes(pairs: DataFrame, kinds: Sequence[str] = FIELD_TYPES) -> DataFrame:
    """Title, canonical address and first heading."""
    return _changes_of(pairs.filter("NOT new.is_robots"), kinds, CONTENT_THRESHOLD)


def nav_changes(pairs: DataFrame, kinds: Sequence[str] = NAV_TYPES) -> DataFrame:
    """Navigation links that were removed, added or got another text."""
    return _changes_of(pairs.filter("NOT new.is_robots"), kinds, CONTENT_THRESHOLD)


def major_changes(comparisons: DataFrame) -> DataFrame:
    """Pages whose visible content changed, with both texts; empty when there are none."""
    found = change_rows(comparisons).filter(F.col("type") == CONTENT)
    return found.select("url", F.col("old_value").alias("old_text"), F.col("new_value").alias("new_text"))


def line_diff(texts: DataFrame) -> DataFrame:
    """Removed and added part of texts that are one line each, such as visible text."""
    old, new = F.col("old_text"), F.col("new_text")

    def part(tag: str, value: Column, condition: Column) -> Column:
        return F.when(condition, F.struct(F.lit(tag).alias("part"), value.alias("value")))

    parts = F.array(
        part("common", new, (old == new) & (new != "")),
        part("removed", old, (old != new) & (old != "")),
        part("added", new, (old != new) & (new != "")),
    )
    return unfold(texts, ["url"], F.filter(parts, lambda p: p.isNotNull()), "part")


def multiline_diff(texts: DataFrame) -> DataFrame:
    """Lines of two texts tagged as removed, added or common.

    The n-th repeat of a line on one side belongs to its n-th repeat on the
    other. Numbering repeats and matching them share one distribution by url
    and line, hence one shuffle; lines that moved count as common.
    """
    def lines(side: str) -> DataFrame:
        text = F.col(f"{side}_text")
        split = F.split(F.regexp_replace(text, r"\r?\n\z", ""), "\r?\n")
        return texts.filter(text.isNotNull() & (text != "")).select(
            "url", F.lit(side).alias("side"), F.posexplode_outer(split).alias("pos", "line")
        )

    repeats = Window.partitionBy("url", "line", "side").orderBy("pos")
    numbered = (
        lines("old")
        .unionByName(lines("new"))
        .repartition("url", "line")
        .withColumn("occurrence", F.row_number().over(repeats))
    )
    matched = numbered.groupBy("url", "line", "occurrence").agg(
        F.min(F.when(F.col("side") == "old", F.col("pos"))).alias("old_pos"),
        F.min(F.when(F.col("side") == "new", F.col("pos"))).alias("new_pos"),
    )
    part = (
        F.when(F.col("new_pos").isNull(), F.lit("removed"))
        .when(F.col("old_pos").isNull(), F.lit("added"))
        .otherwise(F.lit("common"))
    )
    return matched.select(
        "url", part.alias("part"), F.col("line").alias("value"), "occurrence", "old_pos", "new_pos"
    )
