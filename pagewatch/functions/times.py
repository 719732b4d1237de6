"""Snapshot keys: 14-digit UTC times, their dates, and names of saved files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

TS_KEY_FORMAT = "yyyyMMddHHmmss"
SAVED_FILE = r"__([0-9]{14})\.html\z"


def ts_key(ts: Column) -> Column:
    """Time as yyyyMMddHHmmss text, whose order is time order (session zone UTC)."""
    return F.date_format(ts, TS_KEY_FORMAT)


def snapshot_date(key: Column) -> Column:
    return F.substring(key, 1, 8)


def snapshot_ts(file_name: Column) -> Column:
    """Timestamp key at the end of a saved file's name, null without one."""
    return F.nullif(F.regexp_extract(file_name, SAVED_FILE, 1), F.lit(""))


def url_from_file_name(file_name: Column) -> Column:
    """Host coded in a saved file's name, as an https URL; paths are not in the name."""
    host = F.replace(F.split_part(file_name, F.lit("__"), F.lit(1)), F.lit("_"), F.lit("."))
    return F.concat(F.lit("https://"), host)


def minus_days(now: Column | dt.datetime | str, days: int) -> Column:
    """`now` less whole days; `now` may be a column, a datetime or a timestamp text."""
    if isinstance(now, str):
        now = dt.datetime.fromisoformat(now)
    if isinstance(now, dt.datetime):
        if now.tzinfo is not None:
            now = now.astimezone(dt.timezone.utc).replace(tzinfo=None)
        now = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    return now - F.make_dt_interval(F.lit(days))


def retention_cutoff(now: Column | dt.datetime | str, days: int = 30) -> Column:
    """Oldest timestamp key that is kept."""
    return ts_key(minus_days(now, days))
