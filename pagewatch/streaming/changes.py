"""The comparison as a stream: snapshots arrive as files, changes leave batch by batch.

Two queries share the work. `store_snapshots` reads the fields of arriving pages once and stores the versions.
`stream_changes` follows the stored versions and compares each with the one before it of its URL, which Spark's keyed state
holds: fields only, one version a URL, dropped when a URL has not been seen for the retention time. A batch thus reads
its own rows and the state of their URLs, however long the history is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pagewatch.functions.navigation import DEFAULT_NAV_RULES, NavRules
from pagewatch.operators.changes import compare_versions
from pagewatch.operators.extraction import extract_page_fields
from pagewatch.operators.versions import ORDER
from pagewatch.schemas import FIELD_COLUMNS, PAGE_VERSIONS

RECORD = (*ORDER, "snapshot_date", *FIELD_COLUMNS)
SNAPSHOTS = "url string, ts_key string, status_code int, html string"
DAY_MS = 24 * 60 * 60 * 1000
# Keyed state with a time limit needs the RocksDB store, and its timers would ask for empty batches without end.
STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def read_snapshots(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of Parquet files with url, ts_key, status_code and html."""
    return (
        spark.readStream.schema(SNAPSHOTS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def store_snapshots(
    snapshots: DataFrame, store: str, checkpoint: str, nav_rules: NavRules = DEFAULT_NAV_RULES
) -> StreamingQuery:
    """Start a query that reads the fields of arriving snapshots and stores them as versions.

    Every batch has its own folder and overwrites it, so a batch that is run
    again after a failure leaves the same rows once.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        extract_page_fields(batch, nav_rules).write.mode("overwrite").parquet(
            f"{store}/batch_id={batch_id}"
        )

    return (
        snapshots.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_stored(spark: SparkSession, store: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of the versions that `store_snapshots` has written."""
    return (
        spark.readStream.schema(f"{PAGE_VERSIONS}, batch_id bigint")
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(store)
    )


class Predecessors(StatefulProcessor):
    """Gives each version of a URL the version before it, and remembers the last one.

    A version that is not newer than the last one is late and has no
    predecessor; the last one itself, read again, is left out.
    """

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState(
            "last", "ts_key string, id bigint, record string", ttlDurationMs=self.days * DAY_MS
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        last = self.last.get() if self.last.exists() else None
        known = None if last is None else (last[0], last[1])
        old = None if last is None else last[2]
        arrived = sorted(
            (row for part in rows for row in zip(part["ts_key"], part["id"], part["record"])),
            key=lambda row: (row[0], row[1]),
        )
        out, newest = [], None
        for ts_key, number, record in arrived:
            place = (ts_key, number)
            if known is not None and place <= known:
                if place != known:
                    out.append((key[0], record, None, True))
                continue
            out.append((key[0], record, old, False))
            known, old, newest = place, record, (ts_key, int(number), record)
        if newest is not None:
            self.last.update(newest)
        yield pd.DataFrame(out, columns=["url", "new", "old", "late"])

    def close(self) -> None:
        pass


def stream_pairs(versions: DataFrame, days: int = 30) -> DataFrame:
    """Streamed versions as `new` with the version before them as `old`, and whether they came late.

    Records are passed through the state as JSON, so that it needs no schema of its own.
    """
    record = F.struct(*RECORD)
    kind = versions.select(record.alias("r")).schema["r"].dataType
    rows = versions.select("url", "ts_key", "id", F.to_json(record).alias("record"))
    pairs = rows.groupBy("url").transformWithStateInPandas(
        Predecessors(days), "url string, new string, old string, late boolean", "append", "ProcessingTime"
    )
    return pairs.select("url", F.from_json("new", kind).alias("new"), F.from_json("old", kind).alias("old"), "late")


def stream_changes(versions: DataFrame, out: str, checkpoint: str, days: int = 30) -> StreamingQuery:
    """Start a query that compares streamed versions with their predecessors.

    Comparisons are appended to `out`, late versions marked there; files of a
    batch that failed are not seen by readers.
    """
    compared = compare_versions(stream_pairs(versions, days), keep=("late",))
    writer = (
        compared.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    # A query keeps the settings that its session has when it starts.
    settings = versions.sparkSession.conf
    before = {name: settings.get(name, None) for name in STREAM_SETTINGS}
    try:
        for name, value in STREAM_SETTINGS.items():
            settings.set(name, value)
        return writer.start()
    finally:
        for name, value in before.items():
            settings.unset(name) if value is None else settings.set(name, value)


def on_time(compared: DataFrame) -> DataFrame:
    """Comparisons of versions that arrived in order."""
    return compared.filter("NOT late").drop("late")


def late_versions(compared: DataFrame) -> DataFrame:
    """Versions that arrived after a newer one of their URL."""
    return compared.filter("late").select("url", "new_version.*")
