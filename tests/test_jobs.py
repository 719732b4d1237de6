"""Whole jobs: the store, a monitor run, the stream and the registered queries."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import derived as D
from checks.compare import differences, duck
from checks.oracle import ORACLES
from pagewatch.operators.changes import ALL_TYPES, change_rows
from pagewatch.operators.extraction import extract_page_fields
from pagewatch.operators.versions import retain
from pagewatch.plans.monitor import backfill_run, backfill_store, compare_run, monitor_run, remove_latest_run
from pagewatch.schemas import FETCH_ATTEMPTS
from pagewatch.sources.saved_pages import read_saved_pages
from pagewatch.sources.store import (
    append_to_table,
    append_versions,
    delete_versions,
    drop_expired_dates,
    expire_versions,
    read_versions,
    replace_dates,
    stored_dates,
)
from pagewatch.streaming.changes import late_versions, on_time, read_snapshots, read_stored, store_snapshots, stream_changes

HTML = "<html><head><title>{t}</title></head><body><h1>H</h1><p>{b}</p></body></html>"


def raw(spark, rows):
    return spark.createDataFrame(rows, "url string, ts_key string, html string")


def test_store_round_trip_and_partition_pruning(spark, tmp_path):
    path = str(tmp_path / "store")
    assert read_versions(spark, path).count() == 0
    rows = [("https://x.com/", f"2024010{d}000000", HTML.format(t=d, b="x")) for d in (1, 2, 3)]
    versions = extract_page_fields(raw(spark, rows))
    append_versions(versions, path)
    append_versions(extract_page_fields(raw(spark, [("https://y.com/", "20240104000000", None)])), path)
    stored = read_versions(spark, path)
    assert sorted(r.ts_key[:8] for r in stored.collect()) == [f"2024010{d}" for d in (1, 2, 3, 4)]
    kept = retain(stored, "2024-01-05 12:00:00", 3)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "snapshot_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(r.ts_key[:8] for r in kept.collect()) == ["20240103", "20240104"]
    assert replace_dates(spark, path, ["20240101", "20240102"], kept.filter("false"), str(tmp_path / "staging")) == 0
    assert stored_dates(spark, path) == ["20240103", "20240104"]


def keys(rows):
    return sorted((r.url[8], r.ts_key) for r in rows.collect())


def test_retention_and_removal_on_one_store(spark, tmp_path):
    path = str(tmp_path / "versions")
    rows = [(f"https://{u}.com/", f"2024010{d}{h}0000", HTML.format(t=d, b="x")) for u in "abc" for d in (1, 2, 3) for h in ("06", "18")]
    versions = extract_page_fields(raw(spark, rows))
    assert append_versions(versions.filter("snapshot_date < '20240103'"), path) == 12
    assert append_versions(versions.filter("snapshot_date = '20240103'"), path) == 6
    files = {d: sorted(p.name for p in (tmp_path / "versions" / f"snapshot_date=2024010{d}").glob("*.parquet")) for d in (2, 3)}
    assert expire_versions(spark, path, "20240102180000") == 9
    wanted = [(u, t) for u in "abc" for t in ("20240102180000", "20240103060000", "20240103180000")]
    assert keys(read_versions(spark, path)) == wanted and stored_dates(spark, path) == ["20240102", "20240103"]
    # The untouched date keeps its files, and the same again is no work.
    assert sorted(p.name for p in (tmp_path / "versions" / "snapshot_date=20240103").glob("*.parquet")) == files[3]
    assert expire_versions(spark, path, "20240102180000") == 0
    assert remove_latest_run(spark, str(tmp_path), "4", "monday") == 4
    left = [x for x in wanted if x[1] != "20240103180000" and x != ("a", "20240103060000")]
    assert keys(read_versions(spark, path)) == left
    assert remove_latest_run(spark, str(tmp_path), "4", "monday") == 0
    assert keys(read_versions(spark, path)) == left
    assert remove_latest_run(spark, str(tmp_path), 2, "tuesday") == 2 and stored_dates(spark, path) == ["20240102"]
    named = read_versions(spark, path).filter("url LIKE '%b%'")
    assert delete_versions(spark, path, named, "named") == 1
    assert keys(read_versions(spark, path)) == [("a", "20240102180000"), ("c", "20240102180000")]
    assert remove_latest_run(spark, str(tmp_path), 50, "rest") == 2 and read_versions(spark, path).count() == 0
    assert expire_versions(spark, str(tmp_path / "none"), "20240102180000") == 0


def test_expired_dates_are_dropped_from_a_table(spark):
    rows = [("https://x.com/", f"2024010{d}000000", HTML.format(t=d, b="x")) for d in (1, 2, 3)]
    append_to_table(extract_page_fields(raw(spark, rows)), "kept_pages")
    assert drop_expired_dates(spark, "kept_pages", "20240103120000") == ["20240101", "20240102"]
    assert [r.ts_key for r in spark.table("kept_pages").collect()] == ["20240103000000"]


def test_saved_files_are_loaded_once(spark, tmp_path):
    folder = tmp_path / "saved"
    folder.mkdir()
    for name in ("www_x_com__20240101000000.html", "www_x_com__20240102000000.html", "notes.html"):
        (folder / name).write_text(HTML.format(t=name, b="line 1\nline 2"))
    saved = read_saved_pages(spark, str(folder))
    assert backfill_store(spark, saved, str(tmp_path), "20240105") == 2
    assert backfill_store(spark, saved, str(tmp_path), "20240105") == 0
    stored = read_versions(spark, str(tmp_path / "versions"))
    assert {(r.url, r.text) for r in stored.collect()} == {("https://www.x.com", "Hline 1 line 2")}
    assert stored.count() == 2
    assert backfill_run(saved, stored, "20240105").count() == 0


def attempts(spark, rows):
    return spark.createDataFrame([(u, a, s, c, None) for u, a, s, c in rows], FETCH_ATTEMPTS)


def test_monitor_runs(spark, tmp_path):
    home = str(tmp_path)
    first = [("https://x.com/", 1, 200, HTML.format(t="A", b="y" * 2000)), ("https://bad.com/", 1, 403, "")]
    one = monitor_run(spark, attempts(spark, first), home, "20240101000000")
    assert one.subject.first().subject == "SEO Monitor - Critical Issues Found"
    assert [r.url for r in one.failures.collect()] == ["https://bad.com/"]
    assert [r.first_scrape for r in one.comparisons.collect()] == [True]
    assert one.major.count() == 0

    second = [("https://x.com/", 1, 500, ""), ("https://x.com/", 2, 200, HTML.format(t="B", b="y" * 4000)), ("https://new.com/", 1, 200, HTML.format(t="N", b="z" * 1000))]
    two = monitor_run(spark, attempts(spark, second), home, "20240102000000")
    assert sorted(r.url for r in two.pages.collect()) == ["https://new.com/", "https://x.com/"]
    assert two.failures.count() == 0
    found = change_rows(two.comparisons).select("url", "type").collect()
    assert sorted(r.type for r in found) == ["content", "title"] and {r.url for r in found} == {"https://x.com/"}
    assert [r.new_text for r in two.major.collect()] == ["H" + "y" * 4000]
    counts = two.counts.first()
    assert counts.source_changes == 1
    assert not two.flags.first().all_ok
    assert two.kept.count() == 3 and (one.inserted, two.inserted, two.deleted) == (1, 2, 0)

    again = monitor_run(spark, attempts(spark, second), home, "20240102000000")
    assert again.pages.count() == 2 and again.counts.first() == counts

    later = monitor_run(spark, attempts(spark, second[1:]), home, "20240201000000")
    assert sorted(r.ts_key for r in later.kept.collect()) == ["20240102000000"] * 2 + ["20240201000000"] * 2
    assert change_rows(later.comparisons).count() == 0 and (again.inserted, later.inserted, later.deleted) == (0, 2, 1)
    assert later.pages.count() == 2 and later.lines.count() > 0


def test_stream_gives_the_changes_of_batch_comparison(spark, tmp_path):
    """Ordered snapshots in several files; the last one brings a late version and one that is known already."""
    source, store, out = (str(tmp_path / x) for x in ("in", "store", "out"))
    days = {}
    for n, (url, day, title) in enumerate(
        [("a", 1, "A"), ("b", 1, "B"), ("a", 2, "A2"), ("a", 3, "A3"), ("b", 2, "B"), ("a", 4, "A3"), ("c", 4, "C")]
    ):
        days.setdefault((0, 0, 1, 1, 1, 2, 2)[n], []).append(
            (f"https://{url}.com/", f"2024010{day}000000", 200, HTML.format(t=title, b='x "quoted" \\ é'))
        )
    days[3] = [("https://a.com/", "20240102120000", 200, HTML.format(t="late", b="x")), days[2][1]]
    schema = "url string, ts_key string, status_code int, html string"
    read = []
    for batch in sorted(days):
        spark.createDataFrame(days[batch], schema).coalesce(1).write.mode("append").parquet(source)
        assert store_snapshots(read_snapshots(spark, source), store, str(tmp_path / "c1")).awaitTermination(120)
        query = stream_changes(read_stored(spark, store), out, str(tmp_path / "c2"))
        assert query.awaitTermination(120)
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
    # Each batch reads its own rows, whatever came before.
    assert read == [len(days[k]) for k in sorted(days)]
    compared = spark.read.parquet(out)
    found = on_time(compared)
    titles = [(r.url, r.old_value, r.new_value) for r in change_rows(found).collect()]
    assert sorted(titles) == [("https://a.com/", "A", "A2"), ("https://a.com/", "A2", "A3")]
    first = sorted(r.url for r in found.filter("first_scrape").collect())
    assert first == ["https://a.com/", "https://b.com/", "https://c.com/"]
    assert found.count() == 7
    assert [(r.url, r.ts_key) for r in late_versions(compared).collect()] == [("https://a.com/", "20240102120000")]
    stored = spark.read.parquet(store).dropDuplicates(["url", "ts_key"]).filter("ts_key <> '20240102120000'")
    newest = {r.url: r.old_value for r in change_rows(compare_run(stored)).collect()}
    assert newest == {}


def test_entry_and_contract(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["severity", "rule", "pages"] and rows.count() > 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    from checks.catalog import QUERIES
    from checks.oracle import ORACLES

    assert set(QUERIES) == set(ORACLES)


def test_derived_inputs_have_every_kind_of_change(spark):
    from checks.catalog import all_changes, issue_counts

    folder = "/root/testdata/sf0.01"
    assert {r.type for r in all_changes(spark, folder).select("type").distinct().collect()} == set(ALL_TYPES)
    assert issue_counts(spark, folder).count() == 9
    assert D.FETCH_ATTEMPTS.spark(spark, folder).select((F.col("i") % 8)).distinct().count() == 8


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, connection, sf_dir, name):
    assert differences(spark, connection, sf_dir, name, rows_needed=False) == ""
