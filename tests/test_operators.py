"""Operators on small tables, with one row per branch and brute-force expectations."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pagewatch.operators import audit as A
from pagewatch.operators import changes as C
from pagewatch.operators import fetches as FE
from pagewatch.operators import report as R
from pagewatch.operators import url_sets as US
from pagewatch.operators import versions as V
from pagewatch.operators.extraction import extract_page_fields
from pagewatch.plans.monitor import backfill_run, compare_run
from pagewatch.schemas import FETCH_ATTEMPTS
from pagewatch.sources.sitemaps import sitemap_urls
from pagewatch.sources.store import append_to_table
from pagewatch.sources.url_lists import limit_urls, read_url_list, url_list_lines

RAW = "id bigint, url string, ts_key string, status_code int, html string"


def page(body="text " * 40, title="A title", canonical=None, description="d", h1="<h1>H</h1>", nav=""):
    link = "" if canonical is None else f'<link rel="canonical" href="{canonical}">'
    meta = "" if description is None else f'<meta name="description" content="{description}">'
    return (
        f"<html><head><title>{title}</title>{link}{meta}</head>"
        f"<body>{nav}{h1}<p>{body}</p></body></html>"
    )


def versions(spark, *rows, rules=(("", "nav"),)):
    """Rows of (url, ts_key, html[, status])."""
    data = [(i, r[0], r[1], r[3] if len(r) > 3 else 200, r[2]) for i, r in enumerate(rows)]
    return extract_page_fields(spark.createDataFrame(data, RAW), rules)


def changes(spark, old, new, url="https://x.com/"):
    rows = versions(spark, (url, "1", old), (url, "2", new))
    return C.change_rows(compare_run(rows)).collect()


# URL sets


def test_url_list_file_keeps_order_and_drops_blanks(spark, tmp_path):
    path = tmp_path / "urls.txt"
    names = [f"https://x.com/{i}" for i in range(500)]
    path.write_bytes(("\r\n \n".join(f"\t{n} " for n in names) + "\n").encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        urls = read_url_list(spark, str(path))
        assert urls.rdd.getNumPartitions() > 1
        assert [r.url for r in urls.orderBy("pos").collect()] == names
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("n,count", [("2", 2), (3, 3), ("x", 5), ("0", 5), (-1, 5), (None, 5), ("2a", 5)])
def test_limit(spark, n, count):
    docs = spark.createDataFrame([("d", "a\nb\nc\nd\ne")], "document string, body string")
    found = limit_urls(url_list_lines(docs), n).orderBy("pos").collect()
    assert [r.url for r in found] == list("abcde")[:count]


def test_merge_keeps_first_places(spark):
    docs = spark.createDataFrame([("d", "https://b\nhttps://a\nhttps://b")], "document string, body string")
    xml = "<urlset><url><loc>https://c</loc></url><url><loc>https://a</loc></url></urlset>"
    maps = spark.createDataFrame([("m", xml), ("n", None)], "sitemap_url string, xml string")
    merged = US.merge_urls(url_list_lines(docs), sitemap_urls(maps))
    assert [r.url for r in merged.orderBy("pos").collect()] == ["https://b", "https://a", "https://c"]


def test_sitemap_elements(spark):
    xml = """<?xml version="1.0"?><urlset><!-- <loc>https://no</loc> --><url><loc> https://a?x=1&amp;y
    </loc><image:loc>https://img</image:loc></url><url><loc><![CDATA[https://b?x&amp;y]]></loc></url>
    <url><loc></loc></url><url><loc>ftp://c</loc></url><location>https://d</location>
    <sitemap><loc a="1">https://e/s.xml</loc></sitemap><url><loc>https://f<url><loc>https://g</loc>"""
    maps = spark.createDataFrame([("m", xml)], "sitemap_url string, xml string")
    found = sitemap_urls(maps).orderBy("pos").collect()
    assert [r.url for r in found] == ["https://a?x=1&y", "https://b?x&amp;y", "https://e/s.xml", "https://g"]


def test_sample_is_repeatable(spark):
    urls = spark.range(200).select(F.concat(F.lit("u"), "id").alias("url"))
    first = {r.url for r in US.sample_urls(urls, 25, 1).collect()}
    again = {r.url for r in US.sample_urls(urls.repartition(7), 25, 1).collect()}
    other = {r.url for r in US.sample_urls(urls, 25, 2).collect()}
    assert len(first) == 25 and first == again and first != other
    assert US.sample_urls(urls.limit(3), 25).count() == 3


# Fetches

LONG = "x" * 1000
GOOD = f"<html><head></head><body>{LONG}</body></html>"


def test_content_problems_in_order(spark):
    cases = [
        (None, "u", FE.EMPTY),
        (" \n ", "u", FE.EMPTY),
        ("x" * 999, "u", FE.TOO_SHORT),
        ("😀" * 499, "u", FE.TOO_SHORT),
        ("😀" * 500, "https://x/robots.txt", None),
        ("x" * 999, "https://x/robots.txt", FE.TOO_SHORT),
        (LONG, "https://x/robots.txt", None),
        (LONG, "u", FE.NO_STRUCTURE),
        (GOOD.replace("<head>", "<header>"), "u", None),
        (GOOD.replace("<body>", ""), "u", FE.NO_STRUCTURE),
        (GOOD.replace("<body>", "<BODY class='a'><!-- Access Denied -->"), "u", FE.ERROR_WORDS),
        ("<html><head><body>" + "y" * 4977 + "error" + LONG, "u", FE.ERROR_WORDS),
        ("<html><head><body>" + "y" * 4978 + "error" + LONG, "u", None),
        (GOOD, "u", None),
    ]
    rows = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, h string, u string")
    found = rows.select("i", FE.content_verdict(F.col("h"), F.col("u")).alias("v")).orderBy("i").collect()
    assert [r.v.reason for r in found] == [c[2] for c in cases]
    assert [r.v.valid for r in found] == [c[2] is None for c in cases]


def test_resolution(spark):
    attempts = [
        ("first", 1, 200, GOOD, None),
        ("first", 2, 200, GOOD + "2", None),
        ("second", 1, 403, GOOD, None),
        ("second", 2, 500, GOOD, None),
        ("zero", 1, 0, GOOD, None),
        ("fails", 1, None, None, "timeout"),
        ("fails", 2, 200, "", None),
        ("fails", 3, 403, "", None),
        ("late", 3, 200, "x", None),
        ("late", 4, 200, GOOD, None),
        ("thrown", 1, 403, GOOD, "broken pipe"),
    ]
    found = FE.resolve_fetches(spark.createDataFrame(attempts, FETCH_ATTEMPTS))
    rows = {r.url: (r.ok, r.attempt, r.status_code, r.error) for r in found.collect()}
    assert rows == {
        "first": (True, 1, 200, None),
        "second": (True, 2, 500, None),
        "zero": (True, 1, None, None),
        "fails": (False, 3, 403, FE.FORBIDDEN),
        "late": (False, 3, 200, "Invalid content after 3 retries: " + FE.TOO_SHORT),
        "thrown": (False, 1, 403, "broken pipe"),
    }
    pages, failures = FE.split_results(found)
    assert {r.url for r in pages.collect()} | {r.url for r in failures.collect()} == set(rows)
    assert pages.count() + failures.count() == len(rows)


# Versions


def test_latest_and_pairs_with_ties_and_a_hot_url(spark):
    rows = [(i, "hot", f"{i // 2:04d}", 1) for i in range(400)] + [(900, "one", "1", 2), (901, "two", "1", 3), (902, "two", "2", 4)]
    table = spark.createDataFrame(rows, "id bigint, url string, ts_key string, value int").repartition(6)
    newest = {(r.url, r.id) for r in V.latest_versions(table).collect()}
    assert newest == {("hot", 399), ("hot", 398), ("one", 900), ("two", 902), ("two", 901)}
    run = spark.createDataFrame([("two",), ("one",), ("two",), ("absent",)], "url string")
    pairs = {r.url: (r.new.id, r.old and r.old.id) for r in V.version_pairs(table, run, ["value"]).collect()}
    assert pairs == {"two": (902, 901), "one": (900, None)}
    assert [r.url for r in V.first_scrapes(V.version_pairs(table, run, ["value"])).collect()] == ["one"]


def test_pairing_shuffles_once_and_cuts_before(spark):
    table = spark.range(100).selectExpr("id", "string(id % 9) url", "string(id) ts_key", "id value").repartition(3)
    plan = V.version_pairs(table, None, ["value"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Exchange hashpartitioning") < plan.index("row_number(), 2, Partial")


def test_an_older_version_of_nulls_is_one(spark):
    rows = [("a", None, None, None), ("a", 1, "2", 5), ("b", None, None, None), (None, 3, "1", None), (None, 4, "2", 6)]
    table = spark.createDataFrame(rows, "url string, id bigint, ts_key string, value int")
    pairs = {r.url: (r.new.id, r.old and tuple(r.old)) for r in V.version_pairs(table, None, ["value"]).collect()}
    assert pairs == {"a": (1, (None, None, None)), "b": (None, None), None: (4, ("1", 3, None))}


def test_first_scrapes_parse_no_page_and_comparisons_no_audit_fields(spark):
    raw = spark.createDataFrame([(1, "https://x.com/", "1", 200, page())], RAW)
    pairs = V.version_pairs(extract_page_fields(raw))

    def plan(rows):
        return rows._jdf.queryExecution().optimizedPlan().toString()

    assert "html" not in plan(V.first_scrapes(pairs)).split("LogicalRDD")[0]
    compared = C.compare_versions(pairs)
    assert "html" not in plan(compared.filter("first_scrape").select("url")).split("LogicalRDD")[0]
    assert "html" in plan(compared).split("LogicalRDD")[0]
    assert not {"meta_description", "is_canonical_self_ref", "has_title"} & set(pairs.schema["new"].dataType.names)


def test_retention_is_strict_and_repeatable(spark):
    keys = ["20240131000000", "20240130235959", "20240301000000"]
    rows = spark.createDataFrame([(k, k[:8]) for k in keys], "ts_key string, snapshot_date string")
    kept = V.retain(rows, "2024-03-01 00:00:00", 30)
    assert sorted(r.ts_key for r in kept.collect()) == ["20240131000000", "20240301000000"]
    assert V.retain(kept, "2024-03-01 00:00:00", 30).count() == 2
    gone = V.expired(rows, "2024-03-01 00:00:00", 30)
    assert [r.ts_key for r in gone.collect()] == ["20240130235959"]
    counts = V.store_counts(rows, gone).first()
    assert (counts.inserted, counts.deleted) == (3, 1)


@pytest.mark.parametrize("n", [1, 4, 7, 10, 50])
def test_remove_latest_drops_exactly_n(spark, n):
    rows = [(i, f"u{i % 3}", f"{i // 4}") for i in range(10)]
    table = spark.createDataFrame(rows, "id bigint, url string, ts_key string").repartition(3)
    order = sorted(rows, key=lambda r: (-int(r[2]), r[1], r[0]))
    kept = {r.id for r in V.remove_latest(table, n).collect()}
    assert kept == {r[0] for r in order[n:]}


@pytest.mark.parametrize("n", [0, -1, "x", "25abc"])
def test_remove_latest_needs_a_positive_number(spark, n):
    with pytest.raises(ValueError):
        V.remove_latest(spark.range(3), n, order=("id",))


def test_backfill(spark):
    names = [
        ("a_com__x__20240101000000.html", page(title="b")),
        ("a_com__w__20240101000000.html", page(title="a")),
        ("a_com__x__20240102000000.html", page(title="Shop: x", description="d" * 161)),
        ("a_com__x__20240103000000.html", page()),
        ("a_com__x__2024.html", page()),
        ("b_com__20240101000000.html", page()),
    ]
    saved = spark.createDataFrame(names, "file_name string, html string")
    stored = spark.createDataFrame([("https://b.com", "20240101000000")] * 3, "url string, ts_key string")
    found = {(r.url, r.ts_key): r for r in backfill_run(saved, stored, "20240103").collect()}
    assert set(found) == {("https://a.com", "20240101000000"), ("https://a.com", "20240102000000")}
    assert found["https://a.com", "20240101000000"].title == "a"
    second = found["https://a.com", "20240102000000"]
    assert (second.has_title, second.has_meta_description, second.status_code) == (False, False, None)


# Changes


def test_field_changes(spark):
    old = page(title="", canonical="https://x.com/", h1="")
    new = page(title="T", canonical=None, h1="<h1>A</h1><h1>B</h1>")
    found = {r.type: (r.old_value, r.new_value) for r in changes(spark, old, new)}
    assert found == {
        "title": ("(empty)", "T"),
        "canonical": ("https://x.com/", "(empty)"),
        "h1": ("(empty)", "A"),
    }
    same = changes(spark, page(h1="<h1>A</h1><h1>B</h1>"), page(h1="<h1>A</h1><h1>C</h1>"))
    assert same == []


def test_content_threshold_is_strict(spark):
    def text(n):
        return page(body="y" * n, h1="")

    assert changes(spark, text(100), text(120)) == []
    found = changes(spark, text(1000), text(1201))
    assert [(r.type, r.message) for r in found] == [
        ("content", "20.1% of visible content difference vs previous version")
    ]
    assert changes(spark, text(0), text(500)) == []
    assert changes(spark, page(body="aaaa"), page(body="bbbb")) == []


def test_robots_changes_compare_trimmed_text_only(spark):
    url = "https://x.com/robots.txt"
    assert changes(spark, " a\n", "a", url) == []
    found = changes(spark, "abcd", "abcde", url)
    assert [(r.type, r.message, r.old_value, r.new_value) for r in found] == [
        ("robotstxt", "robots.txt content changed (25.0% difference)", "abcd", "abcde")
    ]
    assert changes(spark, "", "abc", url)[0].percent_diff == 100.0
    assert [r.type for r in changes(spark, "abcd", "dcba", url)] == ["robotstxt"]


def test_changes_carry_whole_texts(spark):
    url = "https://x.com/robots.txt"
    assert [(r.old_value, r.new_value) for r in changes(spark, "a" * 900, "b" * 1000, url)] == [("a" * 900, "b" * 1000)]
    rows = versions(
        spark,
        ("https://x.com/a", "20240101000000", page("short " * 90, h1="")),
        ("https://x.com/a", "20240102000000", page("longer " * 900, h1="")),
    )
    found = C.change_rows(compare_run(rows)).filter("type = 'content'").collect()
    assert [(r.old_value, r.new_value) for r in found] == [(("short " * 90).strip(), ("longer " * 900).strip())]


def test_change_order_and_symmetry(spark):
    old_nav = '<nav><a href="/gone">G</a><a href="/same">A</a></nav>'
    new_nav = '<nav><a href="/same">B</a><a href="/new">N</a></nav>'
    old, new = page(nav=old_nav), page("long " * 90, "T2", "https://x.com/", h1="<h1>I</h1>", nav=new_nav)
    forth, back = changes(spark, old, new), changes(spark, new, old)
    assert [r.type for r in forth] == list(C.PAGE_TYPES)
    links = {r.type: [x.url for x in r.links] for r in forth if r.links}
    reverse = {r.type: [x.url for x in r.links] for r in back if r.links}
    assert links["nav_removed"] == reverse["nav_added"] == ["https://x.com/gone"]
    assert links["nav_added"] == reverse["nav_removed"] == ["https://x.com/new"]
    assert links["nav_text_changed"] == reverse["nav_text_changed"] == ["https://x.com/same"]
    assert changes(spark, old, old) == []


def test_major_changes_fetch_both_texts(spark):
    rows = versions(
        spark,
        ("https://x.com/a", "20240101000000", page("short", h1="")),
        ("https://x.com/a", "20240102000000", page("much longer text", h1="")),
        ("https://x.com/b", "20240101000000", page()),
        ("https://x.com/b", "20240102000000", page()),
        ("https://x.com/c", "20240102000000", page()),
    )
    comparisons = compare_run(rows)
    assert [r.url for r in C.changed_only(comparisons).collect()] == ["https://x.com/a"]
    major = C.major_changes(comparisons)
    assert major.collect() == [Row(url="https://x.com/a", old_text="short", new_text="much longer text")]
    diff = [(r.part, r.value) for r in C.line_diff(major).collect()]
    assert diff == [("removed", "short"), ("added", "much longer text")]
    assert C.major_changes(compare_run(rows.filter("url <> 'https://x.com/a'"))).count() == 0


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_comparison_reads_pages_once_and_needs_no_shuffle_on_a_bucketed_store(spark, tmp_path):
    rows = versions(spark, *[(f"https://x.com/{k}", f"2024010{d}000000", page("word " * k * d)) for k in range(20) for d in (1, 2)])
    rows.write.parquet(str(tmp_path / "plain"))
    once = physical(C.change_rows(compare_run(spark.read.parquet(str(tmp_path / "plain")))))
    assert once.count("FileScan") == 1 and once.count("Exchange") == 1
    append_to_table(rows.filter("ts_key < '20240102'"), "bucketed_pages", buckets=4)
    append_to_table(rows.filter("ts_key >= '20240102'"), "bucketed_pages", buckets=4)
    stored = compare_run(spark.table("bucketed_pages"))
    assert "Exchange" not in physical(C.major_changes(stored))
    assert sorted(C.major_changes(stored).collect()) == sorted(C.major_changes(compare_run(rows)).collect()) != []


def test_multiline_diff_matches_repeats(spark):
    texts = spark.createDataFrame([("u", "a\nb\na\nc\n", "a\r\na\na\nd"), ("v", "", "x"), ("w", None, "")], "url string, old_text string, new_text string")
    found = sorted((r.url, r.part, r.value) for r in C.multiline_diff(texts).collect())
    assert found == [
        ("u", "added", "a"),
        ("u", "added", "d"),
        ("u", "common", "a"),
        ("u", "common", "a"),
        ("u", "removed", "b"),
        ("u", "removed", "c"),
        ("v", "added", "x"),
    ]


# Audit and report


def issues(spark, html, url="https://x.com/p", status=200):
    rows = versions(spark, (url, "1", html, status))
    return [(r.severity, r.rule) for r in A.audit(rows).orderBy("rule_no").collect()]


def test_audit_rules(spark):
    own = "https://x.com/p"
    assert issues(spark, page(canonical=own)) == []
    assert issues(spark, page(canonical=own, title="t" * 60, description="d" * 160)) == []
    assert issues(spark, page(canonical=own), status=404) == [("critical", "http_status")]
    assert issues(spark, page(canonical=own), status=None) == []
    assert issues(spark, page(canonical=own), status=0) == []
    assert issues(spark, page(canonical=own, title="t" * 61)) == [("minor", "title_long")]
    assert issues(spark, page(canonical=own, title="https://x.com/" + "t" * 61)) == [("critical", "title_missing")]
    assert issues(spark, page()) == [("critical", "canonical_missing")]
    assert issues(spark, page(canonical="/p")) == [("minor", "canonical_not_self")]
    assert issues(spark, page(canonical=own, h1="")) == [("critical", "h1_missing")]
    assert issues(spark, page(canonical=own, h1="<h1>a</h1><h1></h1>")) == [("minor", "h1_multiple")]
    assert issues(spark, page(canonical=own, description=None)) == [("minor", "meta_missing")]
    assert issues(spark, page(canonical=own, description="d" * 161)) == [("minor", "meta_long")]
    assert issues(spark, "", "https://x.com/robots.txt", 404) == []


def report(spark, rows, failed=()):
    table = versions(spark, *rows)
    comparisons = compare_run(table)
    run = table.filter("ts_key = '2'")
    failures = spark.createDataFrame(list(failed), "url string, error string")
    audited = A.audit_pages(run)
    lines = R.report_lines(audited, comparisons, failures)
    found, changed = A.issue_rows(audited), C.change_rows(comparisons)
    return (
        [(r.section, r.url, r.lines) for r in lines.orderBy("section_rank", "url", "lines").collect()],
        R.report_subject(lines).first().subject,
        R.report_flags(found, changed, failures, comparisons).first().asDict(),
        {r.counter: r.total for r in R.nonzero_counts(R.summary_counts(found, changed, failures)).collect()},
    )


def good(url, body="text " * 40, **options):
    return page(body, canonical=url, **options)


def test_report_of_a_quiet_run(spark):
    url = "https://x.com/p"
    lines, subject, flags, counts = report(spark, [(url, "1", good(url)), (url, "2", good(url))])
    assert (lines, subject, counts) == ([], "SEO Monitor - All OK", {})
    assert flags == {"all_ok": True, "has_notices": False, "show_summary": False, "show_all_good": True}


def test_content_and_robots_changes_leave_a_run_all_ok(spark):
    url, robots = "https://x.com/p", "https://x.com/robots.txt"
    rows = [(url, "1", good(url)), (url, "2", good(url, "z" * 99))]
    lines, subject, flags, counts = report(spark, rows)
    assert subject == "SEO Monitor - Source Code Changes" and flags["show_all_good"]
    rows = [(robots, "1", "a" * 300), (robots, "2", "b" * 300)]
    lines, subject, flags, counts = report(spark, rows)
    assert subject == "SEO Monitor - Robots.txt Changes" and flags["all_ok"]
    assert lines[0][2] == [
        "robots.txt content changed (0.0% difference)\nPrevious: " + "a" * 200 + "...\nCurrent: " + "b" * 200 + "..."
    ]


def test_report_of_a_busy_run(spark):
    url, fresh = "https://x.com/", "https://y.com/p"
    rows = [
        (url, "1", good(url, nav='<nav><a href="/a">A</a></nav>')),
        (url, "2", good(url, title="New", h1="", description=None, nav='<nav><a href="/a">B</a></nav>'), 500),
        (fresh, "2", good(fresh)),
    ]
    lines, subject, flags, counts = report(spark, rows, [("https://z.com", "403 Forbidden after retries")])
    assert lines == [
        ("critical", url, ["HTTP Status: 500 (expected 200)", "No H1 tag found"]),
        ("critical", url, ['Title changed:\n- "A title"\n+ "New"', 'H1 changed:\n- "H"\n+ "(empty)"']),
        ("navigation", url, ['Navigation link text changed (1):\nhttps://x.com/a\n- "A"\n+ "B"']),
        ("minor", url, ["Meta description missing"]),
        ("notices", fresh, ["First scrape, no previous version to compare"]),
        ("notices", "https://z.com", ["Scrape failed after 3 retries: 403 Forbidden after retries"]),
    ]
    assert subject == "SEO Monitor - Critical Issues Found"
    assert flags == {"all_ok": False, "has_notices": True, "show_summary": True, "show_all_good": False}
    assert counts == {"http_errors": 1, "missing_h1": 1, "meta_issues": 1, "nav_changes": 1, "scraping_failures": 1}


def test_first_scrape_only_gives_a_notice(spark):
    url = "https://x.com/p"
    lines, subject, flags, counts = report(spark, [(url, "2", good(url))])
    assert subject == "SEO Monitor - Notices" and counts == {}
    assert flags == {"all_ok": True, "has_notices": True, "show_summary": False, "show_all_good": False}
