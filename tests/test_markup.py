"""Field extraction on literal pages, and on the given pages against a parser walk."""

import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from pagewatch.functions import markup as M
from pagewatch.functions import navigation as N
from pagewatch.functions.text import WHITESPACE

PAGE = """<html><head><!-- <title>no</title> --><title> A &amp; <b>B </title>
<link href="x" rel="canonical nofollow"><LINK data-a="a>b" REL='Canonical' HREF='https://x.com/a?b=1&amp;c=2'>
<meta name="Description" content="no"><meta content="d &quot;q&quot;" name=description></head>
<body><h1> One <i>x</i></h1><script><!-- </p><h1>no</h1></script><noscript><h1>no</h1></noscript>
<h1>Two</h1><svg><title>t</title></svg><p>a</p><p>b &middot;</p></body>"""


def one(spark, html, column, url="https://h.com/"):
    rows = spark.createDataFrame([(html, url)], "html string, url string")
    return rows.select(column(F.col("html"))).first()[0]


def test_fields(spark):
    assert one(spark, PAGE, M.page_title) == "A & <b>B"
    assert one(spark, PAGE, M.canonical) == "https://x.com/a?b=1&c=2"
    assert one(spark, PAGE, M.meta_description) == 'd "q"'
    assert one(spark, PAGE, M.h1_texts) == ["One x", "Two"]
    assert one(spark, PAGE, M.visible_text) == "One x Twoab ·"


def test_missing_parts(spark):
    for html in (None, "", "plain", "<p>x"):
        assert one(spark, html, M.page_title) == ""
        assert one(spark, html, M.canonical) == ""
        assert one(spark, html, M.meta_description) == ""
        assert one(spark, html, M.h1_texts) == []
    assert one(spark, "<head><title>t</title></head>after", M.visible_text) == "after"
    assert one(spark, "<title>t</title>bare", M.visible_text) == "bare"


def test_nested_parts_are_no_text(spark):
    pages = {
        "<body>a<svg><g><svg x='>'>b</svg></g>c</svg>d": "ad",
        "<body>a<SVG/>b<svg a/>c<svg a=b/>d</svg>e": "abce",
        "<body>a<svg a=/>b": "a",
        "<body>a<svg>b<svg/>c</svg>d</svg>e": "ade",
        "<body>a<svg>b<svg>c</svg>d": "a",
        "<body>a</svg>b<svgs>c</svgs>": "abc",
        "<body>a<template><p>b</p><template>c</template>d</template>e": "ae",
        "<body>a<template/>b</template>c": "ac",
        "<body>a<svg><template></svg>b</template>c": "abc",
    }
    for html, text in pages.items():
        assert one(spark, html, M.visible_text) == text, html


def test_textareas_hold_text_only(spark):
    html = "<body><textarea rows=2>a <b>c</b> &amp;lt; <!-- d --><script>e</script></TEXTAREA ><i>f</i><textarea><p>g"
    assert one(spark, html, M.visible_text) == "a <b>c</b> &lt; <!-- d --><script>e</script>f<p>g"
    assert one(spark, "<body><!-- <textarea> -->a<script><textarea></script>b", M.visible_text) == "ab"


def test_nested_parts_are_linear(spark):
    assert one(spark, "<body>" + "<svg>" * 20000 + "x", M.visible_text) == ""
    assert one(spark, "<body>" + "<svg>" * 5000 + "</svg>" * 5000 + "x", M.visible_text) == "x"
    assert one(spark, "<body>" + "<textarea>" * 20000, M.visible_text) == "<textarea>" * 19999


def test_first_canonical_without_target_ends_the_search(spark):
    html = '<link rel=canonical><link rel=canonical href="https://x.com/">'
    assert one(spark, html, M.canonical) == ""


def test_broken_markup_is_linear(spark):
    html = "<body>" + "<!-- " * 20000 + "<script " * 20000 + "<h1" * 20000
    assert one(spark, html, M.visible_text) == ""
    assert one(spark, "<h1>" * 20000, lambda c: F.size(M.h1_texts(c))) == 20000
    assert one(spark, "<body>" + " \n" * 200000 + "x", M.visible_text) == "x"


def test_title_rules(spark):
    rows = spark.createDataFrame([("",), ("https://t.example/x",), ("Shop: all",), ("Fine",)], "t string")
    found = rows.select(M.has_title(F.col("t")), M.has_title(F.col("t"), any_scheme=True)).collect()
    assert [tuple(r) for r in found] == [(False, False), (False, False), (True, False), (True, True)]


def test_self_reference(spark):
    rows = spark.createDataFrame(
        [
            ("https://X.com/a/", "https://x.com/a"),
            ("https://x.com/a", "https://x.com/a"),
            ("https://x.com/a//", "https://x.com/a"),
            ("/a", "https://x.com/a"),
            ("", "https://x.com/a"),
        ],
        "c string, u string",
    )
    c, u = F.col("c"), F.col("u")
    found = rows.select(M.canonical_self_ref(c, u), M.canonical_self_ref(c, u, strip_slash=False))
    assert [tuple(r) for r in found.collect()] == [
        (True, False),
        (True, True),
        (False, False),
        (False, False),
        (False, False),
    ]


def test_description_limit(spark):
    rows = spark.createDataFrame([("d" * 160,), ("d" * 161,), ("",)], "d string")
    found = rows.select(M.has_meta_description(F.col("d")), M.has_meta_description(F.col("d"), 160))
    assert [tuple(r) for r in found.collect()] == [(True, True), (True, False), (False, False)]


class _Walk(HTMLParser):
    """Visible text by walking the parsed page."""

    SKIP = {"script", "style", "noscript", "iframe", "svg"}

    def __init__(self):
        super().__init__()
        self.skipping, self.in_body, self.texts = 0, False, []

    def handle_starttag(self, tag, attrs):
        self.in_body |= tag == "body"
        self.skipping += tag in self.SKIP

    def handle_endtag(self, tag):
        self.skipping -= tag in self.SKIP

    def handle_data(self, data):
        if self.in_body and not self.skipping:
            self.texts.append(data)


def test_visible_text_of_given_pages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for row in rows.select("html", M.visible_text(F.col("html")).alias("text")).collect():
        walk = _Walk()
        walk.feed(row.html)
        if not re.search(r"<[^>]*\Z", row.html):
            walk.close()
        expected = re.sub(f"[{WHITESPACE}]+", " ", "".join(walk.texts)).strip(" ")
        assert row.text == expected


NAV = """<div class="a menu b"><div>x</div><a href="/p">P <b>q</b></a><div><div>
<a href="https://h.com/z"> Z\n z</a></div></div><a href='/p'>Last</a><a href="//cdn/x">c</a>
<a href="#t">t</a><a href="mailto:x">m</a><a href="https://o.com/">o</a><a href="HTTPS://h.com/up">up</a>
<a href="/blank"> </a><a>none</a></div><a href="/out">out</a><div id="menu2"><a href="/q?a=1&amp;b#c">Q</a>"""


def links(spark, selector, url="https://h.com/", **options):
    found = one(spark, NAV, lambda c: N.nav_links(c, F.lit(url), [("", selector)], **options))
    return [(x.url, x.text) for x in found]


def test_nested_containers(spark):
    inside = [
        ("https://h.com/p", "P q"),
        ("https://h.com/z", "Z z"),
        ("https://h.com/p", "Last"),
        ("https://h.com//cdn/x", "c"),
    ]
    assert links(spark, ".menu") == inside
    assert links(spark, "div.menu") == inside
    assert links(spark, "#menu2") == [("https://h.com/q?a=1&b#c", "Q")]
    assert links(spark, "#absent") == []
    assert links(spark, "nav") == []


def test_only_home_pages_have_navigation(spark):
    assert links(spark, ".menu", "https://h.com/x") == []
    assert links(spark, ".menu", "bad") == []
    assert len(links(spark, ".menu", "https://h.com/x", homepage_only=False)) == 4


def test_first_fitting_rule_counts(spark):
    rules = [("other", "#menu2"), ("h.com", ".menu"), ("", "#menu2")]
    found = one(spark, NAV, lambda c: N.nav_links(c, F.lit("https://h.com/"), rules))
    assert len(found) == 4


def test_link_changes_against_dictionaries(spark):
    import random

    random.seed(3)
    for _ in range(15):
        lists = [
            [(f"u{random.randrange(6)}", f"t{random.randrange(3)}") for _ in range(random.randrange(8))]
            for _ in range(2)
        ]
        rows = spark.createDataFrame([tuple(lists)], f"o {N.LINK_TYPE}, n {N.LINK_TYPE}")
        found = rows.select(N.link_changes(F.col("o"), F.col("n"))).first()[0]
        old, new = dict(lists[0]), dict(lists[1])
        assert [(x.url, x.text) for x in found.removed] == [(u, t) for u, t in old.items() if u not in new]
        assert [(x.url, x.text) for x in found.added] == [(u, t) for u, t in new.items() if u not in old]
        assert [(x.url, x.old_text, x.new_text) for x in found.text_changed] == [
            (u, old[u], t) for u, t in new.items() if u in old and old[u] != t
        ]
