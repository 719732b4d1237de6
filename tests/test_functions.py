"""Literal values for the scalar functions, edge cases first."""

from html import unescape
from html.entities import html5

from pyspark.sql import functions as F

from pagewatch.functions import text as T
from pagewatch.functions import times as TM
from pagewatch.functions import urls as U


def values(spark, inputs, column, type_="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {type_}")
    return [r[0] for r in rows.coalesce(1).orderBy("i").select(column(F.col("x"))).collect()]


def test_trim_and_collapse_know_all_blanks(spark):
    texts = ["\t a b﻿\r\n", " x　 y \n z", "", None, "a​b"]
    assert values(spark, texts, T.ws_trim) == ["a b", "x　 y \n z", "", None, "a​b"]
    assert values(spark, texts, T.ws_collapse) == ["a b", "x y z", "", None, "a​b"]
    assert values(spark, ["a  b", " a ", "a\nb", "a \n"], T.ws_collapse) == ["a b", "a", "a b", "a"]


def test_blank(spark):
    assert values(spark, [None, "", " \n ", " x "], T.is_blank) == [True, True, True, False]


def test_length_counts_utf16_units(spark):
    assert values(spark, ["", "abc", "é", "😀a", None], T.utf16_length) == [0, 3, 1, 3, None]


def test_entities(spark):
    texts = ["a &amp; b", "&amp;lt;", "&#8212;&#x27;&#150;", "&eacute;&nbsp;x", "AT&T &foo;", "&#38;amp;", None]
    expected = ["a & b", "&lt;", "—'–", "é x", "AT&T &foo;", "&amp;", None]
    assert values(spark, texts, T.decode_entities) == expected


def test_entities_without_semicolon(spark):
    assert values(spark, ["x &copy 1 &amp"], T.decode_entities) == ["x © 1 &"]
    attribute = values(spark, ["?a=1&copy=2&amp;b"], lambda c: T.decode_entities(c, in_attribute=True))
    assert attribute == ["?a=1&copy=2&b"]


def test_all_names_in_all_surroundings(spark):
    names = sorted({name.rstrip(";") for name in html5})
    for after in ("", ";", " ", "x", "&", "=1;", "amp;"):
        texts = [f"a&{name}{after}" for name in names]
        assert values(spark, texts, T.decode_entities) == [unescape(t) for t in texts]


def test_open_names_in_attributes(spark):
    texts = ["&lt", "a&lt=b", "&lt1", "&ltimes;", "&copy;=", "&eacute&amp", "&notit;", "&not;it"]
    expected = ["<", "a&lt=b", "&lt1", "⋉", "©=", "é&", "&notit;", "¬it"]
    assert values(spark, texts, lambda c: T.decode_entities(c, in_attribute=True)) == expected


def test_invalid_code_points_become_replacement_characters(spark):
    assert values(spark, ["&#0;&#xD800;&#99999999;"], T.decode_entities) == ["�" * 3]


def test_references_have_any_number_of_digits(spark):
    texts = ["&#0000000065;&#x00000041;", "&#" + "0" * 40 + "66;", "&#x" + "0" * 40 + "43", "&#" + "9" * 40 + ";", "&#00;"]
    assert values(spark, texts, T.decode_entities) == ["AA", "B", "C", "�", "�"]


def test_ports_have_any_number_of_digits(spark):
    urls = ["http://h:000080/", "http://h:0000008080/", "http://h:65535/", "http://h:65536/", "http://h:123456/", "http://h:000/", "http://h:/"]
    expected = ["http://h/", "http://h:8080/", "http://h:65535/", None, None, "http://h:0/", "http://h/"]
    assert values(spark, urls, U.normalize_url) == expected


def test_one_decimal_rounds_the_binary_value_and_ties_up(spark):
    numbers = [1.45, 20.25, 20.75, 0.05, 25.0, 12345678.9, 100.0 / 3]
    expected = ["1.4", "20.3", "20.8", "0.1", "25.0", "12345678.9", "33.3"]
    assert values(spark, numbers, T.one_decimal, "double") == expected


def test_percent_difference(spark):
    rows = spark.createDataFrame([(100, 120), (100, 79), (0, 5)], "o int, n int")
    found = rows.select(T.percent_difference(F.col("o"), F.col("n"))).collect()
    assert [r[0] for r in found] == [20.0, 21.0, None]


def test_html_escape(spark):
    assert values(spark, ["<a href=\"x\">&'"], T.html_escape) == [
        "&lt;a href=&quot;x&quot;&gt;&amp;&#039;"
    ]


URLS = {
    "https://Ex.COM:443/a/../b/./c d?q=é#f g": "https://ex.com/b/c%20d?q=%C3%A9#f%20g",
    "http://x.com": "http://x.com/",
    "HTTP://x.com:80?a": "http://x.com/?a",
    "http://x.com:0080/": "http://x.com/",
    "http://x.com:8080/%7Ea": "http://x.com:8080/%7Ea",
    "https:y.com\\a\\..\\b": "https://y.com/b",
    " https://x.com/a\n": "https://x.com/a",
    "https://u:p@X.com/a/..": "https://u:p@x.com/",
    "https://x.com/a/b/..": "https://x.com/a/",
    "https://x.com/..": "https://x.com/",
    "https://x.com/😀?'": "https://x.com/%F0%9F%98%80?%27",
    "mailto:A": "mailto:A",
    "/rel": None,
    "": None,
    "http://a b/": None,
    "http://x:70000/": None,
    "http:///": None,
}


def test_normal_form_of_urls(spark):
    assert values(spark, list(URLS), U.normalize_url) == list(URLS.values())


HOSTS = {
    "http://0x7f.1/": "http://127.0.0.1/",
    "http://2130706433/a": "http://127.0.0.1/a",
    "http://0300.0250.0.01./": "http://192.168.0.1/",
    "http://0X/": "http://0.0.0.0/",
    "http://00000000000000000000000001.0xFFFFFF": "http://1.255.255.255/",
    "http://4294967295/": "http://255.255.255.255/",
    "http://4294967296/": None,
    "http://99999999999999999999999/": None,
    "http://1.2.3.256/": None,
    "http://256.1/": None,
    "http://1.2.3.4.5/": None,
    "http://9.9.9.9.9.9.9.9.9.9.9.9.4294967295/": None,
    "http://a.09/": None,
    "http://1..2/": None,
    "http://a.0xg/": "http://a.0xg/",
    "http://1.2.3.4a/": "http://1.2.3.4a/",
    "http://%65x%41mple.COM:80/%65": "http://example.com/%65",
    "http://a+b%2Dc/": "http://a+b-c/",
    "http://%31%2e2.3.4/": "http://1.2.3.4/",
    "http://a%2Fb/": None,
    "http://a%zz/": None,
    "http://a%": None,
    "http://a%ff/": None,
    "http://%C3%89.com/": "http://é.com/",
    "http://[::1]/": "http://[::1]/",
}


def test_encoded_hosts_and_addresses(spark):
    assert values(spark, list(HOSTS), U.normalize_url) == list(HOSTS.values())
    assert values(spark, list(HOSTS), U.is_http_url) == [x is not None for x in HOSTS.values()]
    assert values(spark, ["http://0x7f.1/"], U.url_host) == ["127.0.0.1"]


def test_kinds_of_urls(spark):
    texts = ["https://x.com", "Note: hi", "http://a b", "ftp://x", "plain", "http:foo"]
    assert values(spark, texts, U.is_http_url) == [True, False, False, False, False, True]
    assert values(spark, texts, U.is_any_url) == [True, True, False, True, False, True]


def test_home_pages(spark):
    texts = ["https://x.com", "https://x.com/?a", "https://x.com/a", "https://x.com/a/..", "bad"]
    assert values(spark, texts, U.is_home_page) == [True, True, False, True, False]


def test_saved_file_names(spark):
    names = ["www_x_com__p__20240102030405.html", "www_x_com__20240102030405.htm", "a__1.html"]
    assert values(spark, names, TM.snapshot_ts) == ["20240102030405", None, None]
    assert values(spark, names, TM.url_from_file_name) == ["https://www.x.com", "https://www.x.com", "https://a"]


def test_cutoff(spark):
    row = spark.range(1).select(TM.retention_cutoff("2024-03-01T00:00:05+01:00", 30)).first()
    assert row[0] == "20240130230005"
