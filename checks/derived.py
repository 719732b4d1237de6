"""Inputs derived from the given tables, for Spark and for the SQL checks.

The given pages have one version each and break few rules. Every input here is
a chain of projections over a whole table, written once as SQL text that both
engines read, so both work on the same bytes and grow with the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession



def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out as the session asks for; a file of one row group, as in a small bench, can't be split in reading."""
    parts = rows.sparkSession.conf.get("pagewatch.input.partitions", None)
    return rows if parts is None else rows.repartition(int(parts))


@dataclass(frozen=True)
class Derivation:
    """Stages of select lists over one table, and a final row filter."""

    table: str
    stages: tuple[tuple[str, ...], ...]
    keep: str = "true"

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spread(spark.read.parquet(f"{sf_dir}/{self.table}.parquet"))
        for stage in self.stages:
            rows = rows.selectExpr(*[_for_spark(item) for item in stage])
        return rows.filter(self.keep)

    def sql(self) -> str:
        query = self.table
        for number, stage in enumerate(self.stages):
            source = query if number == 0 else f"({query})"
            query = f"SELECT {', '.join(_for_duckdb(item) for item in stage)} FROM {source}"
        return f"SELECT * FROM ({query}) WHERE {self.keep}"


def _series(item: str) -> tuple[str, str] | None:
    """`SERIES n AS name` stands for one row per number from 1 to n."""
    if not item.startswith("SERIES "):
        return None
    _, count, _, name = item.split()
    return count, name


def _for_spark(item: str) -> str:
    series = _series(item)
    return f"explode(sequence(1, {series[0]})) AS {series[1]}" if series else item


def _for_duckdb(item: str) -> str:
    series = _series(item)
    return f"unnest(range(1, {series[0]} + 1)) AS {series[1]}" if series else item


I = "CAST(i AS STRING)"
ROOT = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
BASE = (
    "page_id AS i",
    "url AS url0",
    "html AS html0",
    "regexp_extract(url, '^(https?://)', 1) AS scheme",
    "regexp_extract(url, '^https?://([^/?#]+)', 1) AS host0",
)
OWN_URL = (
    "*",
    f"CASE WHEN i % 4 = 1 THEN scheme || 'p' || {I} || '.' || host0 || '/'"
    f" WHEN i % 20 = 2 THEN scheme || 'p' || {I} || '.' || host0 || '/robots.txt'"
    " ELSE url0 END AS url",
)

NAV_EXTRAS = (
    "'<li><a href=\"//cdn.example/x\">Cdn</a></li><li><a href=\"#top\">Top</a></li>"
    "<li><a href=\"mailto:a@example.com\">Mail</a></li>"
    "<li><a class=\"x\" href=\"' || " + ROOT + " || '/abs\"> Abs &amp;' || chr(10) || ' more </a></li>"
    "<li><a href=\"https://other.example/y\">Other</a></li>"
    "<li><a href=\"/twice\">One</a></li><li><a href=\"/twice\"><b>Tw</b>o</a></li>"
    "<li><a href=\"/blank\"> </a></li><li><a>No target</a></li>'"
)

PAGE_VERSIONS = Derivation(
    "pages",
    (
        (*BASE, "SERIES 2 AS v"),
        OWN_URL,
        (
            "*",
            "i * 2 + v AS id",
            "CASE WHEN v = 1 THEN '20240101000000' ELSE '20240102000000' END AS ts_key",
            "CAST(CASE WHEN i % 13 = 0 THEN 404 WHEN i % 17 = 0 THEN NULL ELSE 200 END AS INT)"
            " AS status_code",
            "CASE WHEN v = 2 AND i % 9 = 0 THEN 'https://moved.example/'"
            " WHEN i % 6 = 0 THEN url || '/' WHEN i % 11 = 0 THEN 'https://other.example/'"
            " WHEN i % 19 = 0 THEN '/x' WHEN i % 7 = 3 THEN NULL"
            " WHEN i % 5 = 1 THEN replace(url, scheme, upper(scheme)) ELSE url END AS target",
            "CASE WHEN i % 8 = 5 THEN NULL WHEN i % 8 = 1 THEN repeat('d', 161)"
            " WHEN i % 8 = 2 THEN repeat('d', 160)"
            f" ELSE 'Short &amp; sweet ' || {I} END AS description",
        ),
        (
            "*",
            # Head: canonical link and description, in several spellings.
            "replace(html0, '</head>', coalesce(CASE i % 3"
            " WHEN 0 THEN '<link rel=\"canonical\" href=\"' || target || '\">'"
            " WHEN 1 THEN '<link rel=\"icon\" href=\"/i\"><link href=\"' || target || '\" rel=canonical />'"
            " ELSE '<LINK data-x=\"a>b href=z\" REL=\"Canonical\" HREF=\"' || target || '\">' END, '')"
            " || coalesce('<meta content=\"' || description || '\" name=\"description\">', '')"
            " || '</head>') AS html1",
        ),
        (
            "*",
            "replace(html1, '<title>', CASE WHEN i % 23 = 0 THEN '<title></title><title>'"
            " WHEN i % 23 = 1 THEN '<title>https://t.example/x</title><title>'"
            " WHEN i % 23 = 2 THEN '<title>' || repeat('t', 61) || '</title><title>'"
            " WHEN i % 23 = 3 THEN '<title>Shop: all</title><title>'"
            " WHEN v = 2 AND i % 5 = 0 THEN '<title>New &eacute &ltimes; ' ELSE '<title>' END) AS html2",
        ),
        (
            "*",
            "CASE WHEN i % 29 = 0 THEN replace(replace(html2, '<h1>', '<h2>'), '</h1>', '</h2>')"
            " WHEN i % 29 = 1 THEN replace(html2, '</h1>', '</h1><h1> Second &notit; &AMP <i>one</i> &NotEqualTilde;</h1>')"
            " WHEN v = 2 AND i % 7 = 0 THEN replace(html2, '<h1>', '<h1>Now ')"
            " ELSE html2 END AS html3",
        ),
        (
            "*",
            "replace(html3, '<article>', '<article>' || CASE"
            " WHEN v = 2 AND i % 3 = 0 THEN '<p>' || repeat('pad ', 2000) || '</p>'"
            " WHEN v = 2 AND i % 3 = 1 THEN '<p>pad </p>' ELSE '' END"
            " || CASE WHEN i % 12 = 0 THEN '<p>&nbsp;caf&eacute; &#8212; &#x27;q&#39; 1 &lt; 2 caf&eacute &ltimes; &ampx &CounterClockwiseContourIntegral;</p>'"
            " WHEN i % 10 = 4 THEN '<svg><title>icon</title><text>svg</text></svg>'"
            " || '<noscript><h1>none</h1></noscript><iframe src=\"x\">frame</iframe>'"
            " WHEN i % 10 = 8 THEN '<svg><g><SVG a=\"b\"><text>in</text></svg></g><text>out</text></svg>'"
            " || '<svg/>beside<svg ><svg /></svg><template><i>unseen</i><template>x</template>y</template>'"
            " || '<textarea rows=2>a <b>bold</b> &amp; <!-- kept --><script>too</script></textarea>'"
            " WHEN i % 10 = 6 THEN 'seen<svg><template></svg>shown</template><template><svg></template>'"
            " ELSE '' END) AS html4",
        ),
        (
            "*",
            "replace(html4, '<nav><ul>', '<nav><ul>' || CASE WHEN v = 1"
            " THEN '<li><a href=\"/gone\">Gone</a></li><li><a href=\"/same\">A</a></li>'"
            " ELSE '<li><a href=\"/fresh\">Fresh</a></li><li><a href=\"/same\">B</a></li>' END"
            f" || {NAV_EXTRAS}) AS html5",
        ),
        (
            "id",
            "i",
            "v",
            "url",
            "ts_key",
            "status_code",
            "CASE WHEN i % 20 = 2 AND i % 4 <> 1 THEN '  User-agent: *' || chr(10) || 'Disallow: /a'"
            f" || chr(10) || replace(html0, '<p>', chr(10)) || CASE WHEN v = 2 AND i % 40 = 2"
            f" THEN chr(10) || 'Disallow: /b' || {I} ELSE '' END || chr(10) ELSE html5 END AS html",
        ),
    ),
    "NOT (i % 10 = 9 AND v = 1)",
)

FETCH_ATTEMPTS = Derivation(
    "pages",
    (
        (*BASE, "SERIES 4 AS n"),
        OWN_URL,
        (
            "i",
            "url",
            "CAST(n AS INT) AS attempt",
            "CAST(CASE WHEN i % 8 = 6 THEN NULL WHEN i % 8 = 3 AND n < 4 THEN 403"
            " WHEN i % 8 = 7 THEN 500 ELSE 200 END AS INT) AS status_code",
            "CASE WHEN i % 8 = 1 AND n = 1 THEN '  ' || chr(10)"
            " WHEN i % 8 = 2 AND n < 3 THEN '<html>short</html>'"
            " WHEN i % 8 = 4 THEN replace(html0, '<body>', '<div>')"
            " WHEN i % 8 = 5 THEN replace(html0, '<body>', '<body><p>Solve this Captcha</p>')"
            " WHEN i % 8 = 6 THEN NULL ELSE html0 END AS content",
            "CASE WHEN i % 8 = 6 THEN 'Timeout in attempt ' || CAST(n AS STRING) END AS error",
        ),
    ),
    "attempt <= CASE i % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 4 WHEN 7 THEN 1 ELSE 3 END",
)

URL_LISTS = Derivation(
    "pages",
    (
        (*BASE,),
        OWN_URL,
        (
            "i",
            f"'list-' || {I} AS document",
            "'  ' || url || chr(13) || chr(10) || chr(13) || chr(10) || chr(9) || scheme || host0"
            f" || '/extra-' || CAST(i % 10 AS STRING) || ' ' || chr(10) || 'https://dup.example/'"
            " || CAST(i % 3 AS STRING) || chr(10) || '   ' || chr(10) || url AS body",
        ),
    ),
)

SITEMAPS = Derivation(
    "pages",
    (
        (*BASE,),
        OWN_URL,
        ("*", "replace(url, '&', '&amp;') AS escaped"),
        (
            "i",
            f"'https://maps.example/' || {I} || '.xml' AS sitemap_url",
            "CASE WHEN i % 30 = 5 THEN NULL WHEN i % 6 = 0 THEN"
            " '<?xml version=\"1.0\"?><urlset><url><loc> ' || escaped || chr(10) || '</loc><lastmod>x</lastmod></url>'"
            " || '<!-- <loc>https://hidden.example/</loc> --><url><loc>https://dup.example/'"
            " || CAST(i % 9 AS STRING) || '</loc><image:image><image:loc>https://img.example/a.png</image:loc>'"
            " || '</image:image></url></urlset>'"
            " WHEN i % 6 = 1 THEN '<sitemapindex><sitemap><loc>' || scheme || host0 || '/child.xml</loc></sitemap></sitemapindex>'"
            " WHEN i % 6 = 2 THEN '<urlset><url><loc><![CDATA[ ' || url0 || '&amp;raw ]]></loc></url></urlset>'"
            " WHEN i % 6 = 3 THEN '<urlset><url><loc>  </loc></url><url><loc>ftp://files.example/' || CAST(i AS STRING)"
            " || '</loc></url><url><loc lang=\"en\">' || escaped || '</loc></url></urlset>'"
            " WHEN i % 6 = 4 THEN '<urlset><url><loc>' || escaped || '?a=1&amp;b=&lt;2&gt;</loc></url></urlset>'"
            " ELSE '<urlset><url><loc>' || escaped || '</loc><url><loc>https://open.example/' END AS xml",
        ),
    ),
)

SAVED_PAGES = Derivation(
    "pages",
    (
        (*BASE,),
        (
            "i",
            "replace(host0, '.', '_') || '__' || CASE WHEN i % 9 = 0 THEN 'undated' ELSE"
            " 'copy' || CAST(i AS STRING) || '__' || CASE WHEN i % 9 = 1 THEN '20240109' ELSE"
            " '2024010' || CAST(1 + i % 2 AS STRING) END || '120000' END || '.html' AS file_name",
            "html0 AS html",
        ),
    ),
)

DOCUMENT_TEXTS = Derivation(
    "documents",
    (
        (
            "CAST(doc_id AS STRING) AS url",
            "replace(text, '. ', '.' || chr(10)) AS old_text",
            "replace(replace(text, '. ', '.' || chr(10)), ' the ', ' this ') || chr(10)"
            " || 'Read again ' || CAST(doc_id % 5 AS STRING) || chr(10) || 'Read again' AS new_text",
        ),
    ),
)
