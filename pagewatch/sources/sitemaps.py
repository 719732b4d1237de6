"""Page addresses listed in sitemap documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.functions.text import decode_entities, replace_regex, ws_trim
from pagewatch.functions.urls import is_http_url
from pagewatch.sources.url_lists import _position

SITEMAP_SOURCE = 1
# Text and character data only, so an unclosed element fails at once.
LOC = r"(?s)<loc(?=[\s>])[^>]*+>((?:<!\[CDATA\[.*?\]\]>|[^<]++)*+)</loc\s*>"
XML_COMMENT = r"(?s)<!--.*?(?:-->|\z)"
CDATA = r"(?s)<!\[CDATA\[(.*?)\]\]>"


def _loc_text(content: Column) -> Column:
    """Text of one element; character data sections are taken as they are."""
    literal = replace_regex(content, CDATA, "$1")
    parsed = decode_entities(content, in_attribute=True)
    return ws_trim(F.when(content.contains("<![CDATA["), literal).otherwise(parsed))


def sitemap_urls(
    sitemaps: DataFrame, sitemap_url: str = "sitemap_url", xml: str = "xml"
) -> DataFrame:
    """All http(s) addresses in elements called exactly `loc`, at any depth.

    Child sitemaps of an index count as addresses and are not followed. Broken
    XML costs at most its own rows; a sitemap that was not fetched has no rows.
    """
    contents = F.regexp_extract_all(replace_regex(F.col(xml), XML_COMMENT), F.lit(LOC), 1)
    found = sitemaps.filter(F.col(xml).isNotNull()).select(
        F.col(sitemap_url).alias("sitemap_url"), F.posexplode_outer(contents).alias("row", "content")
    )
    return found.select(
        _position(F.col("sitemap_url"), F.lit(0), F.col("row"), SITEMAP_SOURCE).alias("pos"),
        _loc_text(F.col("content")).alias("url"),
    ).filter(is_http_url(F.col("url")))
