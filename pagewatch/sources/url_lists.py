"""URL lists: one address per line, in text files or in a column of list documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.functions.text import ws_trim

LIST_SOURCE = 0


def _position(document: Column, block: Column, row: Column, source: int = LIST_SOURCE) -> Column:
    return F.struct(
        F.lit(source).alias("source"),
        document.cast("string").alias("document"),
        block.cast("bigint").alias("block"),
        row.cast("bigint").alias("row"),
    )


def _cleaned(lines: DataFrame) -> DataFrame:
    return lines.select("pos", ws_trim(F.col("line")).alias("url")).filter("length(url) > 0")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """Read list files line by line; large files are split like any text input.

    Lines have no number of their own in a split file. File, block and the row
    id inside the task rise together, so `pos` sorts lines in file order.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("document"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    numbered = lines.withColumn("row", F.monotonically_increasing_id())
    return _cleaned(
        numbered.select(_position(F.col("document"), F.col("block"), F.col("row")).alias("pos"), "line")
    )


def url_list_lines(documents: DataFrame, document: str = "document", body: str = "body") -> DataFrame:
    """The same for list documents held in a column."""
    lines = documents.select(
        F.col(document).alias("document"), F.posexplode_outer(F.split(body, "\n")).alias("row", "line")
    )
    return _cleaned(
        lines.select(_position(F.col("document"), F.lit(0), F.col("row")).alias("pos"), "line")
    )


def parse_limit(value: int | str) -> int | None:
    """A positive whole number, or None for anything else."""
    text = str(value).strip()
    return int(text) if text.isdecimal() and int(text) > 0 else None


def limit_urls(urls: DataFrame, n: int | str | None) -> DataFrame:
    """First `n` URLs in list order; all of them if `n` is not a positive number."""
    limit = None if n is None else parse_limit(n)
    return urls if limit is None else urls.orderBy("pos", "url").limit(limit)
