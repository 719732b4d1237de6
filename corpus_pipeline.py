"""A corpus pipeline over `documents`: language ID, near duplicates, repeated passages, source mix, packing.

Each stage takes what the one before kept, written as Parquet and read again, and all but the last return the columns
of documents. Texts that a stage changes get their n_chars anew. A stage gives no rows for an empty table. Extra columns pass
through inside a struct, so that no name of theirs can clash with a stage's own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.llm.common import quoted, shared_dir, table
from pagewatch.llm.languages import identify
from pagewatch.llm.mixing import mix
from pagewatch.llm.near_duplicates import join_near
from pagewatch.llm.packing import pack_documents
from pagewatch.llm.recompression import deduplicate

#: A document whose language has a smaller part of its words is rejected, as is one without any letter.
LEAST_LANGUAGE_SCORE = 0.3


def _keyed(docs: DataFrame) -> DataFrame:
    """Whole rows as `d`, with their id and a hash of their text, which tell apart all rows but copies with one id."""
    whole = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("d")
    return docs.select(whole, F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("digest"))


def _joined(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """`found` has found_id and found_digest."""
    return rows.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("digest") == F.col("found_digest")), how)


def _columns(docs: DataFrame, struct: str, changed: Column, text: Column) -> list[Column]:
    """The columns of `docs` from a struct, where `changed` with another text and its length."""
    out = []
    for field in docs.schema:
        own = F.col(f"{struct}.{quoted(field.name)}")
        new = {"text": text, "n_chars": F.char_length(text)}.get(field.name)
        out.append((own if new is None else F.when(changed, new.cast(field.dataType)).otherwise(own)).alias(field.name))
    return out


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts, texts without a letter, and those with no language of at least the least score."""
    found = identify(docs, carried=True, least=LEAST_LANGUAGE_SCORE)
    text = F.col("text").cast(docs.schema["text"].dataType).alias("text")
    return found.select([text if c == "text" else F.col(f"carried.{quoted(c)}") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each class; of repeated rows, one. Rows with a null id all stay."""
    classes = join_near(docs.select("doc_id", "text")).where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("class_id")))
    kept = classes.select(F.col("doc_id").alias("found_id"), F.col("digest").alias("found_digest")).distinct()
    rows = _joined(_keyed(docs), kept, "left_semi")
    named = rows.where(F.col("id").isNotNull()).dropDuplicates(["id", "digest"])
    return named.unionByName(rows.where(F.col("id").isNull())).select("d.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of at least a window that a document with a smaller id holds too. Texts that lose words keep the others with single spaces; those that lose all go."""
    cut = deduplicate(docs, carried=True).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    cut = cut.withColumn("whole", F.struct("carried.*", F.col("kept").cast(docs.schema["text"].dataType).alias("text")))
    return cut.select(_columns(docs, "whole", F.col("n_removed") > 0, F.col("kept")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document; documents that the mix doesn't take go. The one at which a source's target is reached has only its first words in its last use."""
    asked = _keyed(docs).select(F.col("id").alias("doc_id"), F.col("d.text").alias("text"), F.array(F.col("d.source").cast("string")).alias("sources"), "digest")
    taken = mix(asked, carried=("digest",)).where("taken > 0")
    # Copies with one id and one text share what they are taken for.
    each = taken.groupBy(F.col("doc_id").alias("found_id"), F.col("digest").alias("found_digest"), "size").agg(F.ceil(F.avg("taken")).cast("long").alias("taken"))
    rows = _joined(_keyed(docs), each, "inner")
    rows = rows.withColumn("use", F.explode(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - F.col("use") * F.col("size")).cast("int")
    body = F.regexp_replace(F.col("d.text").cast("string"), r"^[\x20\x09-\x0D]+", "")
    rest = F.element_at(F.split(body, F.lit(r"[\x20\x09-\x0D]+"), words + 1), -1)
    front = F.regexp_replace(F.left(body, F.char_length(body) - F.char_length(rest)), r"[\x20\x09-\x0D]+$", "")
    return rows.select(_columns(docs, "d", words < F.col("size"), front))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: SQL cannot express a trained language model, token ids or packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What each stage keeps is written below the folder that all executors share."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
