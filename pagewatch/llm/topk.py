"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are turned into integers. Data rows are packed into blocks of a bounded number of vectors with their postings:
for each term (component), the rows in which it is not zero and its weights there. Query rows are packed into blocks of
their own. Every block of queries meets every block of data; there, each query takes its terms one after another and
adds its weight times the posted weights into a dense array of scores. The best k of the block are found by
partition selection, and the bests of all blocks are merged for each query.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null id. Rows that repeat an
id count as one, with the least of their vectors. Shorter vectors count as filled up with zeros. Ties go to the smaller id. An empty table,
or one without queries, gives no rows; other columns are not read. Sums are 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewatch.llm.common import table

K = 10
SCALE = 1024
DATA_BLOCK = 4096
QUERY_BLOCK = 512
PACKED = "block long, ids binary, starts binary, terms binary, weights binary"


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): floor(scale * component) for the vectors that take part, one for each id."""
    x = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf)))
    vectors = rows.where(good).select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v * scale)).alias("vector"))
    return vectors.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def blocks(vectors: DataFrame, most: int) -> DataFrame:
    """Vectors packed in compressed sparse rows, at most `most` in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for first in range(0, batch.num_rows, most):
                part = batch.slice(first, most)
                lists = part.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                lengths = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(len(lengths)), lengths)
                term = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                kept = flat != 0
                starts = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(lengths)))])
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_pylist(
                    [{"block": number, "ids": ids.tobytes(), "starts": starts.astype(np.int64).tobytes(), "terms": term[kept].astype(np.int32).tobytes(), "weights": flat[kept].tobytes()}],
                    pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("ids", "starts", "terms", "weights")]]),
                )
                number += 1

    return vectors.select("vec_id", "vector").mapInArrow(run, PACKED)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to smaller ids: those above the k-th by partition, then those equal to it by id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= least)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))[:k]]


def accumulate(data: dict, queries: dict, k: int) -> list[tuple[int, int, int]]:
    """(query id, data id, score) of the k best of one block of data for each query of another block."""
    ids, starts, terms, weights = (np.frombuffer(data[c], t) for c, t in (("ids", np.int64), ("starts", np.int64), ("terms", np.int32), ("weights", np.int64)))
    row = np.repeat(np.arange(len(ids)), np.diff(starts))
    order = np.argsort(terms, kind="stable")
    posted_rows, posted_weights = row[order], weights[order]
    ends = np.searchsorted(terms[order], np.arange((terms.max() if len(terms) else -1) + 2))
    q_ids, q_starts, q_terms, q_weights = (np.frombuffer(queries[c], t) for c, t in (("ids", np.int64), ("starts", np.int64), ("terms", np.int32), ("weights", np.int64)))
    out = []
    scores = np.zeros(len(ids), np.int64)
    for q, query in enumerate(q_ids):
        scores[:] = 0
        for term, weight in zip(q_terms[q_starts[q] : q_starts[q + 1]], q_weights[q_starts[q] : q_starts[q + 1]]):
            if term < len(ends) - 1:
                at = slice(ends[term], ends[term + 1])
                scores[posted_rows[at]] += weight * posted_weights[at]  # a row has a term once
        others = np.flatnonzero(ids != query)
        top = others[best(scores[others], ids[others], k)]
        out += zip([int(query)] * len(top), ids[top].tolist(), scores[top].tolist())
    return out


def top_k(queries: DataFrame, data: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows of `data` but its own; both have vec_id and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        for batch in batches:
            for r in batch.to_pylist():
                found = accumulate(r, {c: r[f"q_{c}"] for c in ("ids", "starts", "terms", "weights")}, k)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*found)) or [()] * 3, schema)], schema)

    # Queries are dealt into blocks by a hash of their ids, which differ; the number of blocks follows from their count.
    count = queries.count()
    groups = max(1, -(-count // QUERY_BLOCK))
    packed_queries = blocks(queries.repartition(groups, "vec_id"), QUERY_BLOCK).withColumn("bucket", F.spark_partition_id())
    # A row for each block: their number is that of all queries over QUERY_BLOCK.
    packed_queries = packed_queries.select("bucket", "block", *[F.col(c).alias(f"q_{c}") for c in ("ids", "starts", "terms", "weights")])
    packed_queries = packed_queries.withColumn("lane", F.pmod(F.xxhash64("bucket", "block"), F.lit(groups)).cast("int"))
    packed_data = blocks(data, DATA_BLOCK).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = packed_data.drop("block").join(packed_queries.drop("bucket", "block"), "lane").drop("lane")
    partial = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


def op4_sql() -> str:
    return f"""
    WITH parts AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    terms AS (SELECT vec_id, unnest(v) AS w, generate_subscripts(v, 1) AS t FROM parts),
    scores AS (
        SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(sum(q.w * d.w) AS BIGINT) AS score
        FROM terms q JOIN terms d ON q.t = d.t AND q.vec_id <> d.vec_id
        WHERE q.vec_id % 100 = 0 GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {K}
    """
