"""Best-fit packing by minimum bin slack.

All documents are cut into pieces and only the count of pieces of each length (at most `capacity` rows) reaches the
driver. There, one bin after another is opened with the longest piece left; a subset-sum program over bitsets finds the
combination of remaining lengths that fills the bin best. That combination is used as often as the counts allow, so
each one exhausts a length and there are about as many combinations as lengths, whatever the size of the input. The
pieces of a length are then numbered in parallel and looked up in the list of combinations.

Null and empty texts are the single token 2. Repeated rows are packed each for itself; an empty table gives no
rows; columns other than doc_id and text are not read. Nothing is unbounded but the table itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewatch.llm.common import checkpointed, given_back, table
from pagewatch.llm.token_ids import BYTE_LEVEL, public_path, token_ids

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, row long, piece int, start long, length int, ids_crc32 long"
#: A piece's number within its length is counted in parts of about so many pieces, so that no length is numbered in one task.
PART = 20_000


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of each row of `docs`: the first one may be shorter, all others have `capacity` tokens."""

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Words are remembered in Arrow, so few of their pieces are asked for again.
        known = token_ids(public_path(path, BYTE_LEVEL), most=150_000)
        end = np.asarray([end_id], "<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])
        for batch in batches:
            out: list[tuple] = []
            for doc, row, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), known.of_column(batch.column(2))):
                ids += end
                n = len(ids) // 4
                ends = range((n - 1) % capacity + 1, n + 1, capacity)
                start = 0
                for k, stop in enumerate(ends):
                    out.append((doc, row, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start = stop
            columns = list(zip(*out)) or [()] * len(schema)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string"))
    return rows.mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each used at most as often as it is there, whose sum comes nearest to `room` from below.

    Bit s of `reach` is set if some combination of the lengths seen so far sums to s. Longer lengths come first, so short ones are kept for later bins.
    """
    reach, mask, seen = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            wider = (reach | reach << length) & mask
            if wider == reach:
                break
            seen.append((length, reach))
            reach = wider
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, before in reversed(seen):
        if not before >> total & 1:
            chosen.append(length)
            total -= length
    return chosen


def combinations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Combinations of lengths, longest length first, and the number of bins that each fills; together they use all pieces."""
    left, found = {k: v for k, v in histogram.items() if v > 0}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        bin_ = [longest, *sorted(fullest({k: v for k, v in rest.items() if v}, capacity - longest), reverse=True)]
        use = {x: bin_.count(x) for x in bin_}
        times = min(left[x] // n for x, n in use.items())
        found.append((bin_, times))
        for x, n in use.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return found


def places(found: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number of ranks, first sequence, offset) for each item of each combination."""
    out, used, sequence = [], {}, 0
    for bin_, times in found:
        offset = 0
        for length in bin_:
            rank = used.get(length, 0)
            out.append((length, rank, times, sequence, offset))
            used[length] = rank + times
            offset += length
        sequence += times
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`cut` (doc_id, row, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = cut.sparkSession
    cut = checkpointed(cut)
    parts = 64 + cut.count() // PART
    cut = cut.withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.lit(parts)).cast("int"))
    counted = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    layout = spark.createDataFrame(places(combinations(histogram, capacity)), "at_length int, first long, times long, sequence long, offset long")
    before = counted.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("row", "piece")
    ranked = cut.withColumn("nth", F.row_number().over(within) - F.lit(1)).join(before, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth"))
    # The layout has a few rows for each length up to `capacity`, whatever the input.
    hit = (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("times"))
    return ranked.join(F.broadcast(layout), hit).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset"
    )


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(pieces(docs, path, capacity, end_id), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir))
