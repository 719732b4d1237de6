"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a table whose size is prime. The shards take turns; each claims
the first slot in its order of preference that is still free, until none is. A key then hashes to a slot, and the slot
names its shard: placement takes constant time, shards differ by at most one slot, and a shard that goes leaves nearly
all keys of the others where they are.

The table depends on shard names and size alone, never on the data: a fixed number of rows is broadcast. Null keys are
hashed as the empty text, repeated rows go to the same shard, an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.llm.common import table

SHARDS = 64
#: A prime, over a hundred times the number of shards.
SLOTS = 8191


def slot_number(key: Column, slots: int = SLOTS) -> Column:
    """The first 32 bits of the key's MD5, modulo the table's size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % slots


def filled_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard for each slot. `slots` must be prime and no less than the number of shards."""
    if not shards or slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards, and there must be a shard")
    order = []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        order.append((int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1))
    owner, tried, taken = [-1] * slots, [0] * len(shards), 0
    while True:
        for shard, (first, step) in enumerate(order):
            while owner[slot := (first + tried[shard] * step) % slots] >= 0:
                tried[shard] += 1
            owner[slot] = shard
            tried[shard] += 1
            taken += 1
            if taken == slots:
                return owner


def shard_names(count: int = SHARDS) -> list[str]:
    return [f"shard-{k:04d}" for k in range(count)]


def place(frame: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """`frame` with the number of its slot and the index of its shard, as columns slot and shard."""
    lookup = frame.sparkSession.createDataFrame(list(enumerate(filled_table(shards, slots))), "slot long, shard int")
    return frame.withColumn("slot", slot_number(F.col(key), slots)).join(F.broadcast(lookup), "slot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id")
    return place(docs, "doc_id", shard_names()).select("doc_id", "slot", "shard")


def op7_sql() -> str:
    owners = ", ".join(map(str, filled_table(shard_names())))
    return f"""
    WITH placed AS (
        SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {SLOTS} AS slot
        FROM documents)
    SELECT doc_id, slot, CAST(([{owners}])[slot + 1] AS INTEGER) AS shard FROM placed
    """
