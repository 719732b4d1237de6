"""Removal of repeated passages by recompression.

A text is a string of word symbols. Rounds rewrite it: first every maximal run of one word becomes a symbol, then, round
after round, every symbol pair of a left and a right letter (by a bit of the letter's hash) becomes a symbol. A symbol's
name is a hash of what it stands for, so all tasks of all executors give the same name to the same content. Whether two
letters are joined depends on them and on their neighbours alone; each symbol carries the stretch of words that its existence
depends on. Equal passages hence consist of the same symbols inside, however their surroundings differ.

A window is `WINDOW` consecutive words. Of the symbols whose stretch lies within a window, the longest one (ties by hash)
is its anchor; if there is none, the same is tried with the symbols before the first pair round. That is a function of the window's
words only, so equal windows have equal anchors. A window without any such symbol, as in a long run of one word, is its own anchor. Spark finds the anchors that more than one document has.
Only windows at shared anchors can occur in two documents; those are compared with a 128-bit hash of their words, and
a window that also occurs in a document with a smaller id is removed with all its words.

Words are [^\\x20\\x09-\\x0D]+ of the whole text; null and empty texts have none. Rows with a null id neither lose words nor
take any from others. Copies of a whole text are found by a 128-bit hash first, and only the one with the least id is compared by windows. Rows with the same id do not count as other documents; each repeated row loses the same words.
Texts of fewer words than a window stay. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.llm.common import Remembered, as_type, checkpointed, given_back, quoted, shared_dir, spaced_words, table, with_fields

WINDOW = 50
ROUNDS = 4
#: Symbols of more words are not joined further, runs apart.
LONGEST = 16
#: Words that are handled at once.
TOGETHER = 250_000
ODD = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = (x ^ np.uint64((seed * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Text:
    """Documents' words one after another, with a barrier before the first, between two, and behind the last."""

    def __init__(self, documents: list[list[int]]):
        lengths = np.asarray([len(d) for d in documents], np.int64)
        self.starts = np.cumsum(lengths + 1) - lengths
        self.stops = self.starts + lengths
        size = int(lengths.sum()) + len(documents) + 1
        self.words = np.zeros(size, np.uint64)
        self.barrier = np.zeros(size, bool)
        self.barrier[0] = True
        self.barrier[self.stops] = True
        self.words[~self.barrier] = np.fromiter((w for d in documents for w in d), np.uint64, int(lengths.sum()))
        self.size = size


def recompressed(text: Text, rounds: int = ROUNDS, longest: int = LONGEST):
    """Names, lengths and stretches [low, high) of the symbols after all rounds. Stretches rise from symbol to symbol."""
    words, barrier = text.words, text.barrier
    new = np.ones(text.size, bool)
    new[1:] = (words[1:] != words[:-1]) | barrier[1:] | barrier[:-1]
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, text.size))
    wall = barrier[start]
    name = mixed(words[start] + length.astype(np.uint64) * ODD, 1)
    low = np.where(wall, start, start - 1)
    high = np.where(wall, start + 1, start + length + 1)
    for k in range(rounds):
        right = mixed(name, 2 + k) >> np.uint64(63) == 1
        join = np.zeros(len(name), bool)
        join[:-1] = ~right[:-1] & right[1:] & ~wall[:-1] & ~wall[1:] & (length[:-1] + length[1:] <= longest)
        joined = np.zeros(len(name), bool)
        joined[1:] = join[:-1]
        # A pair exists where both its letters do; a letter that stays alone also depends on the neighbour it might have joined.
        far = high.copy()
        ahead = ~right & ~wall
        ahead[-1] = False
        far[:-1][ahead[:-1]] = np.maximum(high[:-1], high[1:])[ahead[:-1]]
        near = low.copy()
        behind = right & ~joined & ~wall
        behind[0] = False
        near[1:][behind[1:]] = np.minimum(low[1:], low[:-1])[behind[1:]]
        name[:-1][join[:-1]] = mixed(name[:-1] * ODD + mixed(name[1:], 50 + k), 100 + k)[join[:-1]]
        length[:-1][join[:-1]] += length[1:][join[:-1]]
        kept = ~joined
        name, length, low, high, wall = name[kept], length[kept], near[kept], far[kept], wall[kept]
    return name, length, low, high


def window_hashes(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of the words of each window, by its first word."""
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words) - 1, ODD)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(words, seed) * powers)])
    inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(count - 1, BACK)]))
    return mixed((sums[width:] - sums[:-width]) * inverse, seed + 1)


def anchors(text: Text, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows, and the anchor of each."""
    count = max(0, text.size - width + 1)
    walls = np.concatenate([[0], np.cumsum(text.barrier)])
    at = np.flatnonzero(walls[width:] == walls[:-width]) if count else np.zeros(0, np.int64)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    found = window_hashes(text.words, width, 30)[at] | np.uint64(31) << np.uint64(59)
    open_ = np.arange(len(at))
    for rounds in (ROUNDS, 0):
        name, length, low, high = recompressed(text, rounds)
        # The longest symbols have the least rank.
        rank = (mixed(name, 7) >> np.uint64(5)) | ((30 - np.minimum(length, 30)).astype(np.uint64) << np.uint64(59))
        first = np.concatenate([[0], np.cumsum(np.bincount(low, minlength=text.size + 1))])[at[open_]]
        last = np.cumsum(np.bincount(high, minlength=text.size + 2))[at[open_] + width] - 1
        inside = last - first + 1
        least, step = rank, 1
        while step <= inside.max(initial=0):
            here = (inside >= step) & (inside < 2 * step)
            found[open_[here]] = np.minimum(least[first[here]], least[last[here] - step + 1])
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        open_ = open_[inside < 1]
        if not len(open_):
            break
    return at, found


def hashed(known: Remembered, words: list[bytes]) -> list[int]:
    return list(map(known.__getitem__, words))


def batches_of(rows: Iterator[tuple], words_at: int) -> Iterator[list[tuple]]:
    """Rows in lists of about TOGETHER words."""
    some, total = [], 0
    for row in rows:
        some.append(row)
        total += len(row[words_at])
        if total >= TOGETHER:
            yield some
            some, total = [], 0
    if some:
        yield some


def _rows(batches: Iterator[pa.RecordBatch], known: Remembered) -> Iterator[tuple]:
    """(values of all columns but the text, words, hashes of the words); the text is the last column."""
    for batch in batches:
        values = [c.to_pylist() for c in batch.columns[:-1]]
        texts = batch.columns[-1].cast(pa.binary()).to_pylist()
        for k, text in enumerate(texts):
            words = spaced_words(text or b"")
            yield [v[k] for v in values], words, hashed(known, words)


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


@given_back
def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Remembered(xxhash.xxh64_intdigest)
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("whole", pa.binary()), ("anchors", pa.list_(pa.int64()))])
    for some in batches_of(((v, w, h) for v, w, h in _rows(batches, known) if len(w) >= WINDOW), 1):
        text = Text([h for _, _, h in some])
        at, found = anchors(text)
        cuts = np.searchsorted(at, [*text.starts, text.size])
        own = [np.unique(_as_long(found[a:b])) for a, b in zip(cuts, cuts[1:])]
        lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, own)]).astype(np.int32), pa.array(np.concatenate(own)))
        whole = [xxhash.xxh3_128_digest(b" ".join(w)) for _, w, _ in some]
        yield pa.record_batch([*(pa.array([v[k] for v, _, _ in some], pa.int64()) for k in (0, 1)), pa.array(whole, pa.binary()), lists], schema=schema)


@given_back
def find_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 128-bit hashes of the windows at shared anchors: columns doc_id, digest, shared, later (those that a smaller id has), text."""
    known = Remembered(xxhash.xxh64_intdigest)
    names = ["doc_id", "digest", "first", "one", "two", "later"]
    for some in batches_of(_rows(batches, known), 1):
        text = Text([h for _, _, h in some])
        at, found = anchors(text)
        cuts = np.searchsorted(at, [*text.starts, text.size])
        chosen = np.concatenate([np.isin(_as_long(found[a:b]), v[2]) for (v, _, _), a, b in zip(some, cuts, cuts[1:])])
        owner = np.repeat(np.arange(len(some)), np.diff(cuts))[chosen]
        at = at[chosen]
        one, two = (window_hashes(text.words, WINDOW, seed)[at] for seed in (40, 60))
        ids, digests = (np.asarray([v[k] for v, _, _ in some], np.int64)[owner] for k in (0, 1))
        later = np.concatenate([np.isin(_as_long(found[a:b]), v[3]) for (v, _, _), a, b in zip(some, cuts, cuts[1:])])[chosen]
        yield pa.record_batch([pa.array(ids), pa.array(digests), pa.array((at - text.starts[owner]).astype(np.int32)), pa.array(_as_long(one)), pa.array(_as_long(two)), pa.array(later)], names)


@given_back
def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, firsts (windows to remove, or null), text and any others; gives counts, digest and text left for each row, and the others."""
    names = ["n_words", "n_removed", "kept_sha256", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        out = []
        for firsts, text in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
            words = kept = spaced_words(text or b"")
            if firsts == [-1]:
                kept = []
            elif firsts:
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, firsts, 1)
                np.add.at(change, np.asarray(firsts) + WINDOW, -1)
                kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
            joined = b" ".join(kept)
            out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined if firsts else text))
        columns = [pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, kinds)]
        yield pa.record_batch([batch.column(0), *columns[:3], columns[3].cast(pa.string()), *batch.columns[3:]], ["doc_id", *names, *batch.schema.names[3:]])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, digest and `firsts` of the windows that also occur in a document with a smaller id; -1 alone stands for all words.

    `docs` has doc_id, digest (a hash of the text; it tells repeated ids with other texts apart) and text.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/anchors-{uuid.uuid4().hex}"
    docs.select("doc_id", "digest", "text").mapInArrow(find_anchors, "doc_id long, digest long, whole binary, anchors array<long>").write.parquet(folder)
    found = spark.read.parquet(folder)
    # Every word of a later copy is in a window that the first copy has too.
    least = found.groupBy("whole").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("whole", "least")
    copies = checkpointed(found.select("doc_id", "digest", "whole").join(least, "whole").where("least < doc_id").select("doc_id", "digest").distinct())
    each = found.select("doc_id", "digest", "anchors").join(copies, ["doc_id", "digest"], "left_anti").select("doc_id", "digest", F.explode("anchors").alias("anchor"))
    shared = checkpointed(each.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("anchor", "least"))
    later = F.when(F.col("least") < F.col("doc_id"), F.col("anchor"))
    hits = each.join(shared, "anchor").groupBy("doc_id", "digest").agg(F.collect_set("anchor").alias("shared"), F.collect_set(later).alias("later"))
    asked = docs.join(hits, ["doc_id", "digest"]).select("doc_id", "digest", "shared", "later", "text")
    windows = asked.mapInArrow(find_windows, "doc_id long, digest long, first int, one long, two long, later boolean")
    earliest = windows.groupBy("one", "two").agg(F.min("doc_id").alias("least"))
    # A window whose anchor no smaller id has is in no document with a smaller id.
    repeated = windows.where("later").join(earliest, ["one", "two"]).where("least < doc_id")
    firsts = repeated.groupBy("doc_id", "digest").agg(F.collect_set("first").alias("firsts"))
    return firsts.unionByName(copies.withColumn("firsts", F.array(F.lit(-1))))


def deduplicate(docs: DataFrame, carried: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept of each row of `docs`, and with `carried` its other columns as a struct of that name.

    `kept` is the text as it was, or if it lost words, the words left with single spaces.
    """
    text = as_type(docs, "text", "string")
    others = [F.struct(*[F.col(quoted(c)) for c in docs.columns if c != "text"]).alias("carried")] * carried
    rows = docs.select(as_type(docs, "doc_id", "bigint"), F.xxhash64(text).alias("digest"), text, *others)
    more = ["carried"] * carried
    known = rows.where(F.col("doc_id").isNotNull())
    found = repeated_windows(known)
    marked = known.join(found, ["doc_id", "digest"], "left").select("doc_id", "firsts", "text", *more)
    nameless = rows.where(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("array<int>").alias("firsts"), "text", *more)
    schema = with_fields("doc_id long, n_words long, n_removed long, kept_sha256 string, kept string", *(rows.schema[x] for x in more))
    return marked.unionByName(nameless).mapInArrow(remove, schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir)).drop("kept")
