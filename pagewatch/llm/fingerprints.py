"""Document fingerprints by I-Match.

Document frequencies of all words are counted over the whole corpus. The lexicon holds the words within a band of inverse
document frequency: neither those that most texts share nor those that hardly any other has. A text's distinct
lexicon words, in sorted order, are hashed once for each of several randomised subsets of the lexicon, and these hashes are the
fingerprint. Subsets come in levels that keep ever smaller parts of the lexicon, so texts of every length have subsets
with few of their words, which survive an edit elsewhere. The likeness of two fingerprints is the part of equal hashes among the
subsets that either text has words of, at the level where it is highest; 1 for equal fingerprints.

The lexicon's size is bounded whatever the number of documents: a word of the band is in at least exp(-HIGHEST_IDF) of all
documents, so there are at most exp(HIGHEST_IDF) (665) times the mean number of distinct words of a text. It is sent to all tasks.

A null text is empty. A text without words of the lexicon has only its last hash, of all its distinct words. Rows are ordered by
descending id, then by a hash of the text; rows with a null id come last. Repeated rows follow each other, so each is the
next of the one before. In a table of one row that row is its own next; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.llm.common import letters_and_digits, table, texts_as_bytes

LOWEST_IDF, HIGHEST_IDF = 2.3, 6.5
#: Each level keeps a word of the lexicon with this probability.
LEVELS = (1 / 4, 1 / 16, 1 / 64, 1 / 256, 1 / 1024)
SUBSETS = 12
#: Subsets of a level that must have words before the level tells anything.
LEAST_SUBSETS = 4
#: Distinct words that a counting task holds before it passes them on.
HELD = 300_000
#: Rows of a stretch of the order of ids that is handled in one piece.
STRETCH = 2000


def document_frequencies(docs: DataFrame) -> DataFrame:
    """word and the number of documents that hold it; the empty word stands for all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in texts_as_bytes(batch):
                counts.update(set(letters_and_digits(text)))
                counts[b""] += 1
                if len(counts) > HELD:
                    yield passed()
        yield passed()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, lowest: float = LOWEST_IDF, highest: float = HIGHEST_IDF) -> list[bytes]:
    documents = docs.count()
    if not documents:
        return []
    inside = (F.col("n") >= max(2, documents * math.exp(-highest))) & (F.col("n") <= documents * math.exp(-lowest)) & (F.length("word") > 0)
    return sorted(bytes(r["word"]) for r in document_frequencies(docs).where(inside).select("word").collect())


class Fingerprints:
    def __init__(self, words: list[bytes]):
        self.number = {w: k for k, w in enumerate(words)}
        self.hashes = np.asarray([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        subsets = len(LEVELS) * SUBSETS
        self.members = np.zeros((len(words), subsets), bool)
        for k in range(subsets):
            own = (self.hashes ^ np.uint64(xxhash.xxh64_intdigest(b"subset", seed=k))) * np.uint64(0x9E3779B97F4A7C15)
            own = (own ^ (own >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            kept = (own >> np.uint64(11)).astype(np.float64) / (1 << 53) < LEVELS[k // SUBSETS]
            self.members[:, k] = kept

    def of(self, text: str) -> np.ndarray:
        """16 bits for each subset (0 without a word of it), and for all distinct words of the text."""
        words = set(letters_and_digits(text.encode("utf-8", "replace")))
        terms = np.asarray(sorted([self.number[w] for w in words if w in self.number]), np.int64)
        out = np.zeros(len(LEVELS) * SUBSETS + 1, np.uint16)
        if len(terms):
            # The words are distinct and in one order, so a sum of their hashes stands for the sequence.
            sums = (self.members[terms] * self.hashes[terms, None]).sum(0, dtype=np.uint64)
            some = self.members[terms].any(0)
            mixed = (sums ^ (sums >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            out[:-1] = np.where(some, np.maximum(mixed >> np.uint64(48), 1), 0)
        out[-1] = xxhash.xxh64_intdigest(b" ".join(sorted(words))) & 0xFFFF
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if (a == b).all():
        return 1.0
    one, two = a[:-1].reshape(-1, SUBSETS), b[:-1].reshape(-1, SUBSETS)
    either = ((one > 0) | (two > 0)).sum(1)
    same = ((one == two) & (one > 0)).sum(1)
    told = either >= LEAST_SUBSETS
    if told.any():
        return float((same[told] / either[told]).max())
    return float(same.sum() / either.sum()) if either.any() else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first characters of the next one, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def stretches(rows: DataFrame, size: int) -> list[tuple[int, int]]:
    """The first (negated id, digest) of each stretch of about `size` rows in the order; `rows` has at, digest."""
    parts = max(1, -(-rows.count() // size))
    dealt = rows.select("at", "digest").repartitionByRange(parts, "at", "digest").withColumn("part", F.spark_partition_id())
    heads = dealt.groupBy("part").agg(F.min(F.struct("at", "digest")).alias("head")).collect()  # a row for each stretch
    return sorted((r["head"]["at"], r["head"]["digest"]) for r in heads)


def in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows stretch, guest, at, digest, doc_id, text, and the number of stretches.

    A stretch holds consecutive rows of the order, and behind them as a guest the first row of the next stretch (of the
    first, in the last one).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # ~id turns the order around without overflow; null ids come last.
    at = F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit((1 << 63) - 1))
    rows = docs.select(at.alias("at"), F.xxhash64(text).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    heads = stretches(rows, STRETCH)
    before = {head: (k - 1) % len(heads) for k, head in enumerate(heads)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["stretch", "guest", "at", "digest", "doc_id", "text"]
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            guests = [k for k, key in enumerate(keys) if key in before]
            for taken, part, guest in (
                (batch, [bisect_right(heads, key) - 1 for key in keys], False),
                (batch.take(pa.array(guests, pa.int64())), [before[keys[k]] for k in guests], True),
            ):
                yield pa.record_batch([pa.array(part, pa.int32()), pa.array([guest] * len(part), pa.bool_()), *taken.columns], names)

    kinds = "stretch int, guest boolean, at long, digest long, doc_id long, text string"
    return rows.mapInArrow(run, kinds), max(1, len(heads))


def fingerprints(docs: DataFrame) -> DataFrame:
    """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row of `docs` (doc_id, text)."""
    words = lexicon(docs)
    ordered, count = in_order(docs)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def shown(fingerprint: np.ndarray) -> str:
        return fingerprint.astype(">u2").tobytes().hex()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(words)
        last = None  # (stretch, id, text, fingerprint) of the row whose next is still to come
        for batch in batches:
            out = []
            for stretch, guest, doc, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4, 5))):
                own = prints.of(text)
                if last is not None and last[0] == stretch:
                    changed = edited(last[2], text)
                    other = prints.of(changed)
                    digest = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
                    out.append((last[1], len(last[2]), digest, shown(last[3]), shown(other), likeness(last[3], other), likeness(last[3], own)))
                # Rows that repeat a guest find no row before them.
                last = None if guest else (stretch, doc, text, own)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(names), kinds)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    sorted_rows = ordered.repartition(count, "stretch").sortWithinPartitions("stretch", "guest", "at", "digest")
    return sorted_rows.mapInArrow(run, schema)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir))
