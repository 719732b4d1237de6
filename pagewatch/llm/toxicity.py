"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and itself, hashed into buckets with an embedding each. A piece of a text
(so many consecutive words) is the mean of the embeddings in it, and a linear softmax gives the piece's probabilities.
Embeddings and softmax are trained together in numpy. Labels belong to whole texts while a few words make a text
toxic, so the first epochs give every piece its text's label, and later ones only the piece of a toxic text that
scores highest. A text's score is that of its highest piece, so all of it counts and a long text does not thin it out.
Unseen misspellings share n-grams with words that were seen.

Trained on a sample of at most `TRAIN_TOXIC` and `TRAIN_CLEAN` labelled documents, chosen by a hash of their ids;
each is used whole. Empty and null texts get the score of an empty bag. Rows with a null id are scored but never trained on. Repeated rows give
repeated rows; an empty table gives none. Without labels of both kinds all scores are 0. Only doc_id, text and toxic are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.llm.common import held_out, letters_and_digits, table

TRAIN_TOXIC = 600
TRAIN_CLEAN = 1500
PIECE = 2
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
DIMENSIONS = 4
SHORTEST, LONGEST = 3, 6
#: Subwords of fewer training texts get no embedding; of few toxic texts, one in so many is enough.
LEAST_TEXTS, OF_TOXIC = 12, 30
FIRST_EPOCHS, LATER_EPOCHS = 15, 35
RATE = 0.3
DECAY = 1e-5
THRESHOLD = 0.3
SEED = 7


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of each marked word and of the word itself, one word after another, and how many each word has.

    Grams are of bytes, so those of accented letters are a little shorter.
    """
    marked = np.frombuffer(b"".join([b"<%b>" % w for w in words]), np.uint8).astype(np.uint64)
    lengths = np.asarray([len(w) + 2 for w in words])
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(marked))
    hashes = marked + np.uint64(1)
    grams, owners = [], []
    for n in range(2, LONGEST + 1):
        later = np.append(marked[n - 1 :], np.zeros(min(n - 1, len(marked)), np.uint64))
        hashes = (hashes ^ (later + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        if n >= SHORTEST:
            whole = at + n <= ends
            grams.append((hashes[whole] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKET_BITS))
            owners.append(owner[whole])
    grams.append(np.asarray([zlib.crc32(w) >> 32 - BUCKET_BITS for w in words], np.uint64))
    owners.append(np.arange(len(words)))
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(grams)[order].astype(np.int64), np.bincount(owners, minlength=len(words))


def words_of(text: str | None) -> list[bytes]:
    return letters_and_digits((text or "").lower().encode("utf-8", "replace"))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups that begin at `starts` and are not empty."""
    return np.add.reduceat(values, starts, axis=0) if len(starts) else np.zeros((0, *values.shape[1:]), values.dtype)


def _by(keys: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that groups equal keys, the keys that occur, and where each begins."""
    order = np.argsort(keys, kind="stable")
    n = np.bincount(keys, minlength=count)
    there = np.flatnonzero(n)
    return order, there, (np.cumsum(n) - n)[there]


def train(texts: list[str], toxic: list[int], seed: int = SEED) -> tuple[np.ndarray, float]:
    """Each bucket's part of the difference of the two logits (embedding times weights), and the difference of the biases."""
    words = [words_of(t) for t in texts]
    y_text = np.asarray(toxic)
    distinct = sorted({w for ws in words for w in ws})
    number = {w: k for k, w in enumerate(distinct)}
    cut = [subwords(distinct[k : k + 10_000]) for k in range(0, len(distinct), 10_000)]  # a part at a time, for the sake of memory
    grams = np.concatenate([np.zeros(0, np.int32), *(g.astype(np.int32) for g, _ in cut)])
    sizes = np.concatenate([np.zeros(0, np.int64), *(n for _, n in cut)])
    del cut
    begins = np.cumsum(sizes) - sizes
    seen = np.zeros(BUCKETS, np.int32)
    for ws in words:
        own = np.asarray(sorted({number[w] for w in ws}), np.int64)
        at = np.repeat(begins[own] - np.cumsum(sizes[own]) + sizes[own], sizes[own]) + np.arange(sizes[own].sum())
        seen[np.unique(grams[at])] += 1
    kept = np.flatnonzero(seen >= min(LEAST_TEXTS, max(2, sum(toxic) // OF_TOXIC)))
    if not len(kept) or len(set(toxic)) < 2:
        return np.zeros(BUCKETS, np.float32), -np.inf
    slot = np.full(BUCKETS, -1, np.int32)
    slot[kept] = np.arange(len(kept))
    has = slot[grams] >= 0
    flat = slot[grams][has]
    owner = np.repeat(np.arange(len(distinct), dtype=np.int32), sizes)[has]
    sizes = sizes.astype(np.float32)  # with subwords that have no embedding
    _, words_there, word_starts = _by(owner, len(distinct))
    to_slot, slots_there, slot_starts = _by(flat, len(kept))
    flat_word = owner[to_slot]
    tokens = np.asarray([number[w] for ws in words for w in ws], np.int32)
    pieces, text_of_piece, at = [], [], 0
    for k, ws in enumerate(words):
        for i in range(0, len(ws), PIECE):
            pieces.append(at + i)
            text_of_piece.append(k)
        at += len(ws)
    pieces, text_of_piece = np.asarray(pieces), np.asarray(text_of_piece)
    piece_of = np.repeat(np.arange(len(pieces)), np.diff([*pieces, len(tokens)]))
    to_word, tokens_there, token_starts = _by(tokens, len(distinct))
    per_piece = 1.0 / _sums(sizes[tokens], pieces)[:, None]
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.05, (len(kept), DIMENSIONS)).astype(np.float32)
    weights, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (embeddings, weights, bias)]
    y = y_text[text_of_piece]
    for epoch in range(FIRST_EPOCHS + LATER_EPOCHS):
        word_vectors = np.zeros((len(distinct), DIMENSIONS), np.float32)
        word_vectors[words_there] = _sums(embeddings[flat], word_starts)
        means = _sums(word_vectors[tokens], pieces) * per_piece
        logits = means @ weights + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        counts = np.ones(len(pieces), np.float32)
        if epoch >= FIRST_EPOCHS:
            order = np.lexsort((p[:, 1], text_of_piece))
            highest = np.zeros(len(pieces), bool)
            highest[order[np.flatnonzero(np.append(np.diff(text_of_piece[order]) != 0, True))]] = True
            counts[(y == 1) & ~highest] = 0
            # Half the weight of clean texts is on their highest pieces too, which are the ones that decide.
            counts[(y == 0) & highest] += (y == 0).sum() / max(1, ((y == 0) & highest).sum())
        share = np.where(y == 1, counts / max(1, (counts * (y == 1)).sum()), counts / max(1, (counts * (y == 0)).sum())) / 2
        error = p.copy()
        error[np.arange(len(y)), y] -= 1
        error *= share[:, None]
        piece_gradient = (error @ weights.T) * per_piece
        word_gradient = np.zeros((len(distinct), DIMENSIONS), np.float32)
        word_gradient[tokens_there] = _sums(piece_gradient[piece_of[to_word]].astype(np.float32), token_starts)
        gradient = np.zeros_like(embeddings)
        gradient[slots_there] = _sums(word_gradient[flat_word], slot_starts)
        steps = (gradient + DECAY * embeddings, means.T @ error + DECAY * weights, error.sum(0))
        for parameter, step, (first, second) in zip((embeddings, weights, bias), steps, state):
            first += 0.1 * (step - first)
            second += 0.01 * (step * step - second)
            k = epoch + 1
            parameter -= (RATE * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-6)).astype(np.float32)
    parts = np.zeros(BUCKETS, np.float32)
    parts[kept] = embeddings @ (weights[:, 1] - weights[:, 0])
    return parts, float(bias[1] - bias[0])


class Scorer:
    """Scores of texts from the buckets' parts; each word's sum is remembered for a bounded number of words."""

    def __init__(self, parts: np.ndarray, bias: float, most: int = 400_000):
        self.parts, self.bias, self.most = parts, bias, most
        self.known: dict[bytes, tuple[float, int]] = {}

    def score(self, text: str | None) -> float:
        words = words_of(text)
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            if len(known) > self.most:
                known.clear()
                new = list(set(words))
            grams, sizes = subwords(new)
            sums = _sums(self.parts[grams], np.cumsum(sizes) - sizes)
            known.update(zip(new, zip(sums.tolist(), sizes.tolist())))
        if not words:
            logit = self.bias
        else:
            pairs = np.asarray([known[w] for w in words])
            totals = _sums(pairs, np.arange(0, len(words), PIECE))
            logit = float((totals[:, 0] / totals[:, 1]).max()) + self.bias
        return float(1 / (1 + np.exp(-min(max(logit, -700.0), 700.0)))) if np.isfinite(logit) else 0.0


def training_rows(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> list:
    """A bounded sample of labelled documents outside the held-out part, in the order of a hash of their ids."""
    usable = labels.where(~held_out(4, 2) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    order = [F.xxhash64(F.lit(SEED), F.col("doc_id")), F.col("doc_id")]
    chosen = usable.where("toxic = 1").orderBy(*order).limit(toxic).unionByName(usable.where("toxic = 0").orderBy(*order).limit(clean))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(chosen), "doc_id").collect()  # at most toxic + clean ids
    return sorted(rows, key=lambda r: (r["doc_id"], r["toxic"], r["text"]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of `docs`."""
    rows = training_rows(docs, labels)
    parts, bias = train([r["text"] for r in rows], [r["toxic"] for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(parts, bias)
        for batch in batches:
            scores = [scorer.score(t) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    asked = docs.select(F.col("doc_id").cast("long"), held_out(4, 2).alias("held_out"), F.col("text").cast("string"))
    return asked.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir), table(spark, sf_dir, "labels"))
