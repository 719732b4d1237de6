"""Language identification of words by a linear-chain conditional random field.

Every word of a text gets a label. A word's potentials come from its affixes, character n-grams, itself and the
lexicon of each language (the words that the training sample holds for it alone); learned transitions tie neighbours
together, and forward-backward gives each word's distribution over labels, also in text that switches between
languages. A document's language is the one with the most expected words; its score is their part.

Trained by gradient ascent on sequences that join pieces of documents of different languages, from at most
`TRAIN_DOCS` documents of each language, chosen by a hash of their ids and used whole. Languages and their order come from the data.
A text that is null or has no letter is `und` with score 0, and so is every text if nothing is labelled. Repeated rows
give repeated rows; an empty table gives none; rows with a null id are predicted but not learned from. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewatch.llm.common import given_back, held_out, letters_and_digits, quoted, table, with_fields

TRAIN_DOCS = 150
#: Words of a piece of one language, and pieces of a training sequence.
PIECE, PIECES = 12, 6
FEATURES = 1 << 17
EPOCHS = 40
RATE = 0.15
DECAY = 1e-4
LEXICON_LEAST = 3
SEED = 11
#: Bytes of text that are handled at once (a longer text alone), and words whose potentials are remembered.
TOGETHER = 1_000_000
REMEMBERED = 300_000
LETTER = regex.compile(r"\p{L}")


def words_of(text: str | None) -> list[bytes]:
    return letters_and_digits((text or "").lower().encode("utf-8", "replace"))


def features(word: bytes, lexicons: dict[bytes, int]) -> list[int]:
    """Hashes of the word, its affixes, its n-grams and the lexicon that holds it."""
    w = b"^" + word + b"$"
    found = {b"w" + word}
    for n in (2, 3, 4):
        found.add(b"p" + w[:n])
        found.add(b"s" + w[-n:])
    found.update(b"g" + w[i : i + 2] for i in range(len(w) - 1))
    found.update(b"g" + w[i : i + 3] for i in range(len(w) - 2))
    if word in lexicons:
        found.add(b"l%d" % lexicons[word])
    return [zlib.crc32(f) % FEATURES for f in found]


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, first: np.ndarray, pairs: bool = False):
    """Each word's distribution over labels, and with `pairs` the expected transitions and first labels.

    Sequences lie one after another in `emissions` (positive potentials), the longest first; all of them move on together by a word.
    """
    starts = np.cumsum(lengths) - lengths
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # sequences longer than t
    alpha = np.empty_like(emissions)
    beta = np.empty_like(emissions)
    now = first * emissions[starts]
    for t in range(longest):
        n = active[t]
        at = starts[:n] + t
        if t:
            now = (now[:n] @ transitions) * emissions[at]
        now /= now.sum(1, keepdims=True)
        alpha[at] = now
    expected = np.zeros_like(transitions)
    back = np.ones((0, len(first)), emissions.dtype)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        later = active[t + 1] if t + 1 < longest else 0
        now = np.ones((n, len(first)), emissions.dtype)
        if later:
            ahead = emissions[at[:later] + 1] * back
            now[:later] = ahead @ transitions.T
            if pairs:
                norm = (alpha[at[:later]] * now[:later]).sum(1, keepdims=True)
                expected += (alpha[at[:later]] / norm).T @ ahead
        back = now / now.sum(1, keepdims=True)
        beta[at] = back
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    return (gamma, expected * transitions, gamma[starts]) if pairs else gamma


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray, first: np.ndarray, lexicons: dict[bytes, int]):
        self.languages, self.weights, self.transitions, self.first, self.lexicons = languages, weights, transitions, first, lexicons
        self.known: dict[bytes, int] = {}
        self.rows = array("f")

    def forget(self) -> None:
        self.known = {}
        self.rows = array("f")

    def potentials(self, words: list[bytes]) -> np.ndarray:
        """exp of each word's potentials, divided by the largest."""
        if len(self.known) > REMEMBERED:
            self.forget()
        known = self.known
        new = [w for w in set(words) if w not in known]
        for k in range(0, len(new), 5_000):
            part = new[k : k + 5_000]
            bags = [features(w, self.lexicons) for w in part]
            sizes = np.asarray([len(b) for b in bags])
            sums = np.add.reduceat(self.weights[np.concatenate(bags)], np.cumsum(sizes) - sizes, axis=0)
            known.update(zip(part, range(len(known), len(known) + len(part))))
            self.rows.frombytes(np.exp(sums - sums.max(1, keepdims=True)).astype(np.float32).tobytes())
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return np.maximum(np.frombuffer(self.rows, np.float32).reshape(-1, len(self.languages))[at], 1e-12)

    def predict(self, texts: list[str | None] | pa.Array) -> list[tuple[str, float]]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.languages:
            return out
        # Texts of like length go together, since all sequences move on with the longest one.
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        ends = np.cumsum(sizes[order])
        k = 0
        while k < len(order):
            end = max(k + 1, int(np.searchsorted(ends, ends[k] - sizes[order[k]] + TOGETHER, side="right")))
            part = order[k:end]
            some = [(at, words_of(text)) for at, text in zip(part.tolist(), texts.take(pa.array(part)).to_pylist()) if LETTER.search(text)]
            some = sorted(((at, words) for at, words in some if words), key=lambda x: -len(x[1]))
            k = end
            if not some:
                continue
            lengths = np.asarray([len(w) for _, w in some])
            emissions = self.potentials([w for _, ws in some for w in ws])
            gamma = forward_backward(emissions, lengths, self.transitions, self.first)
            parts = np.add.reduceat(gamma, np.cumsum(lengths) - lengths, axis=0, dtype=np.float64) / lengths[:, None]
            best = parts.argmax(1)
            for (at, _), b, p in zip(some, best.tolist(), parts[np.arange(len(best)), best].tolist()):
                out[at] = (self.languages[b], min(1.0, p))
        return out


def train(texts: list[str], langs: list[str], seed: int = SEED) -> Model:
    languages = sorted(set(langs))
    label = {x: k for k, x in enumerate(languages)}
    documents = [(words_of(t), label[x]) for t, x in zip(texts, langs)]
    documents = [(w, x) for w, x in documents if w]
    if not documents:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros((0, 0)), np.zeros(0), {})
    counts: dict[bytes, Counter] = {}
    for words, x in documents:
        for w in words:
            counts.setdefault(w, Counter())[x] += 1
    lexicons = {w: x for w, c in counts.items() for x, n in c.items() if n >= LEXICON_LEAST and n >= 0.95 * sum(c.values())}
    rng = np.random.default_rng(seed)
    pieces = [(words[i : i + PIECE], x) for words, x in documents for i in range(0, len(words), PIECE)]
    order = rng.permutation(len(pieces))
    sequences = [[pieces[i] for i in order[k : k + PIECES]] for k in range(0, len(order), PIECES)]
    sequences.sort(key=lambda s: -sum(len(w) for w, _ in s))
    lengths = np.asarray([sum(len(w) for w, _ in s) for s in sequences])
    truth = np.asarray([x for s in sequences for w, x in s for _ in w])
    number = {w: k for k, w in enumerate(counts)}
    tokens = np.asarray([number[w] for s in sequences for ws, _ in s for w in ws])
    bags = [features(w, lexicons) for w in counts]
    sizes = np.asarray([len(b) for b in bags])
    flat = np.concatenate(bags)
    begins = np.cumsum(sizes) - sizes
    by_feature = np.argsort(flat, kind="stable")
    there, feature_begins = np.unique(flat[by_feature], return_index=True)
    word_of = np.repeat(np.arange(len(bags)), sizes)[by_feature]
    by_word = np.argsort(tokens, kind="stable")
    word_begins = np.searchsorted(tokens[by_word], np.arange(len(bags)))
    n, starts = len(languages), np.cumsum(lengths) - lengths
    inside = np.ones(len(truth), bool)
    inside[starts] = False
    follows = np.zeros((n, n))
    np.add.at(follows, (truth[np.flatnonzero(inside) - 1], truth[inside]), 1)
    opens = np.bincount(truth[starts], minlength=n).astype(float)
    weights = np.zeros((FEATURES, n), np.float32)
    moves, begin = np.zeros((n, n)), np.zeros(n)
    parameters = [weights, moves, begin]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in parameters]
    for epoch in range(1, EPOCHS + 1):
        sums = np.add.reduceat(weights[flat], begins, axis=0)
        emissions = np.exp(sums - sums.max(1, keepdims=True)).astype(np.float64)[tokens] + 1e-12
        gamma, pairs, firsts = forward_backward(emissions, lengths, np.exp(moves), np.exp(begin), pairs=True)
        error = -gamma
        error[np.arange(len(truth)), truth] += 1
        by_words = np.add.reduceat(error[by_word], word_begins, axis=0)
        gradient = np.zeros((FEATURES, n))
        gradient[there] = np.add.reduceat(by_words[word_of], feature_begins, axis=0)
        steps = [gradient / len(truth) - DECAY * weights, (follows - pairs) / len(truth), (opens - firsts.sum(0)) / len(starts)]
        for parameter, step, (first, second) in zip(parameters, steps, state):
            first += 0.1 * (step - first)
            second += 0.05 * (step * step - second)
            parameter += (RATE * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.95**epoch)) + 1e-5)).astype(parameter.dtype)
    transitions = np.exp(moves - moves.max()).astype(np.float32)
    return Model(languages, weights, transitions, np.exp(begin - begin.max()).astype(np.float32), lexicons)


def training_rows(docs: DataFrame, most: int = TRAIN_DOCS) -> list:
    """At most `most` labelled documents of each language outside the held-out part, in the order of a hash of their ids."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(5, 0)).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(SEED), F.col("doc_id")), "doc_id")
    chosen = usable.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth")
    texts = docs.select("doc_id", "lang", "text").where(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(chosen), ["doc_id", "lang"]).collect()  # `most` ids of each language
    return sorted(rows, key=lambda r: (r["doc_id"], r["lang"], r["text"]))


def identify(docs: DataFrame, most: int = TRAIN_DOCS, carried: bool = False, least: float | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of `docs` (doc_id, text, lang), and with `carried` its text and its other
    columns as a struct of that name. With `least` only rows with a language of at least that score."""
    rows = training_rows(docs, most)
    model = train([r["text"] for r in rows], [r["lang"] for r in rows])
    names = ["doc_id", "held_out", "lang_pred", "score", *["text", "carried"] * carried]

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = list(zip(*model.predict(batch.column(2)))) or [(), ()]
            more = batch.columns[2:4] if carried else []
            out = pa.record_batch([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *more], names)
            yield out if least is None else out.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, scores)], pa.bool_()))
        model.forget()

    others = [F.struct(*[F.col(quoted(c)) for c in docs.columns if c != "text"]).alias("carried")] * carried
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(5, 0).alias("held_out"), F.col("text").cast("string").alias("text"), *others)
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return asked.mapInArrow(run, with_fields(schema, *asked.schema.fields[2:]) if carried else schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir))
