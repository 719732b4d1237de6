"""N-gram Jaccard join by MinHash banding with verification.

Texts that have the same words in the same order (A-Z as a-z, any white space between) are one text class at once. For
each class, MinHash values of its five-word shingles are cut into bands; the number of rows and bands follows from
the recall asked for at the threshold. A shuffle on band hashes links every class to the least of each band it is in, not to
all others there, so a band of n classes gives n - 1 rows. What is linked that way forms candidate groups.

Within a candidate group all pairs are verified on full shingle sets. A large group is cut into blocks; each pair
of blocks is a task of its own, which counts links and keeps a spanning forest of them. No pair leaves its task, and no group is
gathered in one. The forests of all tasks are joined to the final classes.

A document's class is the least id among the documents that links connect with it; its links are the other documents,
copies included, whose Jaccard similarity with it reaches the threshold. Texts of fewer than five words have all their words as the only
shingle. Null texts and texts without words link with nothing and keep their own id as class; rows with a null id have a null
class and no links. Repeated rows are copies of each other. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.llm.common import checkpointed, given_back, keyed_groups, spaced_words, table

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
#: More rows in a band keep texts that share a passage only out of the candidates.
ROWS = 8
#: Text classes of a large candidate group that one side of a verifying task holds, and documents of small groups in a task.
BLOCK = 256
MULTIPLIERS = np.uint64(0x9E3779B97F4A7C15)


def bands_for(recall: float = RECALL, threshold: float = THRESHOLD, rows: int = ROWS) -> int:
    """Bands of `rows` rows of which a pair at the threshold shares one with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def plain_words(text: bytes) -> list[bytes]:
    return spaced_words(text.lower())


def shingles(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """A hash of every `words` consecutive words; of all words if there are fewer."""
    width = min(words, len(hashes))
    if not width:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        total = total * MULTIPLIERS + mixed(hashes[k : k + len(total)] + np.uint64(k))
    return mixed(total + np.uint64(width))


class Signer:
    """Band hashes of texts."""

    def __init__(self, bands: int, rows: int = ROWS):
        rng = np.random.default_rng(23)
        self.bands, self.rows = bands, rows
        self.times = (rng.integers(1 << 31, size=bands * rows, dtype=np.uint32) * 2 + 1)[:, None].astype(np.uint32)
        self.plus = rng.integers(1 << 32, size=bands * rows, dtype=np.uint32)[:, None]
        self.powers = mixed(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        self.salts = mixed(np.arange(1000, 1000 + bands, dtype=np.uint64))

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))

    def band_hashes(self, grams: np.ndarray) -> np.ndarray:
        short = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        for k in range(0, len(short), 512):
            values = short[None, k : k + 512] * self.times
            values ^= self.plus
            np.minimum(least, values.min(1), out=least)
        parts = least.reshape(self.bands, self.rows).astype(np.uint64) * self.powers
        return mixed(parts.sum(1, dtype=np.uint64) + self.salts).view(np.int64)


def signatures(docs: DataFrame, bands: int) -> DataFrame:
    """doc_id, digest, key (128 bits of the text class, null without words) and bands of each row of `docs` (doc_id, digest, text)."""

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands)
        for batch in batches:
            keys, lists = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                words = plain_words(text or b"")
                if doc is None or not words:
                    keys.append(None)
                    lists.append(None)
                else:
                    keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    lists.append(signer.band_hashes(shingles(signer.hashes(words))))
            flat = np.concatenate([x for x in lists if x is not None] or [np.zeros(0, np.int64)])
            offsets = np.cumsum([0, *(0 if x is None else len(x) for x in lists)]).astype(np.int32)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc_id", "digest", "key", "bands"])

    return docs.select("doc_id", "digest", "text").mapInArrow(run, "doc_id long, digest long, key binary, bands array<long>")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node of each connected part; `edges` has longs a and b.

    Large and small stars in turn: nodes are hung on the least neighbour until every one hangs on its part's least node.
    Neighbours are only ever reduced to their least, so a node with very many of them is no burden.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def verified(nodes: list[int], sets: list[np.ndarray], side: np.ndarray, copies: np.ndarray, threshold: float) -> tuple[np.ndarray, list[int]]:
    """Links of each text class to others (weighted by their copies), and the least node that links lead to from it.

    Pairs are those within side 0 if there is only that, else those of a class of side 0 with one of side 1.
    """
    n = len(nodes)
    grams, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.asarray([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(inverse, kind="stable")
    posted, begins = owner[order], np.searchsorted(inverse[order], np.arange(len(grams) + 1))
    ends = np.cumsum(sizes)
    two = bool(side.any())
    links, root = np.zeros(n, np.int64), list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        if two and side[i]:
            continue
        own = inverse[ends[i] - sizes[i] : ends[i]]
        lengths = begins[own + 1] - begins[own]
        at = np.arange(lengths.sum()) + np.repeat(begins[own] - np.cumsum(lengths) + lengths, lengths)
        common = np.bincount(posted[at], minlength=n)
        near = common >= threshold * (sizes[i] + sizes - common) - 1e-9
        near &= side == 1 if two else np.arange(n) > i
        hit = np.flatnonzero(near)
        links[i] += copies[hit].sum()
        links[hit] += copies[i]
        for j in hit.tolist():
            a, b = find(i), find(j)
            if a != b:
                a, b = (a, b) if nodes[a] < nodes[b] else (b, a)
                root[b] = a
    return links, [nodes[find(i)] for i in range(n)]


def verify(tiles: DataFrame, threshold: float) -> DataFrame:
    """node, links and root for each text class of each tile; `tiles` has tile, part, side, node, copies and text, sorted by tile and part."""

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in keyed_groups(batches, "tile"):
            for part in keyed_groups(iter(group.to_batches()), "part"):
                first = {r["node"]: r for r in part.to_pylist()}  # a repeated row brings its text again
                rows = [first[k] for k in sorted(first)]
                if len(rows) < 2:
                    continue
                sets = []
                for r in rows:
                    words = plain_words(r["text"].encode())
                    sets.append(np.unique(shingles(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))))
                nodes = [r["node"] for r in rows]
                links, roots = verified(nodes, sets, np.asarray([r["side"] for r in rows]), np.asarray([r["copies"] for r in rows]), threshold)
                yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(links), pa.array(roots, pa.int64())], ["node", "links", "root"])

    return tiles.mapInArrow(run, "node long, links long, root long")


def join_near(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, digest (a hash of the text), class_id, n_links and n_copies (rows of the text class) of each row of `docs`."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("digest"), text.alias("text"))
    signed = checkpointed(signatures(rows, bands_for(recall, threshold)))
    classes = signed.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct("doc_id", "digest")).alias("least"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"))
    classes = checkpointed(classes.select("key", F.col("least.doc_id").alias("least"), F.col("least.digest").alias("digest"), "copies", "bands", F.monotonically_increasing_id().alias("node")))

    in_bands = classes.select("node", F.explode("bands").alias("band"))
    heads = in_bands.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head < tail").drop("tail")
    candidates = components(in_bands.join(heads, "band").select(F.col("node").alias("a"), F.col("head").alias("b")))

    sizes = candidates.groupBy("component").agg(F.count("*").alias("size"))
    members = candidates.join(sizes, "component").join(classes.select("node", "least", "digest", "copies"), "node")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    members = checkpointed(members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")))
    # Small groups share tasks by a hash; block i of a large one meets every block j, as side 1 where the other is before it.
    together = max(1, members.where("blocks = 1").count() // BLOCK)
    small = members.where("blocks = 1").withColumn("tile", F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(together)))).withColumn("side", F.lit(0))
    large = members.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.withColumn("side", (F.col("block") > F.col("other")).cast("int"))
    large = large.withColumn("tile", F.concat_ws("/", "component", F.least("block", "other"), F.greatest("block", "other"))).drop("other")
    placed = small.unionByName(large).select("tile", F.col("component").alias("part"), "side", "node", "copies", F.col("least").alias("doc_id"), "digest")
    tiles = placed.join(rows.where(F.col("doc_id").isNotNull()), ["doc_id", "digest"]).drop("doc_id", "digest")
    found = checkpointed(verify(tiles.repartition("tile").sortWithinPartitions("tile", "part"), threshold))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = classes.select("key", "node", "least", "copies").join(joined, "node", "left").join(links, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    ids = known.groupBy("component").agg(F.min("least").alias("class_id"))
    known = known.join(ids, "component").select("key", "class_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = signed.select("doc_id", "digest", "key").where(F.col("key").isNotNull()).join(known, "key")
    alone = signed.where(F.col("key").isNull())
    return out.select("doc_id", "digest", "class_id", F.col("links").alias("n_links"), F.col("copies").alias("n_copies")).unionByName(
        alone.select("doc_id", "digest", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    )


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_near(table(spark, sf_dir)).drop("digest")
