"""Alignment of two tokenizers' tokens over the same texts.

A is a byte-level tokenizer, B a piece tokenizer; both see the text with a space before it. Where a token of A and one of B both
end, a group of tokens ends; all tokens of A in a group are linked to all of B in it. The cuts come from the libraries' own
spans: A's character offsets and B's spans in its protocol message. Spans are coarse where tokens share a character: then the
spans of neighbours overlap, or are empty. Such stretches are refined by the bytes that their tokens decode to.

No token of either crosses from a character that is no white space to a space, so both libraries see each distinct piece between
two such places once: new pieces are encoded many in one text, and both lists of ends are read off in one pass. What a piece gives
(ids, groups, links) is remembered in each worker process, for a bounded number of pieces. The documents' texts stay in place; their
distinct links are written once below the shared folder, counted by Spark, and joined with the counts: broadcast, where the counted
links are few enough (`BROADCAST` rows), else by a shuffle.

Texts that are null or empty, or that either tokenizer doesn't give back byte by byte, have no tokens, zeros and an empty digest.
Repeated rows count as documents of their own. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.llm.common import checkpointed, shared_dir, table
from pagewatch.llm.token_ids import BYTE_LEVEL, TokenIds, of_process, public_path

PIECES = "piece_bpe_32k.model"
MARK = "▁"
#: Pieces that a worker process remembers, characters of new pieces that are encoded as one text, and documents that are aligned at once.
REMEMBERED = 1_000_000
TOGETHER = 2_000
DOCUMENTS = 500
#: Counted links that are broadcast; about 100 MB. More are joined by a shuffle.
BROADCAST = 2_000_000
CUT = re.compile(r"(?<=\S)(?= )")
#: White space before a space, where a text can't be cut.
UNEVEN = re.compile(r"\s ")
#: A link is its A id times this plus its B id.
WIDTH = 1 << 16


def ends_of(given: np.ndarray, byte_at: np.ndarray | None, lengths: list[int]) -> np.ndarray:
    """Byte offsets at which tokens end. Spans (in characters if `byte_at` gives the bytes before each, else in bytes) cut where the
    next token starts behind them; between such cuts the tokens' own bytes are added up."""
    if not len(given):
        return np.zeros(0, np.int64)
    coarse = given if byte_at is None else byte_at[given]
    own = np.asarray(lengths, np.int64)
    # A cut holds if all tokens up to it end there and all others start there or later.
    reached = np.maximum.accumulate(coarse[:, 1])
    later = np.minimum.accumulate(np.append(coarse[1:, 0], coarse[-1:, 1])[::-1])[::-1]
    sure = (reached == later) & (coarse[:, 1] > coarse[:, 0])
    sure[-1:] = True
    ends = np.where(sure, reached, 0)
    added = np.cumsum(own)
    # The last sure cut before each token, and the bytes of tokens since.
    last = np.maximum.accumulate(np.where(sure, np.arange(len(sure)), -1))
    last = np.append(-1, last[:-1])
    base = np.where(last >= 0, ends[last], 0)
    since = added - np.where(last >= 0, added[last], 0)
    return np.where(sure, ends, base + since)


class Aligner:
    """Groups and links of pieces that begin with a space."""

    def __init__(self, path_a: str, path_b: str, most: int = REMEMBERED):
        import sentencepiece

        self.a = TokenIds(path_a, plain=True, most=1)
        self.a_bytes = self.a.bytes_of_ids()
        self.a_lengths = np.asarray([len(x) for x in self.a_bytes], np.int64)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k in range(self.b.vocab_size()) for p in [self.b.id_to_piece(k)]]
        self.b_lengths = np.asarray([len(x) for x in self.b_bytes], np.int64)
        if any(re.search(f"[^{MARK}]{MARK}", self.b.id_to_piece(k)) for k in range(self.b.vocab_size())):
            raise ValueError("a piece of the second tokenizer goes on behind a space")
        self.names = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        self.most = most
        self.known, self.groups, self.counts, self.links = Numbers([]), [], array("q"), array("I")
        self.uses = np.zeros(0, np.int64)

    def tokens_a(self, text: str, byte_at: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        found = self.a.tokenizer.encode(text, add_special_tokens=False)
        ids = np.asarray(found.ids, np.int64)
        return ids, ends_of(np.fromiter(chain.from_iterable(found.offsets), np.int64).reshape(-1, 2), byte_at, self.a_lengths[ids])

    def tokens_b(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """`text` begins with the space that the tokenizer adds, though to no empty text; spans are in bytes of the text without it and follow one another."""
        if text == " ":
            return np.asarray([self.b.piece_to_id(MARK)]), np.ones(1, np.int64)
        pieces = self.b.encode(text[1:], return_type="proto", num_threads=1).pieces
        ids, ends = np.asarray([p.id for p in pieces], np.int64), np.asarray([p.end + 1 for p in pieces], np.int64)
        return ids, ends_of(np.column_stack([np.append(0, ends[:-1]), ends]), None, self.b_lengths[ids])

    def aligned(self, pieces: list[str]) -> list[tuple]:
        """For each piece: its counts, its groups as text, and its links as packed 32-bit numbers; zeros if a tokenizer doesn't give it back."""
        text = " " + " ".join(pieces)
        data = text.encode()
        byte_at = None
        if len(data) != len(text):
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            byte_at = np.append(0, np.cumsum(1 + sum((points >= least).astype(np.int64) for least in (0x80, 0x800, 0x10000))))
        a, a_ends = self.tokens_a(text, byte_at)
        b, b_ends = self.tokens_b(text)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != data or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != data:
            return [((0, 0, 0), "", b"")] if len(pieces) == 1 else [x for p in pieces for x in self.aligned([p])]
        cuts = np.intersect1d(a_ends, b_ends)
        a_cuts, b_cuts = (np.append(0, np.searchsorted(ends, cuts, "right")) for ends in (a_ends, b_ends))
        n_a, n_b = np.diff(a_cuts), np.diff(b_cuts)
        # All links of a group, the first A token's first.
        sizes = n_a * n_b
        link_stops = np.append(0, np.cumsum(sizes))
        group = np.repeat(np.arange(len(cuts)), sizes)
        nth = np.arange(len(group)) - link_stops[group]
        links = (a[a_cuts[group] + nth // n_b[group]] * WIDTH + b[b_cuts[group] + nth % n_b[group]]).astype(np.uint32).tobytes()
        a_names, b_names = ([names[x] for x in ids.tolist()] for names, ids in ((self.names, a), (self.names, b)))
        a_at, b_at = a_cuts.tolist(), b_cuts.tolist()
        groups = [
            f"{a_names[i]}|{b_names[j]}" if i2 - i == 1 and j2 - j == 1 else ",".join(a_names[i:i2]) + "|" + ",".join(b_names[j:j2])
            for i, i2, j, j2 in zip(a_at, a_at[1:], b_at, b_at[1:])
        ]
        # Pieces end where groups end.
        stops = np.append(0, np.searchsorted(cuts, np.cumsum([1 + len(p.encode()) for p in pieces]), "right"))
        counts = zip(*(np.diff(x).tolist() for x in (a_cuts[stops], b_cuts[stops], stops)))
        at, places = stops.tolist(), (4 * link_stops[stops]).tolist()
        return [(n, ";".join(groups[k:k2]), links[x:x2]) for n, k, k2, x, x2 in zip(counts, at, at[1:], places, places[1:])]

    def learn(self) -> None:
        """Encodes the pieces that were numbered since, many as one text; those with white space at their end can't be followed by another one."""
        some, size = [], 0
        for piece in self.known.pieces[len(self.groups) :]:
            if not piece or piece[-1].isspace():
                self.keep(some)
                self.keep([piece])
                some, size = [], 0
                continue
            some.append(piece)
            size += len(piece)
            if size > TOGETHER:
                self.keep(some)
                some, size = [], 0
        self.keep(some)

    def keep(self, pieces: list[str]) -> None:
        for counts, groups, links in self.aligned(pieces) if pieces else ():
            self.counts.extend((*counts, len(links) // 4))
            self.groups.append(groups)
            self.links.frombytes(links)

    def forget(self) -> None:
        """Of too many pieces, those asked for only once since the last time go."""
        if len(self.groups) <= self.most:
            return
        counts, links = np.frombuffer(self.counts, np.int64).reshape(-1, 4), np.frombuffer(self.links, np.uint32)
        stops = np.cumsum(counts[:, 3])
        again = np.flatnonzero(self.uses > 1)[-self.most // 2 :]
        pieces, groups = self.known.pieces, self.groups
        new_counts, new_links = counts[again].tobytes(), links[ranges(stops[again] - counts[again, 3], counts[again, 3])].tobytes()
        del counts, links
        self.known, self.groups = Numbers([pieces[k] for k in again.tolist()]), [groups[k] for k in again.tolist()]
        self.counts, self.links = array("q", new_counts), array("I", new_links)
        self.uses = np.zeros(0, np.int64)

    def of(self, texts: list[str | None]) -> list[tuple | None]:
        """Counts (A tokens, B tokens, groups, links), groups, and distinct links with their times of whole texts; None for those without tokens."""
        self.forget()
        number = self.known.__getitem__
        cut = [np.fromiter(map(number, pieces_of(t)), np.int64) if t else None for t in texts]
        self.learn()
        uses = np.zeros(len(self.groups), np.int64)
        uses[: len(self.uses)] = self.uses
        counts, links = np.frombuffer(self.counts, np.int64).reshape(-1, 4), np.frombuffer(self.links, np.uint32)
        starts = np.cumsum(counts[:, 3]) - counts[:, 3]
        out: list[tuple | None] = []
        for pieces in cut:
            own = None if pieces is None else counts[pieces]
            if own is None or not own[:, 0].all():
                out.append(None)
                continue
            np.add.at(uses, pieces, 1)
            groups = ";".join(map(self.groups.__getitem__, pieces.tolist()))
            out.append((own.sum(0).tolist(), groups, *np.unique(links[ranges(starts[pieces], own[:, 3])], return_counts=True)))
        self.uses = uses
        return out


class Numbers(dict):
    """Pieces and their numbers; a piece that is asked for first gets the next one."""

    def __init__(self, pieces: list[str]):
        super().__init__(zip(pieces, range(len(pieces))))
        self.pieces = pieces

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self.pieces)
        self.pieces.append(piece)
        return number


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def pieces_of(text: str) -> list[str]:
    """The text with a space before it, cut before each space that follows no white space; without the space that each piece begins with."""
    if UNEVEN.search(text) or text[:1] == " ":
        return [piece[1:] for piece in CUT.split(" " + text)]
    return text.split(" ")


def align_batches(path_a: str | None, path_b: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, row, text; gives each document's counts, digest of groups, distinct links and how often it has them."""
    a, b = public_path(path_a, BYTE_LEVEL), public_path(path_b, PIECES)
    aligner = of_process(f"aligner {a} {b}", lambda: Aligner(a, b))
    empty = np.zeros(0, np.uint32)
    for batch in batches:
        for at in range(0, batch.num_rows, DOCUMENTS):
            part = batch.slice(at, DOCUMENTS)
            rows, all_links, all_times = [], [], []
            for found in aligner.of(part.column(2).to_pylist()):
                counts, groups, links, times = found or ((0, 0, 0, 0), None, empty, empty)
                all_links.append(links)
                all_times.append(times)
                rows.append((*counts, "" if groups is None else hashlib.sha256(groups.encode()).hexdigest()))
            offsets = pa.array(np.cumsum([0, *map(len, all_links)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), kind)) for x, kind in ((all_links, pa.int64()), (all_times, pa.int32()))]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (*[pa.int64()] * 4, pa.string()))]
            yield pa.record_batch([part.column(0), part.column(1), *columns, *lists], ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times"])


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Each row's doc_id, row number, counts, digest of groups, and arrays of distinct links and their times."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>, times array<int>"
    return rows.mapInArrow(lambda batches: align_batches(path_a, path_b, batches), schema)


def count_links(aligned: DataFrame) -> DataFrame:
    """link, the number of documents that hold it, and whether that is the highest of its A id."""
    counted = checkpointed(aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n")))
    of_a = F.expr(f"link div {WIDTH}").alias("a")
    highest = counted.groupBy(of_a).agg(F.max("n").alias("highest"))
    return counted.withColumn("a", of_a).join(highest, "a").select("link", "n", (F.col("n") == F.col("highest")).alias("best"))


def score(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, broadcast: int = BROADCAST) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/aligned-{uuid.uuid4().hex}"
    align(docs, path_a, path_b).write.parquet(folder)
    aligned = spark.read.parquet(folder)
    counted = checkpointed(count_links(aligned))
    side = F.broadcast(counted) if counted.count() <= broadcast else counted
    each = aligned.select("row", F.explode(F.arrays_zip(F.col("links").alias("link"), F.col("times").alias("times"))).alias("x")).select("row", "x.link", "x.times")
    sums = each.join(side, "link").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    found = aligned.drop("links", "times").join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"])
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir))
