"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share them. Each distinct beginning is a node whose segment, one formatted turn, is
emitted once; the segments of a tree follow each other depth first. A segment has its token ids, the position ids of its tokens
(from `position` on, counted along the path from the root), the tokens under the loss mask, and the intervals of the emitted
sequence that its tokens may attend to besides earlier ones of their own: its ancestors, adjacent ones merged. A conversation is the
list of its segments' starts.

A turn is `### role: text </turn>` and a line feed. Inside texts and roles a backslash goes before every backslash, before each `#` of
`###`, and before `</turn>`; in roles before `:` too. So no text can end a turn or open one, and removing the backslashes gives it
back. Head, text and tail are encoded apart, so the loss mask covers exactly the tokens of assistants' texts.

Only digests and token counts of turns are sorted to find the order: conversations sorted by their lists of digests visit the tree depth
first, and what a conversation adds is what lies behind the beginning it shares with the one before. Tasks walk sorted parts; the
driver carries the shared beginning from part to part (one row for each part), so a first turn that a third of all conversations
share is spread over many tasks. A conversation's list of digests, 20 bytes a turn, is one row. Texts and ids are streamed in order.

Null texts and roles are empty. Turns are in the order of turn (null first), role and text; repeated rows are repeated turns. Rows with a
null conv_id are one conversation. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.llm.common import checkpointed, shared_dir, table
from pagewatch.llm.token_ids import BYTE_LEVEL, public_path, token_ids

OPEN, CLOSE, END = "### ", "</turn>", " </turn>\n"
TRAINED_ROLE = "assistant"
HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)
ESCAPE = re.compile(r"\\(.)", re.S)
#: A conversation that holds the template's own marks.
ODD_ID, ODD_TEXT = -7, r"\### Assistant: </turn> ok"


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\#\\#\\#").replace(CLOSE, "\\" + CLOSE)


def unescaped(text: str) -> str:
    return ESCAPE.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, str, str]:
    """Head, text and tail of a turn."""
    return f"{OPEN}{escaped(role).replace(':', chr(92) + ':')}: ", escaped(text), END


def parsed(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head = HEAD.match(turn)
    if head is None or not turn.endswith(END):
        raise ValueError(f"not a formatted turn: {turn[:80]!r}")
    return unescaped(head[1]), unescaped(turn[head.end() : len(turn) - len(END)])


def encode_turns(path: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows conv, conv_id, role, text in order; gives each turn's number, digest, ids and mask."""
    ids = token_ids(public_path(path, BYTE_LEVEL), plain=True)
    last, nth = None, 0
    names = ["conv", "conv_id", "nth", "digest", "n", "loss_first", "loss_stop", "ids"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
    for batch in batches:
        rows, parts = [], []
        for conv, conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            nth = nth + 1 if conv == last else 0
            last = conv
            head, body, tail = ids.of(formatted(role, text))
            first, stop = len(head) // 4, (len(head) + len(body)) // 4
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            trained = role == TRAINED_ROLE
            rows.append((conv, conv_id, nth, digest, stop + len(tail) // 4, first, stop if trained else first))
            parts.append(head + body + tail)
        columns = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(p) // 4 for p in parts)]), pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))
        yield pa.record_batch([*columns, lists], names)


def shared_beginning(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Walk:
    """Depth-first places of the nodes on the path of the latest conversation."""

    def __init__(self, at: int = 0, path: list = (), starts: list = ()):
        self.at, self.path, self.starts = at, list(path), list(starts)

    def step(self, path: list, sizes: list[int]) -> int:
        """Number of turns that the next conversation shares with the one before."""
        common = shared_beginning(self.path, path)
        del self.starts[common:]
        for size in sizes[common:]:
            self.starts.append(self.at)
            self.at += size
        self.path = path
        return common


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the next part has to know of a part: its first path and sizes, tokens, last path and starts, and the least number of turns shared with the first."""
    walk, first, kept = Walk(), None, 0
    for _, _, path, sizes in _paths(batches):
        common = walk.step(path, sizes)
        if first is None:
            first, kept = (path, sizes), len(path)
        else:
            kept = min(kept, common)
    if first is not None:
        kinds = [pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int32()]
        row = (TaskContext.get().partitionId(), *first, walk.at, walk.path, walk.starts, kept)
        yield pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds)], ["part", "first", "sizes", "total", "last", "starts", "kept"])


def carried(parts: list) -> dict[int, tuple]:
    """For each part: its first place, and the path and starts that it takes over from the parts before."""
    out, base, path, starts = {}, 0, [], []
    for p in sorted(parts, key=lambda p: p["part"]):
        common = shared_beginning(path, p["first"])
        out[p["part"]] = (base, path[:common], starts[:common])
        repeated = sum(p["sizes"][:common])
        taken = min(common, p["kept"])
        path, starts = p["last"], [*starts[:taken], *(base + x - repeated for x in p["starts"][taken:])]
        base += p["total"] - repeated
    return out


def _places(carry: dict[int, tuple], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = Walk(*carry.get(TaskContext.get().partitionId(), ()))
    kind = pa.list_(pa.struct([("nth", pa.int32()), ("start", pa.int64()), ("position", pa.int64()), ("ancestors", pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())])))]))
    for batch in batches:
        rows = []
        for conv, conv_id, path, sizes in zip(*(c.to_pylist() for c in batch.columns)):
            common = walk.step(path, sizes)
            seen: list[dict] = []
            position, nodes = 0, []
            for nth, (start, size) in enumerate(zip(walk.starts, sizes)):
                if nth >= common:
                    nodes.append({"nth": nth, "start": start, "position": position, "ancestors": [dict(x) for x in seen]})
                if seen and seen[-1]["stop"] == start:
                    seen[-1]["stop"] = start + size
                else:
                    seen.append({"first": start, "stop": start + size})
                position += size
            rows.append((conv, conv_id, walk.starts[0], list(walk.starts), nodes))
        columns = list(zip(*rows)) or [()] * 5
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), kind])], ["conv", "conv_id", "tree", "starts", "nodes"])


def format_conversations(rows: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Segments (tree, start, stop, position, ancestors, ids, loss_first, loss_stop, conv_id, nth) and members (conv, conv_id, nth, start).

    `start` and `stop` are places in the emitted sequence; a tree begins at its root's start. The loss mask is a range of a segment's own ids.
    """
    spark = rows.sparkSession
    key = F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv")
    given = rows.select(key, F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    in_order = given.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "conv_id", "role", "text")
    folder = f"{shared_dir(spark)}/turns-{uuid.uuid4().hex}"
    schema = "conv string, conv_id long, nth int, digest binary, n int, loss_first int, loss_stop int, ids array<int>"
    in_order.mapInArrow(lambda batches: encode_turns(path, batches), schema).write.parquet(folder)
    turns = spark.read.parquet(folder)
    lists = turns.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("nth", "digest", "n"))).alias("t"))
    paths = lists.select("conv", "conv_id", F.col("t.digest").alias("path"), F.col("t.n").alias("sizes"))
    paths = checkpointed(paths.repartitionByRange("path", "conv").sortWithinPartitions("path", "conv"))
    parts = paths.mapInArrow(walked, "part int, first array<binary>, sizes array<int>, total long, last array<binary>, starts array<long>, kept int").collect()
    carry = carried(parts)
    placed = paths.mapInArrow(
        lambda batches: _places(carry, batches),
        "conv string, conv_id long, tree long, starts array<long>, nodes array<struct<nth:int,start:long,position:long,ancestors:array<struct<first:long,stop:long>>>>",
    )
    placed = checkpointed(placed)
    nodes = placed.select("conv", "tree", F.explode("nodes").alias("node")).select("conv", "tree", "node.*")
    segments = nodes.join(turns.drop("digest"), ["conv", "nth"]).select(
        "tree", "start", (F.col("start") + F.col("n")).alias("stop"), "position", "ancestors", "ids", "loss_first", "loss_stop", "conv_id", "nth"
    )
    return segments, placed.select("conv", "conv_id", F.posexplode("starts").alias("nth", "start"))


def read_turns(path: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows conv, conv_id, ids, loss_first, loss_stop in order; gives counts and digests of each conversation."""
    entries = token_ids(public_path(path, BYTE_LEVEL), plain=True).bytes_of_ids()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    open_: list = []

    def text_of(ids: list[int]) -> str:
        return b"".join(map(entries.__getitem__, ids)).decode()

    def closed() -> tuple:
        _, conv_id, n, turns, loss_chars, loss, chars = open_
        return conv_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    for batch in batches:
        out = []
        for conv, conv_id, ids, first, stop in zip(*(c.to_pylist() for c in batch.columns)):
            if not open_ or open_[0] != conv:
                if open_:
                    out.append(closed())
                open_ = [conv, conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            turn = text_of(ids)
            role, text = parsed(turn)
            trained = unescaped(text_of(ids[first:stop]))
            open_[2] += 1
            open_[3].update(f"{role}\n{text}\n".encode())
            open_[4] += len(trained)
            open_[5].update(trained.encode())
            open_[6] += len(turn)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], names)
    if open_:
        yield pa.record_batch([pa.array([x], k) for x, k in zip(closed(), kinds)], names)


def read_back(segments: DataFrame, members: DataFrame, path: str | None = None) -> DataFrame:
    """Counts and digests of each conversation, from the emitted segments alone."""
    found = members.join(segments.select("start", "ids", "loss_first", "loss_stop"), "start")
    in_order = found.repartition("conv").sortWithinPartitions("conv", "nth").select("conv", "conv_id", "ids", "loss_first", "loss_stop")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return in_order.mapInArrow(lambda batches: read_turns(path, batches), schema)


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(ODD_ID, 0, "user", ODD_TEXT), (ODD_ID, 1, "assistant", ODD_TEXT)], given.schema)
    segments, members = format_conversations(given.unionByName(odd))
    folder = f"{shared_dir(spark)}/segments-{uuid.uuid4().hex}"
    segments.write.parquet(folder)
    return read_back(spark.read.parquet(folder), members)


def op12_sql() -> str:
    def escape(x: str) -> str:
        return f"replace(replace(replace({x}, '\\', '\\\\'), '###', '\\#\\#\\#'), '{CLOSE}', '\\{CLOSE}')"

    marks = len(OPEN) + len(": ") + len(END)
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {ODD_ID}, unnest([0, 1]), unnest(['user', 'assistant']), '{ODD_TEXT}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{TRAINED_ROLE}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = '{TRAINED_ROLE}' THEN text ELSE '' END, '' {order})) AS loss_sha256,
  CAST(sum({marks} + length(replace({escape("role")}, ':', '\\:')) + length({escape("text")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
