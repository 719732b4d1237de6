"""Helpers that all operators of this folder share: tables, checkpoints, words and keyed Arrow groups."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes that separate words of letters and digits become spaces, A-Z become a-z; every byte of a non-ASCII character stays.
WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
#: The bytes \x09-\x0D and the space separate words; all others stay.
SPACE_BYTES = bytes(32 if 9 <= c <= 13 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def with_fields(columns: str, *fields: StructField) -> StructType:
    """`columns` as "name type, ...", then the fields, whose names may hold anything."""
    out = StructType()
    for column in columns.split(", "):
        out.add(*column.split(" "))
    return StructType([*out.fields, *fields])


def as_type(frame: DataFrame, name: str, kind: str):
    """The column, cast only where it has another type, so that two uses of it have one plan and can share an exchange."""
    return F.col(name) if dict(frame.dtypes)[name] == kind else F.col(name).cast(kind).alias(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only where it is unset, as in tests, one is made."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = context.getCheckpointDir() or tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpointed(frame: DataFrame) -> DataFrame:
    shared_dir(frame.sparkSession)
    return frame.checkpoint()


def texts_as_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null texts are empty."""
    return [t or b"" for t in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def letters_and_digits(text: bytes) -> list[bytes]:
    """Words [0-9a-z and non-ASCII]+ of the text with A-Z in lower case."""
    return text.translate(WORD_BYTES).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+, unchanged."""
    return [w for w in text.translate(SPACE_BYTES).split(b" ") if w]


class Remembered(dict):
    """What a function gives for a word, kept for a bounded number of words."""

    def __init__(self, function: Callable, most: int = 400_000):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.function(word)
        return value


def given_back(run: Callable) -> Callable:
    """A task's function that returns the memory it has freed to the system when its rows end.

    Worker processes outlive their tasks; what they keep would lie beside the memory of the stages that follow.
    """

    @functools.wraps(run)
    def to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return to_the_end


def held_out(of: int, remainder: int, doc_id: str = "doc_id"):
    """Whether crc32(doc_id as text) mod `of` is `remainder`; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % of == remainder, F.lit(False))


def keyed_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows with the same key, of batches that are sorted by it, one table for each key."""
    parts: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if parts and keys[a] != last:
                yield pa.Table.from_batches(parts)
                parts = []
            parts.append(batch.slice(a, b - a))
            last = keys[a]
    if parts:
        yield pa.Table.from_batches(parts)
