"""Ids of texts by a byte-level tokenizer file, each distinct word split and merged once.

Columns of texts keep the ids of their words in Arrow, where a word takes some thirty bytes and not the hundreds of Python's own.

The files are read where they lie; their folder is installed on every executor. A tokenizer belongs to a worker process and
serves all its tasks, so that a word is merged once there and not once a task.
"""

from __future__ import annotations

import re
import sys
import types
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

BYTE_LEVEL = "byte_bpe_50k.json"
# Fixed value: how byte-level tokenizers of this family cut a text before merging.
CUT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Characters whose classes have been the same in all Unicode versions of the last ten years; words with others go to the tokenizer whole.
SETTLED = re.compile("[^\x1c-\x1f԰-\U0010ffff]*\\Z")
#: White space that can't be cut off with the word behind it.
UNEVEN = re.compile(r"\s\s|\A\s|\s\Z")

#: New words that are cut in one pass, new words that are Python strings at a time, and bytes of texts whose words are made distinct together.
TOGETHER = 1000
STRINGS = 20_000
PART_BYTES = 8_000_000
#: Words of columns whose ids are remembered, and their bytes with those ids.
WORDS = 600_000
WORDS_BYTES = 48_000_000


def public_path(path: str | None, name: str) -> str:
    """`path`, or where the public file of that name lies."""
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def of_process(name: str, make: Callable):
    """One object for all tasks of a worker process. Functions of this folder travel by value, so their module's globals are new in each task."""
    memory = sys.modules.setdefault("_pagewatch_memory", types.ModuleType("_pagewatch_memory"))
    if not hasattr(memory, name):
        setattr(memory, name, make())
    return getattr(memory, name)


class Generations(dict):
    """What a function gives for a key. Two generations of at most `most` keys each: those asked for again outlive the change."""

    def __init__(self, function: Callable, most: int):
        super().__init__()
        self.function, self.most, self.older = function, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value


class KnownWords:
    """Ids of words (null for some), both in Arrow. When there are too many, only the words asked for last stay."""

    def __init__(self, function: Callable[[list[str]], list[bytes | None]], most: int, most_bytes: int = WORDS_BYTES):
        self.function, self.most, self.most_bytes = function, most, most_bytes
        self.forget()

    def forget(self) -> None:
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def fits(self) -> bool:
        return len(self.words) <= self.most and self.words.nbytes + self.ids.nbytes <= self.most_bytes

    def of(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        parts = [pa.array(self.function(new.slice(a, STRINGS).to_pylist()), pa.large_binary()) for a in range(0, len(new), STRINGS)]
        found = pa.concat_arrays([self.ids, *parts])
        # New words come behind the known ones, in their order.
        missing = pc.is_null(at).to_numpy(zero_copy_only=False)
        places = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        places[missing] = len(self.ids) + np.arange(len(new))
        out = found.take(pa.array(places))
        if len(new):
            self.words, self.ids = pa.concat_arrays([self.words, new]), found
        if not self.fits():
            self.words, self.ids = words, out
            if not self.fits():
                self.forget()
        return out


def characters_of_bytes() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class TokenIds:
    """Ids of texts as little-endian unsigned 32-bit integers, without special tokens added.

    `plain`: strings of special tokens inside texts are ordinary text. Else a text that holds one is encoded whole.
    """

    def __init__(self, path: str, plain: bool = False, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.characters = characters_of_bytes()
        self.pieces = Generations(self._merged, most // 2 + 1)
        self.heads = Generations(self.cut, most // 8 + 1)
        self.spaced = Generations(lambda word: self.cut(" " + word), most)
        self.line_feed = self.encoded("\n")
        self.words = KnownWords(lambda words: self._of_words([w if w[:1] == "\n" else " " + w for w in words]), WORDS)

    def encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.characters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def cut(self, text: str) -> bytes:
        if SETTLED.match(text):
            return b"".join(map(self.pieces.__getitem__, CUT.findall(text)))
        return self.encoded(text)

    def of(self, texts: Iterable[str]) -> Iterator[bytes]:
        """A token starts at every white space character that follows another one, so words with the space before them are encoded alone."""
        heads, spaced = self.heads.__getitem__, self.spaced.__getitem__
        for text in texts:
            if any(mark in text for mark in self.special):
                yield self.encoded(text)
            elif UNEVEN.search(text):
                yield self.cut(text)
            else:
                lines = [line.split(" ") for line in text.split("\n")]
                yield self.line_feed.join([heads(line[0]) + b"".join(map(spaced, line[1:])) for line in lines]) if text else b""

    def _cut_together(self, words: list[str]) -> list[bytes]:
        """Ids of words that each begin with the white space before them, cut in one pass: only first pieces begin with it."""
        joined = "".join(words)
        if not SETTLED.match(joined):
            return list(map(self.cut, words))
        pieces = CUT.findall(joined)
        ids = list(map(self.pieces.__getitem__, pieces))
        starts = [k for k, piece in enumerate(pieces) if piece[0] in " \n"]
        return [b"".join(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(pieces)])]

    def _of_words(self, words: list[str]) -> list[bytes | None]:
        """Ids of distinct words with the white space before them, null for those that hold no more or end in white space."""
        out: list[bytes | None] = [None] * len(words)
        whole = [k for k, word in enumerate(words) if len(word) > 1 and not (word[1].isspace() or word[-1].isspace())]
        for a in range(0, len(whole), TOGETHER):
            some = whole[a : a + TOGETHER]
            for k, ids in zip(some, self._cut_together([words[k] for k in some])):
                out[k] = ids
        return out

    def of_column(self, texts: pa.Array) -> Iterator[bytes]:
        """What `of` gives for the texts of a column: their words are made distinct in Arrow, so that each is cut once in some megabytes of text."""
        texts = pc.fill_null(texts, "")
        part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // PART_BYTES
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(texts)] if len(texts) else []
        for a, b in zip(cuts, cuts[1:]):
            yield from self._of_part(texts.slice(a, b - a))

    def _of_part(self, texts: pa.Array) -> Iterator[bytes]:
        # Each line begins a word with its line feed; so does each text, and what precedes that first one is empty.
        split = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("", texts, "\n"), "\n", " \n"), " ")
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        distinct = split.flatten().dictionary_encode()
        del split
        words = self.words.of(distinct.dictionary).take(distinct.indices)
        del distinct
        uneven = np.add.reduceat(pc.is_null(words).to_numpy(zero_copy_only=False), ends[:-1], dtype=np.int64) > 1
        special = np.zeros(len(texts), bool)
        for mark in self.special:
            special |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        _, offsets, ids = words.buffers()
        starts = np.frombuffer(offsets, np.int64)[words.offset :][ends].tolist()
        ids = memoryview(ids or b"")
        for k, (a, b) in enumerate(zip(starts, starts[1:])):
            if special[k]:
                yield self.encoded(texts[k].as_py())
            elif uneven[k]:
                yield self.cut(texts[k].as_py())
            else:
                yield bytes(ids[a + len(self.line_feed) : b])

    def bytes_of_ids(self) -> list[bytes]:
        """The bytes that each id stands for."""
        back = {ord(c): b for b, c in self.characters.items()}
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        out = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for entry, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            out[k] = entry.encode() if entry in added else entry.translate(back).encode("latin-1")
        return out


def token_ids(path: str, plain: bool = False, most: int = 300_000) -> TokenIds:
    return of_process(f"ids {plain} {most} {path}", lambda: TokenIds(path, plain, most))
