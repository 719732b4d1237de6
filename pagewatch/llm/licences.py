"""Licence scans with a positional rare-token index.

Licence templates and key phrases are indexed by word and position. A first pass counts, over all documents, in how
many each licence word occurs; the counts (one row for each word of the templates) give inverse document
frequencies. In the second pass each text's licence words of highest frequency weight are looked up in the index;
every posting votes for the place where its template would start, so postings that stand in the same relative order
meet at one start. A template is reported if enough of its weight agrees on one start and all its mandatory phrases are verified
there. A key phrase is anchored at its rarest word, its other words are intersected by relative
position, so each of its places is found.

A null text is empty: no words, no labels, score 0. Long texts are scanned whole. Repeated rows give repeated rows, an
empty table none; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.llm.common import letters_and_digits, table, texts_as_bytes

#: Key phrases and their labels, fixed by the contract.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, opening words of the public licence text, phrases that must stand in it.
TEMPLATES = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        " the software to deal in the software without restriction",
        ["permission is hereby granted free of charge"],
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ["apache license version 2 0"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ["redistribution and use in source and binary forms"],
    ),
    (
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ["gnu general public license"],
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("cc-by-text", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
]
#: A text's licence words are looked up by weight from the highest, until they hold this part of a template's weight.
LEAST_WEIGHT = 0.6


class Index:
    """Postings word -> (template, position) of phrases and templates, with weights from document frequencies."""

    def __init__(self, frequencies: dict[bytes, int], documents: int):
        self.templates = [(label, p.encode().split(), []) for p, label in PHRASES.items()]
        self.phrases = len(self.templates)
        self.templates += [(label, t.encode().split(), [m.encode().split() for m in must]) for label, t, must in TEMPLATES]
        words = {w for _, t, _ in self.templates for w in t}
        self.weight = {w: math.log((documents + 1) / (frequencies.get(w, 0) + 1)) + 1e-3 for w in words}
        self.postings = defaultdict(list)
        self.anchors = defaultdict(list)
        for k, (_, words_of, _) in enumerate(self.templates):
            if k < self.phrases:
                rarest = max(range(len(words_of)), key=lambda i: self.weight[words_of[i]])
                self.anchors[words_of[rarest]].append((k, rarest))
            else:
                for i, w in enumerate(words_of):
                    self.postings[w].append((k, i))
        self.total = [sum(self.weight[w] for w in t) for _, t, _ in self.templates]

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, str, str, float]:
        """n_base, first_word, last_word, base_labels, labels, score."""
        count, first, last, base = 0, None, None, set()
        places: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.weight:
                places.setdefault(w, []).append(i)
        for w in places.keys() & self.anchors.keys():
            for k, at in self.anchors[w]:
                label, phrase, _ = self.templates[k]
                for i in places[w]:
                    start = i - at
                    if start >= 0 and words[start : start + len(phrase)] == phrase:
                        count += 1
                        base.add(label)
                        first = start if first is None else min(first, start)
                        last = start if last is None else max(last, start)
        labels, score = set(base), 1.0 if base else 0.0
        possible: Counter = Counter()
        for w in places:
            for k in {k for k, _ in self.postings.get(w, ())}:
                possible[k] += self.weight[w]
        for k, sum_ in possible.items():
            label, template, must = self.templates[k]
            if sum_ < LEAST_WEIGHT * sum(self.weight[w] for w in set(template)):
                continue
            votes: dict[int, float] = {}
            missed = 0.0
            for w in sorted(set(template), key=lambda w: -self.weight[w]):
                # A start that none of the rarer words named has missed their weight; beyond this part it can't be reported.
                opens = missed <= (1 - LEAST_WEIGHT) * self.total[k]
                here = [at for t, at in self.postings[w] if t == k]
                for at in here:
                    for i in places.get(w, ()):
                        if opens or i - at in votes:
                            votes[i - at] = votes.get(i - at, 0.0) + self.weight[w]
                missed += self.weight[w] * len(here)
            for start, agreed in votes.items():
                part = agreed / self.total[k]
                span = words[max(0, start) : start + len(template)]
                if part >= LEAST_WEIGHT and all(stands(m, span) for m in must):
                    labels.add(label)
                    score = max(score, min(1.0, part))
        return count, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def stands(phrase: list[bytes], words: list[bytes]) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def licence_words() -> set[bytes]:
    return {w for t in [*PHRASES, *(t for _, t, _ in TEMPLATES)] for w in t.encode().split()}


def document_frequencies(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word occurs, and the number of documents: a row for each word, whatever the input."""
    vocabulary = licence_words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in texts_as_bytes(batch):
                counts.update(vocabulary.intersection(letters_and_digits(text)))
                counts[b""] += 1
        yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    found = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in found}
    documents = counts.pop(b"", 0)
    return counts, documents


def scan(docs: DataFrame) -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of each row of `docs` (doc_id, text)."""
    index = Index(*document_frequencies(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            rows = []
            for text in texts_as_bytes(batch):
                words = letters_and_digits(text)
                rows.append((len(words), *index.scan(words)))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.record_batch([batch.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds[1:])]], names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op3_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir).select("doc_id", "text"))
