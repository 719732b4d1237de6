"""The stages of the corpus pipeline: what they keep, and that columns pass through."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, carried int, `d``x.y` string"
ENGLISH = "the river and the house were there when people came with their bread over that hill of stone".split()


def rows():
    rng = np.random.default_rng(12)
    texts = [" ".join(rng.choice(ENGLISH, int(rng.integers(30, 90)))) + f" mark{k}" for k in range(40)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [texts[0], texts[1].replace(" ", "  "), "one two three " + passage, "lead " + passage + " and the rest of it", "", None, "77 88", passage]
    return [(k, t, "en" if t else None, f"s{k % 3}", None if t is None else len(t), "x", 1, "y") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


def as_rows(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_language_id_rejects_texts_without_letters(spark, docs):
    found = corpus_pipeline.language_id(spark, docs, "")
    assert found.columns == docs.columns
    assert set(as_rows(found)) == {i for i, t, *_ in rows() if t and any(c.isalpha() for c in t)}


def test_one_of_each_group_stays(spark, docs):
    found = corpus_pipeline.near_duplicates(spark, docs.unionByName(docs.where("doc_id = 5")), "")
    assert found.columns == docs.columns
    ids = Counter(r["doc_id"] for r in found.collect())
    assert set(ids.values()) == {1} and set(ids) == {r[0] for r in rows()} - {40, 41, 43, 47}


def test_repeated_passages_are_cut(spark, docs):
    found = corpus_pipeline.repeated_passages(spark, docs, "")
    assert found.columns == docs.columns
    kept = as_rows(found)
    assert kept[42]["text"] == rows()[42][1]
    assert kept[43]["text"] == "lead and the rest of it" and kept[43]["n_chars"] == len(kept[43]["text"])
    assert 47 not in kept and 40 not in kept and kept[45]["text"] is None and kept[43]["kept"] == "x"


def test_mix_repeats_and_drops(spark, docs):
    found = corpus_pipeline.source_mix(spark, docs, "").collect()
    words = Counter()
    for r in found:
        words[r["source"]] += len(r["text"].split())
        assert rows()[r["doc_id"]][1].split()[: len(r["text"].split())] == r["text"].split()
    sizes = Counter()
    for _, t, _, s, *_ in rows():
        sizes[s] += len((t or "").split())
    wanted = corpus_pipeline.mix(docs.select("doc_id", "text", F.array("source").alias("sources"))).select(F.col("sources")[0].alias("s"), F.col("targets")[0].alias("t")).distinct()
    for r in wanted.collect():
        assert abs(words[r["s"]] - r["t"]) <= 1


def test_stages_take_empty_tables(spark, docs):
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").collect() == []


def test_run_packs_what_is_left(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r["doc_id"] for r in out} <= set(range(44)) | {47}
    assert {"sequence_id", "offset", "length"} <= set(out[0].asDict())
