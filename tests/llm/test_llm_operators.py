"""Each operator next to a brute-force version, on small tables with nulls, empty texts, ties, repeated rows and clashing names."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pagewatch.llm import fingerprints, languages, licences, mixing, near_duplicates, packing, recompression, sharding, topk, toxicity
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, d string, digest string, node long, `size` int"


def documents(spark, rows):
    """Rows (doc_id, text, lang, source) with the columns of documents and some whose names operators use."""
    full = [(i, t, lang, source, None if t is None else len(t), "x", "y", 1, 2) for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCS)


ENGLISH = "the river and the house were there when people came with their bread over that hill of stone"
GERMAN = "der fluss und das haus waren dort als leute mit ihrem brot über jenen hügel aus stein kamen"


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(60):
        text = " ".join(rng.choice(words, int(rng.integers(20, 160))))
        rows.append((k, text, "en", f"s{k % 3}"))
    passage = " ".join(rng.choice(words, 70))
    for k in range(60, 75):
        rows.append((k, rows[k - 60][1] + " " + passage + " " + rows[k - 30][1], "en", None))
    near = " ".join(rng.choice(words, 120)).split()
    for k in range(75, 90):
        edited = list(near)
        edited[int(rng.integers(120))] = f"new{k}"
        rows.append((k, " ".join(edited), "en", "s0"))
    rows += [(90, rows[3][1], "en", "s1"), (91, rows[3][1].upper(), "en", "s1"), (92, "", "en", "s1"), (93, None, None, None), (94, "  \n ", "en", "s2")]
    rows += [(95, "echo " * 70, "en", "s2"), (96, "start " + "echo " * 90 + "stop", "en", "s2"), (97, "one two", "en", "s0"), (98, "one two", "de", "s0")]
    rows += [(None, rows[3][1], "en", "s0"), (3, rows[3][1], "en", "s0"), (99, " ".join(rng.choice(words, 9000)), "en", "s1")]
    return rows


EMPTY = []


@pytest.mark.parametrize("operator", ["licences", "fingerprints", "mixing", "near", "passages", "packing", "sharding", "languages", "toxicity", "topk"])
def test_empty_tables_give_no_rows(spark, operator):
    docs = documents(spark, EMPTY)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    made = {
        "licences": lambda: licences.scan(docs.select("doc_id", "text")),
        "fingerprints": lambda: fingerprints.fingerprints(docs),
        "mixing": lambda: mixing.mix(docs.select("doc_id", "text", F.array("source").alias("sources"))),
        "near": lambda: near_duplicates.join_near(docs),
        "passages": lambda: recompression.deduplicate(docs),
        "packing": lambda: packing.pack_documents(docs),
        "sharding": lambda: sharding.place(docs, "doc_id", sharding.shard_names(4), 101),
        "languages": lambda: languages.identify(docs),
        "toxicity": lambda: toxicity.classify(docs, labels),
        "topk": lambda: topk.top_k(topk.whole_vectors(vectors), topk.whole_vectors(vectors)),
    }[operator]()
    assert made.collect() == []


def test_toxicity_holds_out_and_knows_misspellings(spark):
    rng = np.random.default_rng(3)
    plain = ENGLISH.split() + GERMAN.split()
    bad = ["wretch", "wretched", "wretches", "scoundrel", "scoundrels"]
    rows, marks = [], []
    for k in range(400):
        words = rng.choice(plain, 60).tolist()
        if k % 4 == 0:
            words[int(rng.integers(60))] = bad[k // 4 % len(bad)]
        rows.append((k, " ".join(words), "en", "s"))
        marks.append((k, None if k == 7 else 1, int(k % 4 == 0)))
    rows += [(1000, "the house and wretchedd people", "en", "s"), (1001, "", "en", "s"), (1002, None, "en", "s"), (None, "bread", "en", "s")]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.classify(documents(spark, rows), labels).collect()}
    assert len(found) == len(rows)
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found.values())
    held = [(r["predicted"], int(i % 4 == 0)) for i, r in found.items() if r["held_out"] and i < 400]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert found[1000]["predicted"] == 1 and found[1001]["predicted"] == found[1002]["predicted"] == 0


def test_toxicity_without_labels_scores_nothing(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.classify(documents(spark, [(1, "a b", "en", "s")]), labels).collect()] == [0.0]


def test_languages_of_words_and_documents(spark):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(rng.choice((ENGLISH if k % 2 else GERMAN).split(), 50)), "en" if k % 2 else "de", "s") for k in range(120)]
    rows += [(500, None, "en", "s"), (501, "12 34 !!", "en", "s"), (502, "", None, "s"), (503, GERMAN + " " + GERMAN + " " + ENGLISH, None, "s"), (None, ENGLISH, "de", "s")]
    found = {r["doc_id"]: r for r in languages.identify(documents(spark, rows)).collect()}
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert all(found[k]["lang_pred"] == ("en" if k % 2 else "de") for k in range(120))
    assert {found[k]["lang_pred"] for k in (500, 501, 502)} == {"und"} and found[500]["score"] == 0
    assert found[503]["lang_pred"] == "de" and 0.5 < found[503]["score"] < 0.9 and found[None]["lang_pred"] == "en"


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(9)
    lengths, labels = np.asarray([4, 3, 1]), 3
    emissions, moves, first = rng.random((8, labels)), rng.random((labels, labels)), rng.random(labels)
    gamma, pairs, _ = languages.forward_backward(emissions, lengths, moves, first, pairs=True)
    wanted_pairs, at = np.zeros((labels, labels)), 0
    for n in lengths:
        part, total, moved = np.zeros((n, labels)), 0.0, np.zeros((labels, labels))
        for path in itertools.product(range(labels), repeat=int(n)):
            p = first[path[0]] * np.prod([emissions[at + t, y] for t, y in enumerate(path)]) * np.prod([moves[a, b] for a, b in zip(path, path[1:])])
            total += p
            for t, y in enumerate(path):
                part[t, y] += p
            for a, b in zip(path, path[1:]):
                moved[a, b] += p
        assert np.allclose(gamma[at : at + n], part / total)
        wanted_pairs += moved / total
        at += n
    assert np.allclose(pairs, wanted_pairs)


def test_licences(spark, corpus):
    rows = [
        (301, "x CC-BY y. All  Rights\nReserved! all rights reserved", "en", "s"), (302, "GNU General Public License general public", "en", "s"), (303, None, "en", "s"), (304, "cc", "en", "s"), (304, "cc", "en", "s"),
        (305, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software) to deal in the Software without restriction", "en", "s"),
        (306, "éCC by cc by cc by", "en", "s"), *corpus,
    ]
    out = licences.scan(documents(spark, rows).select("doc_id", "text")).collect()

    def brute(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hits = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))

    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out)
    assert got == Counter((i, *brute(t)) for i, t, _, _ in rows)
    labels = {r["doc_id"]: r["labels"] for r in out}
    assert labels[305] == "mit" and labels[301] == "cc-by,reserved" and labels[304] == ""
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not r["base_labels"] for r in out)


def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), [float(x) for x in rng.normal(0, 0.2, 8) * (rng.random(8) < 0.7)], 0) for k in range(60)]
    rows += [(100, rows[0][1], 0), (200, rows[0][1], 0), (200, rows[0][1], 0), (61, None, 0), (62, [1.0, None], 0), (63, [float("nan")] * 8, 0), (64, [float("inf")] * 8, 0), (None, rows[0][1], 0), (65, [], 0)]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    found = topk.top_k(vectors.where("vec_id % 100 = 0"), vectors, 5).collect()
    whole = {i: np.floor(1024 * np.asarray(v)).astype(int) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    wanted = []
    for q in (i for i in whole if i % 100 == 0):
        scored = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:5]
        wanted += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, found)) == sorted(wanted)
    few = topk.top_k(vectors.where("vec_id = 100"), vectors.where("vec_id in (100, 200)"), 5).collect()
    assert [(r["rank"], r["vec_id"]) for r in few] == [(1, 200)]


def test_fingerprints(spark, corpus):
    rows = [r for r in corpus if r[0] is not None]
    out = fingerprints.fingerprints(documents(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    order = sorted(((i, t or "") for i, t, _, _ in rows), key=lambda x: -x[0])  # the repeated row equals the one before
    wanted = Counter()
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        wanted[i, len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out) == wanted
    prints = {r["doc_id"]: r["fingerprint"] for r in out}
    assert prints[90] == prints[3] == prints[91] and prints[97] == prints[98] and prints[92] == prints[93]
    assert len(set(prints.values())) == len({(t or "").lower().strip() for _, t, _, _ in rows})
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert sum(r["near_edited"] for r in out) > 2 * sum(r["near_next"] for r in out)


def test_fingerprints_of_a_single_row_and_null_ids(spark):
    one = fingerprints.fingerprints(documents(spark, [(1, "ab cd", "en", "s")])).collect()
    assert [(r["n_chars"], r["near_next"], r["edited_sha256"]) for r in one] == [(5, 1.0, hashlib.sha256(b"ab ab").hexdigest())]
    two = fingerprints.fingerprints(documents(spark, [(None, "uvwx", "en", "s"), (1, "abcd", "en", "s")])).collect()
    assert {r["doc_id"]: r["edited_sha256"] for r in two} == {1: hashlib.sha256(b"abuv").hexdigest(), None: hashlib.sha256(b"uvab").hexdigest()}


def test_mixing(spark, corpus):
    docs = documents(spark, corpus)
    asked = docs.select("doc_id", "text", F.array("source").alias("sources"))
    out = mixing.mix(asked).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, _ in corpus)
    taken = Counter()
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["sources"][0], r["source_sizes"][0], r["targets"][0]] += r["taken"]
    assert all(abs(n - target) <= 1 and target <= 2 * size for (_, size, target), n in taken.items())
    whole = sum(r["size"] for r in out)
    assert abs(sum(target for _, _, target in taken) - 1.5 * whole) < 1e-6 * whole
    assert Counter((r["doc_id"], r["taken"]) for r in mixing.mix(asked.repartition(5)).collect()) == Counter((r["doc_id"], r["taken"]) for r in out)


def test_targets_share_the_excess():
    assert mixing.targets([("b", 10), (None, 5), ("a", 100)]) == {"a": 142.5, "b": 20.0, None: 10.0}
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_flow_serves_overlapping_sources():
    flow = mixing.least_cost_flow({("a",): 100, ("a", "b"): 50, ("b",): 10}, {"a": 120, "b": 100})
    assert flow == {("a",): 100, ("a", "b"): 100, ("b",): 20}
    # Words of the shared pattern that went to a are sent back when only they can serve b.
    assert mixing.least_cost_flow({("a", "b"): 10, ("a",): 10}, {"a": 10, "b": 10}) == {("a", "b"): 10, ("a",): 10}


def test_sharding_is_even_and_moves_little():
    names = sharding.shard_names(10)
    table = sharding.filled_table(names, 1009)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.filled_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 9)
    assert moved < 0.2 * 1009
    with pytest.raises(ValueError):
        sharding.filled_table(names, 1000)


def test_sharding_of_null_and_repeated_keys(spark):
    docs = documents(spark, [(None, "a", "en", "s"), (5, "a", "en", "s"), (5, "b", "en", "s")])
    found = sharding.place(docs, "doc_id", sharding.shard_names(4), 101).collect()
    table = sharding.filled_table(sharding.shard_names(4), 101)
    assert all(r["slot"] == int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:8], 16) % 101 and r["shard"] == table[r["slot"]] for r in found)
    assert len(found) == 3


def test_near_duplicates(spark, corpus):
    out = near_duplicates.join_near(documents(spark, corpus)).collect()
    nodes = []
    for i, t, _, _ in corpus:
        words = (t or "").encode().lower().split()
        nodes.append((i, {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words and i is not None else set()))
    links, least = Counter(), {k: i for k, (i, _) in enumerate(nodes)}
    edges = [(a, b) for a, b in itertools.combinations(range(len(nodes)), 2) if nodes[a][1] and len(nodes[a][1] & nodes[b][1]) >= 0.8 * len(nodes[a][1] | nodes[b][1])]
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    for _ in range(20):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    wanted = Counter((i, least[k], links[k]) for k, (i, _) in enumerate(nodes))
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in out) == wanted


def test_large_groups_are_verified_in_blocks(spark, corpus, monkeypatch):
    whole = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in near_duplicates.join_near(documents(spark, corpus)).collect())
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in near_duplicates.join_near(documents(spark, corpus)).collect()) == whole


def test_components_of_long_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(0, k) for k in range(1, 50)] + [(7, 8), (60, 60)]
    found = {r["node"]: r["component"] for r in near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(50), 0), **dict.fromkeys(range(100, 141), 100)}


def brute_passages(rows, width=recompression.WINDOW):
    cut = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows]
    least = {}
    for i, words in cut:
        if i is not None:
            for k in range(len(words) - width + 1):
                key = tuple(words[k : k + width])
                least[key] = min(least.get(key, i), i)
    out = Counter()
    for i, words in cut:
        gone = set()
        for k in range(len(words) - width + 1) if i is not None else ():
            if least[tuple(words[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_passages(spark, corpus):
    out = recompression.deduplicate(documents(spark, corpus)).collect()
    wanted = brute_passages(corpus)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == wanted
    assert sum(k[2] for k in wanted) > 1000


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(8)
    for alphabet in (1, 2, 3, 50, 5000):  # short alphabets give runs and periods
        passage = rng.integers(1, alphabet + 1, 90).tolist()
        documents_ = [rng.integers(1, alphabet + 1, int(n)).tolist() + passage + rng.integers(1, alphabet + 1, int(n) // 2).tolist() for n in rng.integers(0, 90, 12)]
        hashed = [[hash((w, 1)) & (1 << 63) - 1 for w in d] for d in documents_]
        text = recompression.Text(hashed)
        at, found = recompression.anchors(text)
        assert len(at) == sum(max(0, len(d) - recompression.WINDOW + 1) for d in documents_)
        anchor_of = {}
        for i, anchor in zip(at, found):
            assert anchor_of.setdefault(tuple(text.words[i : i + recompression.WINDOW]), anchor) == anchor


def token_pieces(text, tokenizer, capacity):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
    start, stop = 0, len(ids) % capacity or capacity
    while start < len(ids):
        yield start, stop - start, zlib.crc32(np.asarray(ids[start:stop], "<u4").tobytes())
        start, stop = stop, stop + capacity


def test_packing(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*corpus, (200, "a  b\t c\n\nd <|endoftext|> e", "en", "s"), (201, " x\n y ", "en", "s"), (202, "ü  b\r\n", "en", "s")]
    out = packing.pack_documents(documents(spark, rows)).collect()
    wanted = Counter((i, k, *p) for i, t, _, _ in rows for k, p in enumerate(token_pieces(t, tokenizer, 1024)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == wanted
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r["length"] for r in out) // 1024) + 1


def test_fullest_against_all_subsets():
    rng = np.random.default_rng(2)
    for _ in range(200):
        counts = {int(x): int(n) for x, n in zip(rng.integers(1, 20, 5), rng.integers(1, 3, 5))}
        room = int(rng.integers(0, 50))
        items = [x for x, n in counts.items() for _ in range(n)]
        best = max(s for k in range(len(items) + 1) for s in (sum(c) for c in itertools.combinations(items, k)) if s <= room)
        chosen = packing.fullest(counts, room)
        assert sum(chosen) == best and all(chosen.count(x) <= counts[x] for x in chosen)


def test_combinations_use_every_piece_once():
    histogram = {1024: 5, 700: 9, 324: 4, 300: 30, 24: 50, 1: 3}
    found = packing.combinations(histogram)
    used = Counter()
    for bin_, times in found:
        assert sum(bin_) <= 1024
        used.update({x: n * times for x, n in Counter(bin_).items()})
    assert used == Counter(histogram)
