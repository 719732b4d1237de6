"""Source divergence, chat formatting, tokenizer alignment and token ids against plain Python."""

import hashlib
import os
import random
import re
import subprocess
import sys
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from checks.compare import _rows, duck
from pagewatch.llm.alignment import Aligner, score
from pagewatch.llm.chat import escaped, format_conversations, formatted, parsed, read_back, unescaped
from pagewatch.llm.divergence import audit
from pagewatch.llm.token_ids import KnownWords, TokenIds

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "B", " ", "  ", "\n", "\t", "é", "日本", "😀", "ﬁ", "'s", "12", "...", "<|endoftext|>", "▁", "\x1c", "‍", "़", "<0x41>", "<s>", "　", "\r\n", "\x00", "the", "\\", "###", "</turn>", ":"]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("name", ["op4_exact_top_k", "op7_sharding", "op11_source_divergence", "op12_chat_formatting"])
def test_queries_agree_with_their_sql(spark, sf_dir, name):
    frame = entry.queries()[name](spark, sf_dir)
    result = duck(sf_dir).execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert _rows(frame.columns, frame.collect()) == _rows(columns, result.fetchall())


# Source divergence


def plain_audit(rows, least, ranks):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        upper = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", upper)
        groups[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        own = {s: Counter({t: n for t, n in c.items() if t in kept}) for (x, s), c in groups.items() if x == lang}
        whole = sum(own.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in [*own.items(), (None, whole)]}
        for s in own:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in own if o != s]
            terms = [((p[s][t] - p[None][t]) ** 2 // p[None][t], t) for t in kept if own[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def test_divergence_equals_a_plain_count(spark):
    rng = random.Random(5)
    words = ["the", "The", "é", "É", "x1y", "日本", *(f"w{chr(97 + k)}" for k in range(26)), "long" * 50]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", None, "é", "c" * 30]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(300)]
    rows += [("en", "a", None), ("xx", "lone", "only two documents"), ("xx", "other", "only two documents"), ("yy", "one", None), *[("en", "b", "same same text")] * 5]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n int, term string")
    for ranks in (7, 200):
        assert sorted(tuple(r) for r in audit(frame, 3, ranks).collect()) == plain_audit(rows, 3, ranks)
    assert audit(frame.where("false")).collect() == []


# Chat formatting


def conversations():
    rng = random.Random(8)
    turns = odd_texts(40) + ["hello"] * 6 + [None, "long " * 2000]
    rows = []
    for conv in range(120):
        k = 0 if conv % 3 else 1
        beginning = [("system", "Be kind."), ("user", "hello")][k:]
        rest = [(rng.choice(["user", "assistant", "a:b ###", None]), rng.choice(turns)) for _ in range(rng.randint(0, 6))]
        rows += [(conv, t, role, text) for t, (role, text) in enumerate(beginning + rest)]
    rows += [(7, 0, "user", "a second first turn"), (7, 0, "user", "a second first turn"), (None, None, "user", "nameless"), (None, 3, "assistant", "")]
    rng.shuffle(rows)
    return rows


def in_order(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append((-1 if turn is None else turn, role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(x)] for c, x in found.items()}


def test_template_is_reversible():
    for text in [*odd_texts(3000, 9), "####", "\\", "\\###", "## #", "</turn></turn>"]:
        assert unescaped(escaped(text)) == text and "###" not in escaped(text).replace("\\#", "")
        assert parsed("".join(formatted(text, text))) == (text, text)


@pytest.fixture(params=[True, False])
def coalescing(spark, request):
    """With and without small shuffle partitions put together, so that trees also run over several parts."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(request.param).lower())
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_prefix_tree(spark, coalescing):
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, start int, ids string")
    segments, members = format_conversations(frame)
    nodes = {r["start"]: r for r in segments.collect()}
    wanted = in_order(rows)
    paths = defaultdict(dict)
    for r in members.collect():
        paths[r["conv_id"]][r["nth"]] = r["start"]
    assert set(paths) == set(wanted)
    # Each distinct beginning is there once, and the sequence has no gaps.
    assert len(nodes) == segments.count() == len({tuple(x[:k]) for x in wanted.values() for k in range(1, len(x) + 1)})
    at = 0
    for start in sorted(nodes):
        assert start == at and nodes[start]["stop"] - start == len(nodes[start]["ids"])
        at = nodes[start]["stop"]
    entries = TokenIds(BYTES, plain=True).bytes_of_ids()
    for conv, turns in wanted.items():
        path = [nodes[paths[conv][k]] for k in range(len(turns))]
        seen, position = set(), 0
        for node, (role, text) in zip(path, turns):
            assert parsed(b"".join(entries[i] for i in node["ids"]).decode()) == (role, text)
            masked = b"".join(entries[i] for i in node["ids"][node["loss_first"] : node["loss_stop"]]).decode()
            assert unescaped(masked) == (text if role == "assistant" else "")
            assert {x for a in node["ancestors"] for x in range(a["first"], a["stop"])} == seen
            assert all(a["stop"] < b["first"] for a, b in zip(node["ancestors"], node["ancestors"][1:]))
            assert node["position"] == position and node["tree"] == path[0]["start"]
            position += len(node["ids"])
            seen |= set(range(node["start"], node["stop"]))
    # Depth first: what stands between a node and a descendant descends from it.
    for conv in wanted:
        path = [paths[conv][k] for k in range(len(wanted[conv]))]
        assert path == sorted(path)


def test_conversations_are_read_back(spark):
    rows = conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in read_back(*format_conversations(frame)).collect()}
    for conv, turns in in_order(rows).items():
        trained = "".join(t for r, t in turns if r == "assistant")
        r = found.pop(conv)
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(trained)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x}\n{t}\n" for x, t in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(trained.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len("".join(formatted(*t))) for t in turns)
    assert not found
    assert read_back(*format_conversations(frame.where("false"))).collect() == []


# Token ids and alignment


def test_ids_are_those_of_whole_texts(spark, sf_dir):
    texts = odd_texts(3000) + [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for plain in (True, False):
        known, whole = TokenIds(BYTES, plain, most=500), Tokenizer.from_file(BYTES)
        whole.encode_special_tokens = plain
        for text, ids in zip(texts, known.of(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)[:200]


def test_ids_of_columns_are_those_of_whole_texts():
    texts = [*odd_texts(3000), None, "", "a\n\nb", " a", "a ", "a\u180e \tb", "x <|endoftext|> y", "end<|endoftext|>"]
    for plain in (True, False):
        known, whole = TokenIds(BYTES, plain, most=500), Tokenizer.from_file(BYTES)
        whole.encode_special_tokens = plain
        column = pa.array(["before", *texts], pa.string()).slice(1)
        found = [np.frombuffer(ids, "<u4").tolist() for ids in known.of_column(column)]
        assert found == [whole.encode(text or "", add_special_tokens=False).ids for text in texts]
        assert list(known.of_column(column.slice(0, 0))) == []


def test_a_column_has_each_distinct_word_cut_once():
    known, looked_up = TokenIds(BYTES), []
    cut_together = known._cut_together
    known._cut_together = lambda words: looked_up.extend(words) or cut_together(words)
    list(known.of_column(pa.array(["one two one", "two one\none"] * 50)))
    assert sorted(looked_up) == ["\none", "\ntwo", " one", " two"]


def test_columns_need_few_strings_at_once():
    known = TokenIds(BYTES, most=1000)
    texts = pa.array([" ".join(f"w{k}" for k in range(a, a + 100)) for a in range(0, 100_000, 100)])
    next(known.of_column(texts.slice(0, 1)))
    tracemalloc.start()
    try:
        assert sum(len(ids) for ids in known.of_column(texts)) > 0
        assert tracemalloc.get_traced_memory()[1] < 8_000_000
    finally:
        tracemalloc.stop()


def test_forgotten_words_of_columns_get_the_same_ids():
    texts = odd_texts(600) + ["", "a\n\nb", " a", "x <|endoftext|> y", "long" * 3000]
    whole = Tokenizer.from_file(BYTES)
    whole.encode_special_tokens = False
    wanted = [whole.encode(text, add_special_tokens=False).ids for text in texts]
    for most, most_bytes in ((20, 1 << 20), (1000, 4000), (0, 0)):
        known = TokenIds(BYTES)
        known.words = KnownWords(known.words.function, most, most_bytes)
        found = []
        for a in [*range(0, len(texts), 7)]:
            found += [np.frombuffer(ids, "<u4").tolist() for ids in known.of_column(pa.array(texts[a : a + 7]))]
            assert len(known.words.words) == len(known.words.ids) <= most and known.words.fits()
        assert found == wanted


class Plain:
    """Whole texts, and cuts by decoded bytes alone."""

    def __init__(self):
        self.a = Tokenizer.from_file(BYTES)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        self.a_bytes = TokenIds(BYTES, plain=True).bytes_of_ids()

    def b_bytes(self, k):
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return None
        sides = [(k, self.a_bytes[k]) for k in self.a.encode(" " + text, add_special_tokens=False).ids], [(k, self.b_bytes(k)) for k in self.b.encode(text)]
        if any(b"".join(x for _, x in side) != (" " + text).encode() for side in sides):
            return None
        ends = []
        for side in sides:
            ends.append(np.cumsum([len(x) for _, x in side]).tolist())
        out, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = (len([e for e in x if e <= cut]) for x in ends)
            out.append(([k for k, _ in sides[0][i:i2]], [k for k, _ in sides[1][j:j2]]))
            i, j = i2, j2
        return out


@pytest.mark.parametrize("most", [10**6, 50])
def test_pieces_align_like_whole_texts(most):
    plain, aligner = Plain(), Aligner(BYTES, PIECES, most)
    texts = [t for t in odd_texts(1500, 11) if t] + ["日本語 テキスト 😀😀 naïve café", "a " * 300, "x" * 3000, "a ", " "]
    aligned = [x for k in range(0, len(texts), 100) for x in aligner.of(texts[k : k + 100])]
    for text, found in zip(texts, aligned):
        groups = plain.groups(text)
        if groups is None:
            assert found is None, repr(text)
            continue
        counts, shown, links, times = found
        assert counts == [sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(times)], repr(text)
        assert shown == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        assert {(int(x) >> 16, int(x) & 65535): n for x, n in zip(links, times)} == Counter((x, y) for a, b in groups for x in a for y in b)


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_alignment_scores(spark, broadcast):
    texts = ["the river é 😀", "the river", None, "", "the river", "▁", "x" * 5000, *odd_texts(60, 2), "the  the\nthe"]
    rows = [(None if k == 1 else k, t, "x", 0) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, link string, n int")
    plain = Plain()
    groups = [plain.groups(t) for t in texts]
    links = [[(x, y) for a, b in g or [] for x in a for y in b] for g in groups]
    counts = Counter(x for one in links for x in set(one))
    highest = defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    wanted = []
    for (doc, *_), g, one in zip(rows, groups, links):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        wanted.append((doc, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), len(one), sum(counts[x] == highest[x[0]] for x in one), sum(counts[x] for x in one), "" if g is None else hashlib.sha256(shown.encode()).hexdigest()))
    found = [tuple(r) for r in score(frame, broadcast=broadcast).collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    assert score(frame.where("false")).collect() == []


ELSEWHERE = """
import os, sys
sys.path.insert(0, {repo!r})
os.environ["PYTHONPATH"] = ""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {folder!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as entry
for name in {names!r}:
    assert entry.queries()[name](spark, {sf_dir!r}).count() > 0, name
    print("ran", name)
"""


def test_operators_run_where_workers_lack_the_package(sf_dir, tmp_path):
    """Workers start in another folder without the repository on their path."""
    repo = os.path.dirname(os.path.abspath(entry.__file__))
    names = ["op10_best_fit_packing", "op11_source_divergence", "op12_chat_formatting", "op13_tokenizer_alignment", "op9_substring_dedup", "pipeline"]
    code = ELSEWHERE.format(repo=repo, folder=str(tmp_path / "shared"), names=names, sf_dir=sf_dir)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=600)
    assert [x for x in done.stdout.split("\n") if x.startswith("ran")] == [f"ran {n}" for n in names], done.stderr[-2000:]
