"""Audit of how far the sources of each language diverge, by count cells.

Terms are runs of letters; each language keeps those in at least `least_docs` of its documents. A (lang, source) group and a lang
give a kept term that they hold `count` times p = 1 + floor(10^9 (count + 1) / (N + V)), and two such values p and q differ by
f = floor((p - q)^2 / q). All of it is whole numbers.

f depends on counts alone, so terms are never ranked one by one. For the ranks of a group its terms are grouped by (count in the
group, count in the language); f is evaluated once a cell, cells of equal value are merged, the 200 highest are ranked by
cumulated multiplicity, and only those that reach the first ranks are expanded, in UTF-8 order. For pairs of sources, terms with
equal counts in all sources are one shape with a multiplicity, and tasks sum f over shapes for a block of sources at a time, so
that neither a pair of sources nor a term is ever a row for each other. Counting is pre-aggregated in each task.

Null texts, languages and sources are ''. Repeated rows are documents of their own. Groups without a term have p of count 0;
a language without kept terms has pairs of value 0 and no term rows. An empty table gives no rows. Only text, lang and source are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewatch.llm.common import checkpointed, table, texts_as_bytes

LEAST_DOCS = 3
RANKS = 200
SCALE = 1_000_000_000
#: Bytes that are no letters become spaces, A-Z become a-z; every byte of a non-ASCII character stays.
TERM_BYTES = bytes(c if 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
#: Different terms of groups that a task holds before it hands them on.
HELD = 400_000
#: Shapes of a task, sources of a block, and cells of a matrix in a task.
SHAPES, BLOCK, CELLS = 200_000, 512, 2_000_000


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns lang, source, text; gives partial counts of places and documents for each term of each group."""
    names = ["lang", "source", "term", "n", "docs"]
    places: dict[tuple, Counter] = {}
    documents: dict[tuple, Counter] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in places.items():
            held = documents[lang, source]
            size = len(counts)
            if size:
                terms = pa.array(list(counts), pa.binary()).cast(pa.string())
                group = [pa.array([x] * size, pa.string()) for x in (lang, source)]
                yield pa.record_batch([*group, terms, pa.array(counts.values(), pa.int64()), pa.array([held[t] for t in counts], pa.int64())], names)
        places.clear()
        documents.clear()

    for batch in batches:
        keys = zip(*(batch.column(k).to_pylist() for k in (0, 1)))
        for key, text in zip(keys, texts_as_bytes(batch)):
            terms = text.translate(TERM_BYTES).split()
            if terms:
                places.setdefault(key, Counter()).update(terms)
                documents.setdefault(key, Counter()).update(set(terms))
        if sum(map(len, places.values())) > HELD:
            yield from handed_on()
    yield from handed_on()


def portion(counts: np.ndarray, base: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / base), by long division in two steps, so that counts up to 9e13 fit."""
    whole, rest = np.divmod(counts + 1, base)
    upper, rest = np.divmod(rest * 100_000, base)
    return 1 + whole * SCALE + upper * 10_000 + rest * 10_000 // base


def _of_group(left: pa.Table, right: pa.Table, blocks: int) -> pa.Table:
    """Sums of f over the shapes on the left, for the sources of a block against all sources of the language (right: lang, salt, block, source, base, kept)."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    lang, salt, block = (right.column(k)[0].as_py() for k in ("lang", "salt", "block"))
    sources = right.column("source").to_pylist()
    base = right.column("base").to_numpy().astype(np.int64)
    kept = right.column("kept")[0].as_py()
    own = [k for k, s in enumerate(sources) if zlib.crc32(s.encode()) % blocks == block]
    if not own or len(sources) < 2:
        return schema.empty_table()
    at = {s: k for k, s in enumerate(sources)}
    absent = portion(np.zeros(len(base), np.int64), np.maximum(base, 1))
    sums = np.zeros((len(own), len(base)), np.int64)
    none = (absent[own][:, None] - absent) ** 2 // absent
    if salt == 0 and kept:
        sums += kept * none
    if left.num_rows:
        lists = left.column("counts").combine_chunks()
        flat = lists.flatten()
        which = np.asarray([at[s] for s in flat.field("source").to_pylist()], np.int64)
        shape = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        value = portion(flat.field("n").to_numpy(), base[which])
        times = left.column("times").to_numpy().astype(np.int64)
        step = max(1, CELLS // len(base))
        for first in range(0, len(lists), step):
            a, b = np.searchsorted(shape, [first, first + step])
            p = np.tile(absent, (min(step, len(lists) - first), 1))
            p[shape[a:b] - first, which[a:b]] = value[a:b]
            many = times[first : first + step]
            for k, source in enumerate(own):
                apart = p[:, source : source + 1] - p
                sums[k] += many @ (apart * apart // p - none[k])
    pairs = [(k, s, t) for k, s in enumerate(own) for t in range(len(sources)) if t != s]
    return pa.table([[lang] * len(pairs), [sources[s] for _, s, _ in pairs], [sources[t] for _, _, t in pairs], [int(sums[k, t]) for k, _, t in pairs]], schema=schema)


def _portion(count: Column, base: Column) -> Column:
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", scaled, base.cast("decimal(20,0)"))


def _apart(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, total and `counts` (source, n; sorted) of each kept term."""
    counted = docs.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    each = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return terms.where(F.col("docs") >= least_docs).drop("docs")


def source_pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source) and value; `groups` has lang, source, base (N + V) and kept (V)."""
    shapes = checkpointed(terms.groupBy("lang", "counts").agg(F.count("*").alias("times")))
    salts = 1 + shapes.count() // SHAPES
    most = groups.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = 1 + max(0, most - 1) // BLOCK
    salted = shapes.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(salts)).cast("int"))
    dealt = salted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    known = groups.select("lang", "source", "base", "kept", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    known = known.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["lang", "salt", "block"]
    parts = dealt.groupBy(*key).cogroup(known.groupBy(*key)).applyInArrow(lambda left, right: _of_group(left, right, blocks), "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def top_terms(terms: DataFrame, groups: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, source, item (a term), value and rank; `groups` has lang, source, base, lang_base."""
    each = terms.select("lang", "term", "total", F.inline("counts"))

    def valued(rows: DataFrame, of_group: DataFrame) -> DataFrame:
        known = rows.join(of_group, ["lang", "source"])
        known = known.withColumn("p", _portion(F.col("n"), F.col("base"))).withColumn("q", _portion(F.col("total"), F.col("lang_base")))
        return known.where("p > q").withColumn("value", _apart("p", "q"))

    cells = each.groupBy("lang", "source", "n", "total").agg(F.count("*").alias("times"))
    merged = valued(cells, groups).groupBy("lang", "source", "value").agg(F.sum("times").alias("times"))
    highest_first = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # Every cell holds a term, so no more than `ranks` of them reach the ranks asked for.
    ranked = merged.withColumn("nth", F.row_number().over(highest_first)).where(F.col("nth") <= ranks)
    ranked = ranked.withColumn("before", F.sum("times").over(highest_first.rowsBetween(Window.unboundedPreceding, 0)) - F.col("times"))
    reached = checkpointed(ranked.where(F.col("before") < ranks).select("lang", "source", "value", "before"))
    least = reached.groupBy("lang", "source").agg(F.min("value").alias("least"))
    members = valued(each, groups.join(least, ["lang", "source"])).where(F.col("value") >= F.col("least"))
    in_order = Window.partitionBy("lang", "source", "value").orderBy("term")
    members = members.select("lang", "source", "term", "value").withColumn("place", F.row_number().over(in_order)).where(F.col("place") <= ranks)
    found = members.join(reached, ["lang", "source", "value"]).withColumn("rank", F.col("before") + F.col("place"))
    return found.where(F.col("rank") <= ranks).select("lang", "source", F.col("term").alias("item"), "value", F.col("rank").cast("int").alias("rank"))


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    given = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    docs = documents.select(*given)
    terms = checkpointed(kept_terms(docs, least_docs))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_n"))
    sizes = terms.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").na.fill(0, ["kept", "lang_n", "group_n"])
    groups = checkpointed(groups.select("lang", "source", "kept", (F.col("group_n") + F.col("kept")).alias("base"), (F.col("lang_n") + F.col("kept")).alias("lang_base")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_pairs(terms, groups).withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    top = top_terms(terms, groups.drop("kept"), ranks).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(top)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir))


def op11_sql() -> str:
    """The same audit over every kept term, one by one."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    share = "CAST(1 + {scale} * (CAST({n} AS HUGEINT) + 1) // ({size} + kept) AS HUGEINT)"
    p = share.format(scale=f"CAST({SCALE} AS HUGEINT)", n="coalesce(c.n, 0)", size="g.size")
    q = share.format(scale=f"CAST({SCALE} AS HUGEINT)", n="k.total", size="l.size")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
k AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS kept, sum(total) AS size FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM words JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0) AS size FROM (SELECT DISTINCT lang, source FROM docs) d),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p} AS p, {q} AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term' AS part, item, value FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {RANKS}
"""
