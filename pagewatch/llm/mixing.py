"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document belongs to one or more sources. Documents with the same set of sources form a pattern, and only the sizes
of patterns reach the driver: a row for each set of sources that occurs, never for each document. There, words flow from the patterns to the quotas of
the sources; the first use of a document is free and each repetition costs more (convex costs), so a flow of least
cost repeats as little as the quotas allow. The words that leave a pattern are then taken from its documents in a
seeded order: all of them as often as they go in whole, and once more those in front until the number is reached. Of the
document at which it is reached, only its first words are used once more.

The seeded order is by a hash, and no group is sorted whole: a histogram over hash ranges tells which range holds the
end, and only that range is ordered, after a second histogram of it.

Null texts have size 0 and are never taken. Repeated rows count each for itself (their order among themselves makes
no difference). An empty table gives no rows. Columns other than doc_id, text and the source are not read.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewatch.llm.common import checkpointed, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_USES = 2
SEED = 20240607
#: Ranges of each of the two histograms over a document's place in the seeded order.
RANGES = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST_USES) -> dict[str | None, float]:
    """Each source's part, by weight, of `share` times all sizes; none above `most` times its size, what is over goes to the rest by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    size = dict(order)
    out, free, rest = {}, [s for s, _ in order], share * sum(size.values())
    while free:
        unit = rest / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > most * size[s]]
        if not full:
            out |= {s: unit * weight[s] for s in free}
            break
        out |= {s: float(most * size[s]) for s in full}
        rest -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def least_cost_flow(patterns: dict[tuple, int], quotas: dict, most: int = MOST_USES) -> dict[tuple, int]:
    """Words that leave each pattern (a tuple of its sources), by successive cheapest paths.

    Use k of a pattern has its size as capacity and costs k**2, so uses are taken in order. Paths may send words of one
    pattern back to make room for another's. Quotas that the patterns can't fill stay short.
    """
    taken = dict.fromkeys(patterns, 0)
    sent: dict[tuple, int] = {}
    left = {s: int(round(q)) for s, q in quotas.items()}
    by_source: dict = {}
    for p in patterns:
        for s in p:
            by_source.setdefault(s, []).append(p)
    for use in range(most):  # convex costs: all paths of a use are cheaper than any of the next
        while True:
            # From every pattern that has words of this use left, to a quota with room, over the words already sent.
            back: dict = {p: None for p, n in patterns.items() if taken[p] < n * (use + 1)}
            queue, end = deque(("pattern", p) for p in back), None
            seen = {("pattern", p): None for p in back}
            while queue and end is None:
                kind, node = queue.popleft()
                if kind == "pattern":
                    near = [("source", s) for s in node]
                else:
                    if left.get(node, 0) > 0:
                        end = ("source", node)
                        break
                    near = [("pattern", p) for p in by_source[node] if sent.get((p, node), 0) > 0]
                for x in near:
                    if x not in seen:
                        seen[x] = (kind, node)
                        queue.append(x)
            if end is None:
                break
            path = [end]
            while seen[path[-1]] is not None:
                path.append(seen[path[-1]])
            path.reverse()
            first = path[0][1]
            amount = min(patterns[first] * (use + 1) - taken[first], left[end[1]])
            for (kind, a), (_, b) in zip(path, path[1:]):
                if kind == "source":
                    amount = min(amount, sent[b, a])
            for (kind, a), (_, b) in zip(path, path[1:]):
                if kind == "pattern":
                    sent[a, b] = sent.get((a, b), 0) + amount
                else:
                    sent[b, a] -= amount
            taken[first] += amount
            left[end[1]] -= amount
    return taken


def seeded_take(sized: DataFrame, group: list[str], wanted: DataFrame, seed: int = SEED, carried: tuple = ()) -> DataFrame:
    """`sized` (group columns, doc_id, size) with `taken`: `wanted` (group columns, words) taken from each group.

    `wanted` has a row for each group, a number that the caller has counted.
    """
    place = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sized = sized.withColumn("place", place)
    sized = sized.withColumn("range", F.pmod(F.shiftright("place", 40), F.lit(RANGES))).withColumn("inner", F.pmod(F.shiftright("place", 20), F.lit(RANGES)))
    same = [F.col(f"w.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]

    def joined(rows: DataFrame, other: DataFrame) -> DataFrame:
        return rows.alias("s").join(F.broadcast(other.alias("w")), same).drop(*[F.col(f"w.{g}") for g in group])

    total = sized.groupBy(*group).agg(F.sum("size").alias("total"))
    # Whole uses of all documents, and the words still to be taken in the seeded order.
    plan = joined(total, wanted).withColumn("uses", F.when(F.col("total") > 0, F.floor(F.col("words") / F.col("total"))).otherwise(0))
    plan = checkpointed(plan.select(*group, "uses", (F.col("words") - F.col("uses") * F.col("total")).alias("more")))

    def end_range(rows: DataFrame, by: str, need: DataFrame) -> DataFrame:
        """For each group, the range in which `more` is reached, and the words wanted from it."""
        summed = rows.groupBy(*group, by).agg(F.sum("size").alias("n"))
        running = F.sum("n").over(Window.partitionBy(*group).orderBy(by)) - F.col("n")
        found = joined(summed.withColumn("before", running), need.select(*group, "more"))
        found = found.where((F.col("before") < F.col("more")) & (F.col("before") + F.col("n") >= F.col("more")))
        return checkpointed(found.select(*group, F.col(by).alias(f"end_{by}"), (F.col("more") - F.col("before")).alias(f"more_{by}")))

    # Groups that need nothing more have no end range; -1 lies before all.
    ends = end_range(sized, "range", plan)
    edge = joined(sized, ends).where(F.col("range") == F.col("end_range"))
    inner_ends = end_range(edge.select(*group, "size", "inner"), "inner", ends.select(*group, F.col("more_range").alias("more")))
    both = ends.alias("s").join(inner_ends.alias("w"), same).drop(*[F.col(f"w.{g}") for g in group])
    full = plan.alias("s").join(both.alias("w"), same, "left").drop(*[F.col(f"w.{g}") for g in group]).fillna(-1, ["end_range", "end_inner"])
    full = checkpointed(full)
    rows = joined(sized, full)
    at_end = (F.col("range") == F.col("end_range")) & (F.col("inner") == F.col("end_inner"))
    front = (F.col("range") < F.col("end_range")) | ((F.col("range") == F.col("end_range")) & (F.col("inner") < F.col("end_inner")))
    # Only the few rows of the last range are put in order.
    order = Window.partitionBy(*group).orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.where(at_end).withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = last.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("more_inner") - F.col("before"))))
    rest = rows.where(~at_end).withColumn("extra", F.when(front, F.col("size")).otherwise(0))
    kept = [*group, "doc_id", "size", *carried]
    taken = (F.col("uses") * F.col("size") + F.col("extra")).cast("long").alias("taken")
    return rest.select(*kept, taken).unionByName(last.select(*kept, taken))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_USES, seed: int = SEED, carried: tuple = ()) -> DataFrame:
    """doc_id, sources, size, source sizes and targets, the words taken, and the `carried` columns of each row.

    `docs` has doc_id, text and `sources`, an array of the sources that hold the document; null stands for no source.
    """
    spark = docs.sparkSession
    sized = docs.select(
        "doc_id", *carried,
        F.array_sort(F.array_distinct(F.coalesce("sources", F.array(F.lit(None).cast("string"))))).alias("sources"), size_of(F.col("text")).alias("size"),
    )
    sized = checkpointed(sized)
    patterns = {tuple(r["sources"]): r["size"] for r in sized.groupBy("sources").agg(F.sum("size").alias("size")).collect()}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    aims = targets(list(sizes.items()), weights, share, most)
    flow = least_cost_flow(patterns, aims, most)
    wanted = spark.createDataFrame([(list(p), int(n)) for p, n in flow.items()], "sources array<string>, words long")
    known = spark.createDataFrame([(list(p), [sizes[s] for s in p], [float(aims[s]) for s in p]) for p in patterns], "sources array<string>, source_sizes array<long>, targets array<double>")
    taken = seeded_take(sized, ["sources"], wanted, seed, carried)
    return taken.join(F.broadcast(known), "sources")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id", "text", F.array(F.col("source").cast("string")).alias("sources"))
    return mix(docs).select("doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken")
