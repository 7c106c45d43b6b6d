"""Mixing sources to target weights by fitting each source's budget to whole documents.

Each source's target is a share of all words, held at three times its own size. Whole passes over the source come
first; what is left of the target is fitted from the histogram of exact sizes: an even share of every size, then a
bounded-knapsack dynamic program over the sizes for the last words of the budget. Seeded documents are then drawn, so many of
each size. Only histograms (rows of source, size, count) are ever grouped by source.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are
taken 0 words; repeated rows count as documents of their own; which of documents of
one size are taken is drawn by a seeded hash of their ids and content, so ties are broken the same way in every run; sizes
count whole texts, however long; an empty table gives an empty result; other columns
may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.llm.arrowtext import parts, word_counts
from tallyflow.llm.common import cut, row_hash, salted_rank, table

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
#: Words of each budget that are left to the dynamic program, and a bound on the sources of one mix.
DP_WORDS = 65_536
MAX_SOURCES = 100_000


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, times: int = MOST_TIMES) -> dict[str | None, float]:
    """Each source's target. ``sizes`` is in source order; weights repeat along it. Exact fractions inside."""
    total = sum(s for _, s in sizes)
    weight = {k: weights[i % len(weights)] for i, (k, _) in enumerate(sizes)}
    size, out = dict(sizes), {}
    left, free = Fraction(total), list(size)
    while free:
        share = left / sum(weight[k] for k in free)
        full = [k for k in free if share * weight[k] >= times * size[k]]
        if not full:
            out |= {k: share * weight[k] for k in free}
            break
        for k in full:
            out[k] = Fraction(times * size[k])
            left -= out[k]
        free = [k for k in free if k not in set(full)]
    return {k: float(v) for k, v in out.items()}


def fit(counts: list[tuple[int, int]], budget: int, limit: int = DP_WORDS) -> dict[int, int]:
    """How many documents of each size to take so that their words come to ``budget`` or just below it.

    Every size gives an even share, rounded down. Of what the rounding leaves, all but ``limit`` words go on being
    shared evenly: what a size should add and can't, as documents are whole, is carried to the next smaller size. The
    rest, ``limit`` words and what was carried past the last size, is fitted by the bounded-knapsack program.
    """
    counts = sorted((s, n) for s, n in counts if s > 0 and n > 0)
    total = sum(s * n for s, n in counts)
    if budget <= 0 or not total:
        return {}
    if budget >= total:
        return dict(counts)
    take = {s: n * budget // total for s, n in counts}
    rest = budget - sum(s * n for s, n in take.items())
    spare, carried, unit = max(0, rest - limit), 0, total * max(1, rest)
    for s, n in reversed(counts):
        carried += s * (n * budget % total) * spare  # in units of 1 / unit words
        more = min(n - take[s], carried // (s * unit))
        take[s] += more
        carried -= more * s * unit
        rest -= more * s
    mask, reach, steps = (1 << rest + 1) - 1, 1, []
    for s, n in counts:
        room, part = min(n - take[s], rest // s), 1
        while room > 0 and not reach >> rest & 1:
            part = min(part, room)
            steps.append((s, part, reach))
            reach |= reach << s * part & mask
            room -= part
            part *= 2
    at = reach.bit_length() - 1
    for s, part, before in reversed(steps):
        if not before >> at & 1:
            take[s] += part
            at -= s * part
    return take


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, k1, k2): size in words; k1 and k2 tell rows apart by their content."""
    keys = (F.xxhash64("doc_id", "text", "source").alias("k1"), F.xxhash64(F.lit(7), "source", "text", "doc_id").alias("k2"))
    picked = docs.select("doc_id", "source", *keys, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole, 4)):
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(word_counts(b.column(4)))], ["doc_id", "source", "k1", "k2", "size"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, source {picked.schema['source'].dataType.simpleString()}, k1 bigint, k2 bigint, size bigint")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 42) -> DataFrame:
    """(doc_id, size, source_size, target, taken, times, k1, k2) for every document."""
    sized = cut(sizes(docs), "mix-sizes")
    histogram = cut(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    per_source = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("bigint").alias("source_size"))
    rows = per_source.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources: mix by a coarser column")
    ordered = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))
    goal = targets(ordered, weights)
    aims = docs.sparkSession.createDataFrame([(k, s, goal[k]) for k, s in ordered] or [(None, 0, 0.0)], "a_source string, source_size bigint, target double")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = min(MOST_TIMES, int(target // size)) if size else 0
        budget = round(target) - passes * size if passes < MOST_TIMES else 0
        take = fit(list(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True)), budget)
        return pd.DataFrame({"p_source": pdf["source"], "p_size": pdf["size"], "passes": passes, "extra": [take.get(s, 0) for s in pdf["size"].tolist()], "source_size": size, "target": target})

    wide = histogram.join(F.broadcast(aims), histogram["source"].eqNullSafe(F.col("a_source"))).drop("a_source")  # MAX_SOURCES rows at most
    plans = wide.groupBy("source").applyInPandas(plan, "p_source string, p_size bigint, passes bigint, extra bigint, source_size bigint, target double")
    ranked = salted_rank(sized, ["source", "size"], [F.lit(seed), F.col("doc_id"), F.col("k1")])
    times = F.when(F.col("size") > 0, F.col("passes") + (F.col("rank") < F.col("extra")).cast("bigint")).otherwise(F.lit(0)).cast("bigint")
    both = ranked.join(plans, ranked["source"].eqNullSafe(plans["p_source"]) & (ranked["size"] == plans["p_size"]))
    both = both.withColumn("times", times)
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", "k1", "k2")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 42) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their own columns."""
    took = mix(docs, weights, seed).groupBy("k1", "k2").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("n_rows"))
    k1, k2 = F.xxhash64("doc_id", "text", "source"), F.xxhash64(F.lit(7), "source", "text", "doc_id")
    # The document's own columns stay in one, where no name can clash.
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    # Equal rows become one with a count, before the shuffle too. Rows with the same id, source and text share their
    # total, whatever their other columns; the first of them get one more if it doesn't divide.
    one = keyed.groupBy("k1", "k2", "doc").agg(F.count(F.lit(1)).alias("n"))
    both = one.join(took.where("times > 0"), ["k1", "k2"])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("k1", "k2").orderBy(row_hash(docs, "doc")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("n"), F.col("times") % F.col("n_rows") - before))
    copies = both.withColumn("each", F.col("n") * F.floor(F.col("times") / F.col("n_rows")) + more).where("each > 0")
    repeated = copies.select("doc", F.explode(F.sequence(F.lit(1), F.col("each").cast("int"))).alias("copy"))
    return repeated.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op6_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
