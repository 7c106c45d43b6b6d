"""Document fingerprints by a homomorphic multiset hash, with DataFrame functions only.

A paragraph is a line with a word. Every paragraph is hashed to a wide vector, and a document's fingerprint is the sum of
its paragraphs' vectors modulo powers of two: the order of the paragraphs doesn't matter, and adding or removing one
adds or subtracts its own vector. A paragraph's vector has four lanes modulo 2**32 of independent hashes of the whole
paragraph, for equality, and a part for likeness that is itself a sum, over the paragraph's segments of at most four
words: the number of segments and 64 lanes that count their hash bits, modulo 2**32. A lane's distance from half the
segments is a signed random projection of the multiset, so the cosine of two such vectors, which the fingerprints hold
whole, estimates the cosine of the multisets.

Defined cases: a null text is empty and has the zero fingerprint, as has one of white space; two such texts are alike
to 1, one and another to 0; equal ids are ordered by their texts; null ids come after all others; a single document is
its own next; an empty table gives an empty result; other columns may have any name. Two lanes are summed in one long,
32 bits apart: a string has at most 2**30 segments, so no sum overflows and no lane wraps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.llm.common import table

SEGMENT = r"(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*){1,4}"
#: Longs of two lanes, 32 bits apart.
LONGS, LANE = 32, 32
ONES = 1 | 1 << LANE
LOW = 0xFFFFFFFF
EQUAL = 4
ROWS_A_BUCKET = 2048
MAX_BUCKETS = 65_536


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def parts(text: Column) -> Column:
    """A text's paragraphs and segments, as (whole, t)."""
    text = F.coalesce(text, F.lit(""))
    marked = lambda items, whole: F.transform(items, lambda x: F.struct(F.lit(whole).alias("whole"), x.alias("t")))
    return F.concat(marked(paragraphs(text), True), marked(F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(0)), False))


def hashes(whole: Column, t: Column) -> list[Column]:
    """A segment's hash s; a paragraph's two hashes p and q; null where they don't belong."""
    return [F.when(~whole, F.xxhash64(t)).alias("s"), F.when(whole, F.xxhash64(t)).alias("p"), F.when(whole, F.xxhash64(F.lit(1), t)).alias("q")]


def vector_sums() -> list[Column]:
    """Aggregates over the columns s, p and q: the lanes' sums, the equality sums, the number of segments."""
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    lanes = [total(F.shiftrightunsigned("s", k).bitwiseAND(F.lit(ONES))).alias(f"s{k}") for k in range(LONGS)]
    halves = [h for c in "pq" for h in (F.shiftrightunsigned(c, 32), F.col(c).bitwiseAND(F.lit(LOW)))]
    return [*lanes, *[total(x).alias(f"e{j}") for j, x in enumerate(halves)], F.count("s").alias("n")]


SUMS = [*(f"s{k}" for k in range(LONGS)), *(f"e{j}" for j in range(EQUAL)), "n"]


def hexed(prefix: str = "") -> Column:
    """The fingerprint: 64 lanes (lane k + 32, then lane k), the number of segments and the equality lanes, 8 digits each."""
    lanes = [F.lpad(F.hex(F.col(f"{prefix}s{k}")), 16, "0") for k in range(LONGS)]
    rest = [F.lpad(F.hex(F.col(f"{prefix}{c}").bitwiseAND(F.lit(LOW))), 8, "0") for c in ("n", *(f"e{j}" for j in range(EQUAL)))]
    return F.lower(F.concat(*lanes, *rest))


def likeness(a: str, b: str) -> Column:
    """The cosine of the signed lanes of two fingerprints (as sums, which a fingerprint holds whole), 0 to 1; 1 for equal ones."""

    def lane(p: str, k: int, i: int) -> Column:
        field = F.shiftrightunsigned(F.col(f"{p}s{k}"), LANE * i).bitwiseAND(F.lit(LOW))
        return (2 * field - F.col(f"{p}n")).cast("double")

    x = [lane(a, k, i) for k in range(LONGS) for i in range(2)]
    y = [lane(b, k, i) for k in range(LONGS) for i in range(2)]
    vectors = F.arrays_zip(F.array(*x).alias("x"), F.array(*y).alias("y"))
    start = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"))
    add = lambda s, v: F.struct((s["xy"] + v["x"] * v["y"]).alias("xy"), (s["xx"] + v["x"] * v["x"]).alias("xx"), (s["yy"] + v["y"] * v["y"]).alias("yy"))
    cosine = F.aggregate(vectors, start, add, lambda s: F.when((s["xx"] > 0) & (s["yy"] > 0), s["xy"] / F.sqrt(s["xx"] * s["yy"])).otherwise(0.0))
    same = F.lit(True)
    for c in SUMS:
        same = same & (F.col(f"{a}{c}").bitwiseAND(F.lit(LOW)) == F.col(f"{b}{c}").bitwiseAND(F.lit(LOW)) if c[0] == "e" else F.col(f"{a}{c}") == F.col(f"{b}{c}"))
    return F.when(same, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sums ..., fingerprint) for ids that are unique."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.explode_outer(parts(F.col(text_col))).alias("v"))
    return each.select("doc_id", *hashes(F.col("v.whole"), F.col("v.t"))).groupBy("doc_id").agg(*vector_sums()).withColumn("fingerprint", hexed())


def combine(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """Fingerprints of a's documents with b's paragraphs added (or removed, sign -1), by doc_id."""
    other = b.select(F.col("doc_id").alias("o_id"), *[F.col(c).alias(f"o_{c}") for c in SUMS])
    both = a.drop("fingerprint").join(other, F.col("doc_id") == F.col("o_id"))
    return both.select("doc_id", *[(F.col(c) + sign * F.col(f"o_{c}")).alias(c) for c in SUMS]).withColumn("fingerprint", hexed())


def _bucket(ids: Column, bounds: list) -> Column:
    """The number of bounds at or below an id, found in two steps; null ids are in the last bucket."""
    fan = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + fan] for i in range(0, len(bounds), fan)]
    heads = F.array(*[F.lit(g[0]) for g in groups])
    group = F.size(F.filter(heads, lambda x: x <= ids))
    inner = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    within = F.size(F.filter(F.get(inner, group - 1), lambda x: x <= ids))
    return F.when(ids.isNull(), F.lit(len(bounds))).when(group == 0, F.lit(0)).otherwise((group - 1) * fan + within).cast("int")


def with_next(docs: DataFrame, rows_a_bucket: int = ROWS_A_BUCKET) -> tuple[DataFrame, list, Window]:
    """(doc_id, text, b, ahead): rows dealt to buckets of neighbouring ids, each with its next bucket's first rows.

    Bucket bounds are ids at even quantiles of all ids. A row whose id is a bound also goes to the bucket below, as
    ``ahead``, and the very first also to the last bucket, so each row finds its next one within its own bucket.
    """
    ids = docs.select(F.col("doc_id").alias("i")).agg(F.count(F.lit(1)), F.min("i"), F.count("i")).first()
    n, first, known = ids
    buckets = max(1, min(MAX_BUCKETS, n // rows_a_bucket))
    bounds: list = []
    if known and buckets > 1:
        at = [i / buckets for i in range(1, buckets)]
        found = docs.select(F.percentile_approx("doc_id", at, max(10_000, 4 * buckets))).first()[0]
        bounds = sorted({x for x in found if x > first})
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    b = _bucket(F.col("doc_id"), bounds) if bounds else F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.lit(0))
    last = len(bounds)
    base = base.withColumn("b", b.cast("int"))
    homes = [F.struct(F.col("b"), F.lit(0).alias("ahead"))]
    if bounds:
        is_bound = F.get(F.array(*[F.lit(x) for x in bounds]), F.col("b") - 1) == F.col("doc_id")
        homes.append(F.when(is_bound & (F.col("b") > 0), F.struct((F.col("b") - 1).cast("int").alias("b"), F.lit(1).alias("ahead"))))
    homes.append(F.when(F.col("doc_id").eqNullSafe(F.lit(first)), F.struct(F.lit(last).alias("b"), F.lit(2).alias("ahead"))))
    dealt = base.select("doc_id", "text", F.explode(F.array_compact(F.array(*homes))).alias("home")).select("doc_id", "text", "home.b", "home.ahead", F.xxhash64("text").alias("tie"))
    order = Window.partitionBy("b").orderBy("ahead", F.col("doc_id").asc_nulls_last(), "tie", "text")
    return dealt, bounds, order


def edited_fingerprints(docs: DataFrame, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The edited text replaces the last half of a document's code points by the first as many of the next document's.
    The texts are shuffled once, by bucket; vectors are summed and neighbours compared within the same buckets.
    """
    dealt, _, order = with_next(docs, rows_a_bucket)
    half = F.floor(F.length("text") / 2).cast("int")
    rows = dealt.withColumn("at", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.select("b", "at", "ahead", "doc_id", "text", edited.alias("edited"), F.length("text").cast("bigint").alias("n_chars"))
    rows = rows.withColumn("edited_sha256", F.when(F.col("ahead") == 0, F.sha2(F.encode("edited", "UTF-8"), 256)))
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
    both = F.filter(both, lambda x: (x["kind"] == 0) | (F.col("ahead") == 0))
    keys = ["b", "at", "ahead", "doc_id", "n_chars", "edited_sha256"]
    each = rows.select(*keys, F.explode(both).alias("v")).select(*keys, "v.kind", F.explode_outer(parts(F.col("v.t"))).alias("w"))
    sums = each.select(*keys, "kind", *hashes(F.col("w.whole"), F.col("w.t"))).groupBy(*keys, "kind").agg(*vector_sums())
    # One row a document: its own sums (a_) and those of its edited text (b_).
    pick = [F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{p}_{c}") for k, p in ((0, "a"), (1, "b")) for c in SUMS]
    wide = sums.groupBy(*keys).agg(*pick)
    near = Window.partitionBy("b").orderBy("at")
    wide = wide.select("*", *[F.lead(f"a_{c}").over(near).alias(f"c_{c}") for c in SUMS]).where("ahead = 0")
    return wide.select(
        "doc_id", "n_chars", "edited_sha256", hexed("a_").alias("fingerprint"), hexed("b_").alias("edited_fingerprint"),
        likeness("a_", "b_").alias("near_edited"), likeness("a_", "c_").alias("near_next"),
    )


def op9_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
