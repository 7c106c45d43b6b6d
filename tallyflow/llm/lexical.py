"""Ranked lexical search: integer scores over a postings table in buckets of terms.

The index is a written table of postings (bucket, term, row, doc_id, tf, n), one for each term of each document. A
document's postings are made in one go from its whole text and stay in the part of the index that its documents'
partition wrote, in which they are sorted by bucket (a hash of the term): building needs no shuffle, a term
that every document has is spread over all parts, and a search reads the row groups of its own buckets. A search joins
the items' terms with the postings, scores each match in 64-bit integers, deals the matches by document, sums them by
item and document there, and takes each item's highest by row_number, of which every task first keeps its own highest.

Defined cases: a null text, or one without a term, is not counted in N and never found; an item without terms has no
rows; texts are read whole, however long; equal scores are in ascending order of doc_id, null ids last; repeated rows
are documents and items of their own; without documents or items the result is empty; other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.llm.arrowtext import parts, raw
from tallyflow.llm.common import cut, table

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BUCKETS = 1024
#: Distinct terms, and pairs of item and term, that are broadcast (about 30 bytes each); beyond it Spark joins by shuffles.
MOST_TERMS, MOST_PAIRS = 100_000, 200_000
#: Score constants: a length of 0 counts as LOW of 100 parts of the mean length.
LOW, SLOPE = 10, 90
TOP = 10


def postings(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(bucket, term, row, doc_id, tf, n, first): the terms of every document with their counts, n the document's length in terms.

    ``row`` tells rows with equal ids apart; ``first`` is true for one posting of each document. Lower-casing is of A-Z
    alone and UTF-8 bytes over 127 are all of terms, so terms are found in bytes.
    """
    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: dict[bytes, int] = {}
        for b in (p for whole in batches for p in parts(whole, 2, 1 << 20)):
            data, at = raw(b.column(2))
            counts = [Counter(TERM.findall(data[i:j].tobytes().lower())) for i, j in zip(at[:-1], at[1:], strict=True)]
            sizes = np.fromiter(map(len, counts), np.int64, len(counts))
            terms = [t for c in counts for t in c]
            if len(bucket) > 1 << 18:
                bucket.clear()
            for t in terms:
                if t not in bucket:
                    bucket[t] = crc32(t) % BUCKETS
            of = pa.array(np.repeat(np.arange(len(counts)), sizes))
            ns = np.fromiter((c.total() for c in counts), np.int64, len(counts))
            first = np.zeros(len(terms), bool)
            first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
            cols = [pa.array(np.fromiter(map(bucket.__getitem__, terms), np.int32, len(terms))), pa.array(terms, pa.binary()).cast(pa.string()), b.column(0).take(of), b.column(1).take(of)]
            cols += [pa.array(np.fromiter((v for c in counts for v in c.values()), np.int64, len(terms))), pa.array(np.repeat(ns, sizes)), pa.array(first)]
            yield pa.RecordBatch.from_arrays(cols, ["bucket", "term", "row", "doc_id", "tf", "n", "first"])

    return picked.mapInArrow(run, f"bucket int, term string, row bigint, doc_id {picked.schema['doc_id'].dataType.simpleString()}, tf bigint, n bigint, first boolean")


def build_index(docs: DataFrame) -> DataFrame:
    """The postings as a written table, each part sorted by bucket."""
    return cut(postings(docs).sortWithinPartitions("bucket"), "postings")


def search(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents of highest score above 0."""
    terms = cut(postings(items, "item_id").select("bucket", "term", F.col("row").alias("item"), F.col("doc_id").alias("item_id")), "item-terms")
    pairs, known = terms.count(), cut(terms.select("bucket", "term").distinct(), "terms")
    small = known.count() <= MOST_TERMS
    buckets = [r[0] for r in known.select("bucket").distinct().collect()]  # BUCKETS at most
    wanted = index.where(F.col("bucket").isin(buckets)) if len(buckets) < BUCKETS else index
    hits = wanted.join(F.broadcast(known) if small else known, ["bucket", "term"], "left_semi")
    df = cut(hits.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    size = index.agg(F.count(F.when(F.col("first"), 1)).alias("N"), F.coalesce(F.sum("tf"), F.lit(0)).alias("L")).first()
    weight = F.floor(1000 * F.log(F.lit(2.0 * size["N"] + 2) / (2 * F.col("df") + 1).cast("double")))
    weighed = df.select("bucket", "term", weight.alias("w"))
    rated = hits.join(F.broadcast(weighed) if small else weighed, ["bucket", "term"])
    rated = rated.withColumn("m", F.lit(LOW) + F.expr(f"({SLOPE} * n * {size['N']}L) div {max(1, size['L'])}L"))
    impact = F.col("w") * F.expr("(1000000000 * tf) div (1000 * tf + 8 * m)")
    # Dealt by document: its matches with all items meet there, and no sum is shuffled. Items join after the shuffle.
    dealt = rated.select("bucket", "term", "row", "doc_id", impact.alias("part")).where("part > 0").repartition("row")
    matches = dealt.join(F.broadcast(terms) if pairs <= MOST_PAIRS else terms, ["bucket", "term"])
    sums = matches.groupBy("item", "item_id", "row", "doc_id").agg(F.sum("part").alias("score"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    best = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ts FROM documents),
p AS (SELECT rid, doc_id, len(ts) AS n, t, count(*) AS tf FROM (SELECT rid, doc_id, ts, unnest(ts) AS t FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT iid, item_id, t FROM (SELECT row_number() OVER () AS iid, item_id, unnest({_TERMS}) AS t FROM benchmark)),
tot AS (SELECT count(*)::BIGINT AS cn, coalesce(sum(len(ts)), 0)::BIGINT AS cl FROM d WHERE len(ts) > 0),
df AS (SELECT t, count(*) AS df FROM p SEMI JOIN q USING (t) GROUP BY t),
w AS (SELECT t, floor(1000 * ln((2 * cn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, tot),
s AS (SELECT iid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * ({LOW} + ({SLOPE} * n * cn) // cl))))::BIGINT AS score FROM p JOIN w USING (t) JOIN q USING (t), tot GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST, rid)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}
"""
