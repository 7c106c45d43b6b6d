"""Target-distribution importance resampling: documents drawn by how much their words resemble a target's.

Two passes over whole texts in Arrow batches. The first counts hashed features: each task's batches go through
np.bincount into one vector of as many longs as there are buckets, and treeReduce merges the tasks' vectors, so what
reaches the driver is one vector whatever the input. From the vectors of the documents and of the target come the
buckets' gains, a small array that is broadcast; the second pass gathers a document's gains by its features' buckets
and sums them with bincount weights. Seeded Gumbel noise turns the highest scores into a draw without replacement.

Defined cases: a null or empty text has no features, weight 0, and is never drawn; texts are read whole, however
long; equal scores rank by the smaller id, null ids last (their noise is that of an empty id); repeated rows are
documents of their own with the same score and different ranks; with no documents the result is empty, with no target
its counts are 0; other columns may have any name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions.ranges import ranked
from tallyflow.llm.arrowtext import parts, raw
from tallyflow.llm.common import cut, table

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
LEAST_WORDS, SHARE = 20, 10
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features(batch: pa.RecordBatch, column: int, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(each feature's bucket, the row it is from, each row's number of words) of the texts in a column.

    Lower-casing is of A-Z alone and UTF-8 bytes over 127 are all of words, so words are found in bytes.
    """
    data, at = raw(batch.column(column))
    rows = [WORD.findall(data[i:j].tobytes().lower()) for i, j in zip(at[:-1], at[1:], strict=True)]
    n_words = np.fromiter(map(len, rows), np.int64, len(rows))
    found, owner = [], []
    for size in range(1, longest + 1):
        n = np.maximum(n_words - size + 1, 0)
        runs = (w for ws in rows for w in ws) if size == 1 else (b" ".join(ws[i : i + size]) for ws in rows for i in range(len(ws) - size + 1))
        found.append(np.fromiter(map(crc32, runs), np.int64, int(n.sum())) % buckets)
        owner.append(np.repeat(np.arange(len(rows)), n))
    return np.concatenate(found), np.concatenate(owner), n_words


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, depth: int = 2) -> np.ndarray:
    """How often the texts' features fall in each bucket: one vector a task, merged by treeReduce."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in (p for whole in batches for p in parts(whole, 0)):
            total += np.bincount(features(b, 0, buckets, longest)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = docs.select("text").mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return vectors.treeReduce(np.add, depth) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: the log ratio of its smoothed shares in the target and in the documents, in thousandths, rounded down."""
    s_all, t_all = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest)))
    picked = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole, 1)):
            bucket, owner, n_words = features(b, 1, buckets, longest)
            n = np.bincount(owner, minlength=b.num_rows)
            weight = np.bincount(owner, weights=gain.value[bucket], minlength=b.num_rows).astype(np.int64)  # whole numbers, exact up to 2^53
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words), pa.array(n, pa.int64()), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    out = picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return out.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): ``share`` percent of the documents of ``least_words`` words are drawn.

    Ranks are places in ranges of the order, dealt evenly; no task ranks all documents.
    """
    each = cut(scored(docs, target, buckets, longest, seed), "importance")
    able = F.col("n_words") >= least_words
    order = ranked(each.where(able), [F.desc("score"), F.asc_nulls_last("doc_id")])
    drawn = F.col("_rank") <= F.floor(F.col("_n") * share / 100)
    some = order.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("_rank")).cast("bigint").alias("rank"))
    return some.unionByName(each.where(~able).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The check sums are worked out by rule: the table of 256 remainders, then a word's bytes folded through it.
SQL = rf"""
WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384::UBIGINT, a >> 1) ELSE a >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest(ws) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY ALL),
vocab AS (SELECT w, list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i::BIGINT - 1, 2))::UBIGINT) AS bs FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
crc AS (SELECT w, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, bs), lambda a, b: xor(tab[((xor(a, b) & 255) + 1)::BIGINT], a >> 8))) % {BUCKETS} AS bucket FROM vocab, tab),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN crc USING (w) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM bw JOIN crc USING (w) GROUP BY bucket),
tot AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS t_all),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + {BUCKETS}) / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + {BUCKETS}))))::BIGINT AS g FROM s FULL JOIN t USING (bucket), tot),
e AS (SELECT d.rid, any_value(doc_id) AS doc_id, any_value(len(ws))::BIGINT AS n_features, coalesce(sum(n * g), 0)::BIGINT AS weight FROM d LEFT JOIN dw USING (rid) LEFT JOIN crc USING (w) LEFT JOIN gain USING (bucket) GROUP BY d.rid),
f AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM f)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= n * {SHARE} // 100 THEN place END AS rank FROM r
"""
