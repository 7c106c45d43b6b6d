"""Nearest rows by blocks, and the later part of a table without ordering it."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyflow.operators import metrics
from tallyflow.plans.registry import QUERIES


def test_nearest_two_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "QUERIES_A_BLOCK", 3)
    monkeypatch.setattr(metrics, "ROWS_A_BLOCK", 7)
    r = random.Random(3)
    x = {i: [r.choice([0.0, 1.0, r.random()]) for _ in range(3)] for i in range(30)} | {30: [0.5] * 3, 31: [0.5] * 3, 32: [0.5] * 3}
    df = spark.createDataFrame(list(x.items()), "id long, v array<float>")
    x = {row.id: row.v for row in df.collect()}
    got = {row.id: (row.d1, row.d2) for row in metrics.nearest_two(df.where("id % 3 = 0"), df, "v", "id", "id", same=True).collect()}
    want = {i: tuple(sorted(math.dist(x[i], x[j]) for j in x if j != i)[:2]) for i in x if i % 3 == 0}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)


def test_copies_have_a_distance_and_no_ratio(spark, tmp_path):
    rows = [(100, [1.0, 2.0])] + [(i, [1.0, 2.0]) for i in range(1, 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in QUERIES["a30_nearest_two"](spark, str(tmp_path)).collect()] == [(100, 0.0, None)]


@pytest.mark.parametrize("share", [0.0, 0.3, 0.7, 1.0])
def test_late_part_is_the_test_part(spark, share):
    df = spark.range(200).select("id", F.timestamp_seconds(F.when(F.col("id") % 9 == 0, F.lit(None)).otherwise((F.col("id") * 37 % 11) ** 6)).alias("ts"))
    want = {r.id for r in metrics.temporal_split(df, "ts", "id", share).where("part = 'test'").collect()}
    assert {r.id for r in metrics.late_part(df, "ts", "id", share).collect()} == want
