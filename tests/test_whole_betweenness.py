"""Betweenness as a feature is over all pairs of nodes, searched in blocks of pivots."""

import random

import pytest
from pyspark.sql import functions as F

from tallyflow.functions.tables import cut
from tallyflow.operators import graph, iterative
from tallyflow.plans.records import order_graph, order_records


def test_blocks_of_pivots_give_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(20)] + [(30, 31), (31, 32), (40, 40)]
    df = spark.createDataFrame(edges, "src int, dst int")
    monkeypatch.setattr(iterative, "WIDTH", 5)
    monkeypatch.setattr(iterative, "ROWS_AT_ONCE", 30)
    got = {r.id: r.betweenness for r in iterative.whole_betweenness(df).collect()}
    want = {r.id: r.betweenness for r in iterative.betweenness(df, graph.node_set(df)).collect()}
    assert got == pytest.approx(want, abs=1e-9) and got[31] == 1.0 and 40 not in got


def test_features_take_every_address_as_a_pivot(spark):
    d = "/root/testdata/sf0.001"
    r = cut(order_records(spark, d))
    edges = r.select(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"))
    got = {x.id: x.betweenness for x in order_graph(spark, d, r)[1].collect()}
    want = {x.id: x.betweenness for x in iterative.betweenness(edges, graph.node_set(edges)).collect()}
    assert got == pytest.approx(want, abs=1e-6)
