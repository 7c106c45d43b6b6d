"""Steps over graphs shuffle sums by node and not the links, and tasks grow in number with the rows."""

import pytest
from pyspark.sql import functions as F

from tallyflow.functions import tables
from tallyflow.operators import graph, iterative


@pytest.fixture
def star(spark):
    """A hub with 30 leaves, a leaf of which is tied to another."""
    return spark.createDataFrame([(f"n{i}", "hub") for i in range(30)] + [("n1", "n2"), ("hub", "n3"), ("n4", "n4")], "src string, dst string")


def test_a_link_is_held_once_with_its_end_of_lower_degree(spark, star):
    nodes = graph.node_set(star).where("id <> 'n0'").withColumn("x", F.array(F.lit(1.0), F.length("id").cast("double")))
    w = iterative._propagation(star, nodes)
    names = {r.id: r.name for r in w.nodes.collect()}
    links = [(names[r.low], names[r.high]) for r in w.links.collect()]
    assert len(links) == 31 and sum(high == "hub" for _, high in links) == 30
    near = {a: {a} for a in names.values()}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    near["n0"].discard("n0")  # no node of its own: no loop
    x = {r.id: r.x for r in nodes.collect()}
    want = {a: [sum(x[b][i] / (len(near[a]) * len(near[b])) ** 0.5 for b in near[a] if b in x) for i in (0, 1)] for a in near}
    got = {r.id: r.x for r in iterative._spread(w, nodes, 2).collect()}
    assert got.keys() == want.keys() and all(got[a] == pytest.approx(want[a]) for a in want)


def test_heads_are_joined_when_there_are_many(spark, star, monkeypatch):
    nodes = graph.node_set(star).withColumn("x", F.array(F.lit(2.0)))
    few = {r.id: r.x for r in iterative.graph_convolution(star, nodes, 1).collect()}
    monkeypatch.setattr(iterative, "BROADCAST_NODES", 0)
    many = {r.id: r.x for r in iterative.graph_convolution(star, nodes, 1).collect()}
    assert few.keys() == many.keys() and all(few[k] == pytest.approx(many[k]) for k in few)


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    assert tables.dealt(df, 1000, "k").rdd.getNumPartitions() == 10
    assert tables.dealt(df, 100, "k") is df


def test_pairs_and_links_are_the_same_over_more_tasks(spark, monkeypatch):
    rows = spark.createDataFrame([(t, (t * 7 + i * 3) % 11) for t in range(40) for i in range(4)], "t int, w int")
    want = [sorted(map(tuple, f(rows, "t", "w").collect())) for f in (graph.cospend_pairs, graph.cospend_links)]
    monkeypatch.setattr(tables, "ROWS_A_TASK", 20)
    got = [f(rows, "t", "w", 160) for f in (graph.cospend_pairs, graph.cospend_links)]
    assert [d.rdd.getNumPartitions() for d in got] == [24, 8]
    assert [sorted(map(tuple, d.collect())) for d in got] == want


@pytest.mark.parametrize("limit", [3, 1000])
def test_searches_agree_whatever_the_buckets(spark, star, monkeypatch, limit):
    monkeypatch.setattr(iterative, "LINKS_A_BUCKET", limit)
    first = star.select(F.lit("n1").alias("id")).distinct()
    got = {r.id: r.betweenness for r in iterative.betweenness(star, first).collect()}
    assert got["hub"] == pytest.approx(14.0) and got["n2"] == 0.0 and len(got) == 31
    ranks = {r.id: r.rank for r in iterative.pagerank(star.withColumn("weight", F.lit(1.0)), steps=3).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and max(ranks, key=ranks.get) in {"hub", "n3"}
    assert {r.component for r in iterative.connected_components(star).collect()} == {"hub"}
