"""Training of the graph network: gradients by finite differences, and a graph that is learnt."""

import random

import numpy as np
import pytest

from tallyflow.operators import iterative, network


def plain(edges, x, ids):
    """The propagation matrix, dense."""
    a = np.eye(len(ids))
    at = {k: i for i, k in enumerate(ids)}
    for s, d in edges:
        if s != d:
            a[at[s], at[d]] = a[at[d], at[s]] = 1.0
    deg = a.sum(1)
    return a / np.sqrt(np.outer(deg, deg))


def loss_of(net, p, x, y, share):
    h = x
    for w, b in net.layers[:-1]:
        h = np.maximum(p @ h @ w + b, 0.0)
    q = network._softmax(h @ net.layers[-1][0] + net.layers[-1][1])
    return -sum(share[c] * np.log(q[i, c]) for i, c in y.items())


@pytest.mark.parametrize("hidden", [(4,), (4, 3)])
def test_gradients_are_finite_differences(spark, hidden):
    rng, r = np.random.default_rng(1), random.Random(1)
    edges = [(r.randrange(9), r.randrange(9)) for _ in range(14)]
    x, y, share = rng.normal(size=(9, 3)), {0: 0, 3: 1, 5: 1, 8: 0}, np.array([0.3, 0.2])
    sizes = [3, *hidden, 2]
    net = network.Network([(rng.normal(size=(a, b)), rng.normal(size=b)) for a, b in zip(sizes, sizes[1:], strict=False)])
    df = spark.createDataFrame(edges, "src int, dst int")
    nodes = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id int, x array<double>")
    w = iterative._propagation(df, nodes)
    loss, grad = network.gradients(net, w, iterative._spread(w, nodes, 3), spark.createDataFrame(list(y.items()), "id int, y int"), share)
    p, flat, eps = plain(edges, x, range(9)), net.flat(), 1e-6
    assert loss == pytest.approx(loss_of(net, p, x, y, share), abs=1e-9)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = eps
        want = (loss_of(net.shaped(flat + step), p, x, y, share) - loss_of(net.shaped(flat - step), p, x, y, share)) / (2 * eps)
        assert grad[i] == pytest.approx(want, abs=1e-6)
    for i, row in {r.id: r.p for r in net.predict(df, nodes).collect()}.items():
        h = x
        for a, b in net.layers[:-1]:
            h = np.maximum(p @ h @ a + b, 0.0)
        assert row == pytest.approx(network._softmax(h @ net.layers[-1][0] + net.layers[-1][1])[i].tolist(), abs=1e-9)


def test_a_labelled_graph_is_learnt(spark):
    """Two rings of nodes with noisy features; a third of the labels is known."""
    rng = np.random.default_rng(4)
    edges = [(40 * c + i, 40 * c + (i + k) % 40) for c in range(2) for i in range(40) for k in (1, 2)]
    x = rng.normal(size=(80, 4)) + np.repeat([[0.5], [-0.5]], 40, axis=0)
    nodes = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id int, x array<double>")
    labels = spark.createDataFrame([(i, i // 40) for i in range(0, 80, 3)], "id int, y int")
    net, losses = network.fit_network(spark.createDataFrame(edges, "src int, dst int"), nodes, labels, (8, 4), epochs=12, rate=0.05)
    assert losses[-1] < 0.5 * losses[0]
    found = {r.id: int(np.argmax(r.p)) for r in net.predict(spark.createDataFrame(edges, "src int, dst int"), nodes).collect()}
    assert sum(found[i] == i // 40 for i in range(80)) > 75
