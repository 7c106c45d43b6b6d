"""Training of a graph network: full-batch back-propagation over tables of nodes and edges.

Convolutions are D^-1/2 (A + I) D^-1/2 H W + b, rectified; a linear layer and a softmax over classes end them. A node's
rows are multiplied in Arrow batches by the weights, which are small and broadcast; spreading over edges, forward and
back, is a join and a sum by node (see iterative.Propagation), as the propagation matrix is its own transpose. Each task sums its nodes' gradients to
one vector, and treeReduce adds the tasks' vectors, so the driver sees one gradient a step, whatever the graph's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.tables import cut, drop
from tallyflow.operators.iterative import Propagation, _propagation

HIDDEN = (64, 32)
#: Adam's usual constants.
MOMENTS, TINY = (0.9, 0.999), 1e-8


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.empty((0, 0))


def _arrays(rows: np.ndarray) -> pa.Array:
    n, d = rows.shape
    return pa.ListArray.from_arrays(np.arange(0, n * d + 1, d, dtype=np.int32), np.ascontiguousarray(rows).ravel())


@dataclass
class Network:
    """Weights (matrix, bias) of the convolutions and of the linear layer that ends them."""

    layers: list[tuple[np.ndarray, np.ndarray]]

    def flat(self) -> np.ndarray:
        return np.concatenate([part.ravel() for layer in self.layers for part in layer])

    def shaped(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for w, b in self.layers:
            out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return Network(out)

    def predict(self, edges: DataFrame, features: DataFrame, matrix: Propagation | None = None) -> DataFrame:
        """(id, p): the probability of each class for every node of ``features`` (id, x); ``matrix`` may give their graph's."""
        w = matrix or _propagation(edges, features)
        x = w.numbered(features.select("id", "x"))
        for layer in range(len(self.layers) - 1):
            spread = w.spread(x, len(self.layers[layer][0]))
            last = layer == len(self.layers) - 2
            x = cut(spread.mapInArrow(_forward(self.layers[layer], self.layers[-1] if last else None), "id bigint, x array<double>"), "network")
            drop(spread)
        return w.named(x).withColumnRenamed("x", "p")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _forward(layer, end=None):
    """(id, x) to the layer's output, or to the classes' probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a = np.maximum(_matrix(b.column("x")) @ layer[0] + layer[1], 0.0)
                yield pa.RecordBatch.from_arrays([b.column("id"), _arrays(a if end is None else _softmax(a @ end[0] + end[1]))], ["id", "x"])

    return run


def _top(layer, end, share: np.ndarray):
    """(id, x, y) of the last convolution: what flows back (id, g), and a row without an id of the gradients and the loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            m, y = _matrix(b.column("x")), b.column("y").fill_null(-1).to_numpy(zero_copy_only=False).astype(int)
            z = m @ layer[0] + layer[1]
            a = np.maximum(z, 0.0)
            p = _softmax(a @ end[0] + end[1])
            weight = np.where(y >= 0, share[np.maximum(y, 0)], 0.0)
            loss = -(weight * np.log(np.maximum(p[np.arange(len(y)), np.maximum(y, 0)], 1e-300))).sum()
            d = (p - np.eye(p.shape[1])[np.maximum(y, 0)]) * weight[:, None]
            dz = (d @ end[0].T) * (z > 0)
            grad = np.concatenate([(m.T @ dz).ravel(), dz.sum(0), (a.T @ d).ravel(), d.sum(0), [loss]])
            total = grad if total is None else total + grad
            yield pa.RecordBatch.from_arrays([b.column("id"), _arrays(dz @ layer[0].T)], ["id", "g"])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, b.column("id").type), _arrays(total[None])], ["id", "g"])

    return run


def _below(layer, first: bool):
    """(id, x, g) of an earlier convolution: the same without a loss; the first one's flow stops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            m, g = _matrix(b.column("x")), _matrix(b.column("g"))
            dz = g * (m @ layer[0] + layer[1] > 0)
            grad = np.concatenate([(m.T @ dz).ravel(), dz.sum(0)])
            total = grad if total is None else total + grad
            if not first:
                yield pa.RecordBatch.from_arrays([b.column("id"), _arrays(dz @ layer[0].T)], ["id", "g"])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, b.column("id").type), _arrays(total[None])], ["id", "g"])

    return run


def _summed(rows: DataFrame) -> np.ndarray:
    return rows.where("id IS NULL").select("g").rdd.map(lambda r: np.array(r[0])).treeReduce(np.add)


def gradients(network: Network, w: Propagation, spread: DataFrame, labels: DataFrame, share: np.ndarray) -> tuple[float, np.ndarray]:
    """(loss, flat gradient). ``w`` is the propagation matrix, ``spread`` (id, x) the features spread once, ``labels`` (id, y)."""
    return _gradients(network, w, cut(w.numbered(spread), "network-features"), cut(w.numbered(labels), "network-labels"), share)


def _gradients(network: Network, w: Propagation, spread: DataFrame, labels: DataFrame, share: np.ndarray) -> tuple[float, np.ndarray]:
    """The same with nodes by their numbers."""
    convs, end, made = network.layers[:-1], network.layers[-1], []
    inputs = [spread]
    for layer in convs[:-1]:
        inputs.append(w.spread(inputs[-1].select("id", "x").mapInArrow(_forward(layer), "id bigint, x array<double>"), len(layer[1])))
    top = inputs[-1].join(labels, "id", "left").select("id", "x", "y")
    flow = cut(top.mapInArrow(_top(convs[-1], end, share), "id bigint, g array<double>"), "network-back")
    found = _summed(flow)
    loss, parts = float(found[-1]), [found[:-1]]
    for k in range(len(convs) - 2, -1, -1):
        back = w.spread(flow.where("id IS NOT NULL").select("id", F.col("g").alias("x")), len(convs[k][1]))
        both = inputs[k].join(back.withColumnRenamed("x", "g"), "id").select("id", "x", "g")
        made += [flow, back]
        flow = cut(both.mapInArrow(_below(convs[k], k == 0), "id bigint, g array<double>"), "network-back")
        parts.append(_summed(flow))
    drop(*made, flow, *inputs[1:])
    return loss, np.concatenate(parts[::-1])


def fit_network(edges: DataFrame, features: DataFrame, labels: DataFrame, hidden: tuple[int, ...] = HIDDEN, epochs: int = 200, rate: float = 0.01, balanced: bool = True, seed: int = 42, matrix: Propagation | None = None) -> tuple[Network, list[float]]:
    """A network trained on the nodes of ``labels`` (id, y from 0), and the loss before each of the ``epochs`` steps of Adam.

    ``features`` is (id, x array of double, scaled by the caller). Classes weigh the same in the loss unless ``balanced``
    is off; nodes without a label only pass their features on. There is no dropout. ``matrix`` may give the propagation
    matrix of the graph, where more than the training needs it.
    """
    w = matrix or _propagation(edges, features)
    width = len(features.select("x").first()[0])
    spread = w.spread(w.numbered(features.select("id", "x")), width)
    known = cut(w.numbered(labels.select("id", F.col("y").cast("int")).where("y IS NOT NULL")), "network-labels")
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}  # a row a class
    classes = max(2, max(counts, default=0) + 1)
    share = np.array([1.0 / (len(counts) * counts[c] if balanced else sum(counts.values())) if c in counts else 0.0 for c in range(classes)])
    rng, sizes = np.random.default_rng(seed), [width, *hidden, classes]
    net = Network([(rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)])
    flat, losses = net.flat(), []
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, epochs + 1):
        loss, grad = _gradients(net.shaped(flat), w, spread, known, share)
        losses.append(loss)
        m, v = MOMENTS[0] * m + (1 - MOMENTS[0]) * grad, MOMENTS[1] * v + (1 - MOMENTS[1]) * grad**2
        flat = flat - rate * (m / (1 - MOMENTS[0] ** step)) / (np.sqrt(v / (1 - MOMENTS[1] ** step)) + TINY)
    drop(spread, known)
    if matrix is None:
        w.drop()
    return net.shaped(flat), losses
