"""Quality classifier: Bradley-Terry ranking from preference pairs, thresholded at a score quantile.

Every text is measured once (features of the whole text). Pairs of a good and a bad labelled document give
differences of features, and logistic loss on them gives each document a strength. The threshold is the quantile of
the labelled strengths that leaves as many below it as there are bad labels; a score is the logistic of a strength's
distance from it.

Everything is learnt from all labelled documents. Each document of the larger class is in EACH pairs, with partners dealt in
turn, so each of the smaller is in as many or more; Newton steps sum gradients over the pairs in tasks, and the driver
sees one sum of len(FEATURES) squared numbers a step. The threshold comes from exact ranks of all labelled strengths.

Defined cases: a null or empty text has all features zero and a score like any other; labels that are null or for
unknown documents are ignored; without labels of both classes every score is 0.5; repeated rows get a row each; texts
are read whole, however long; partners are dealt in the order of a hash, and equal strengths get equal scores; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions.ranges import ranked
from tallyflow.llm.arrowtext import SPACE, parts, per_text, raw, word_starts
from tallyflow.llm.common import cut, salted_rank, table
from tallyflow.llm.quality_rules import repeated_words

EACH = 6
SEED = 42
RIDGE = 1e-3

FEATURES = (
    "log_words", "word_length", "symbols", "exclamations", "bars", "upper", "digits", "punctuation", "non_ascii",
    "distinct", "repeated", "same_as_previous", "duplicate_lines", "ended_lines", "log_line_words", "has_text",
)


def _class(*codes: int | range) -> np.ndarray:
    flags = np.zeros(256, bool)
    for c in codes:
        flags[list(c) if isinstance(c, range) else c] = True
    return flags


UPPER, LOWER, DIGIT, HIGH = _class(range(65, 91)), _class(range(97, 123)), _class(range(48, 58)), _class(range(128, 256))
SYMBOL = _class(*b"#*$%&|<>")
MARKS = _class(*b",;:?\"'()-")


def features(col: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    data, at = raw(col)
    space = SPACE[data]
    count = lambda flags: per_text(flags, at).astype(float)
    words = count(word_starts(data, at, space))
    some, chars, letters = np.maximum(words, 1), np.maximum(count(~space), 1), np.maximum(count(UPPER[data] | LOWER[data]), 1)
    distinct, repeated, same, dup, ended, line_words = (np.zeros(len(at) - 1) for _ in range(6))
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        text = data[a:b].tobytes()
        tokens = text.split()
        if not tokens:
            continue
        n = len(tokens)
        distinct[i] = len(set(tokens)) / n
        repeated[i] = repeated_words(tokens) / n
        same[i] = sum(map(bytes.__eq__, tokens, tokens[1:])) / n
        lines = [x for x in (y.strip() for y in text.split(b"\n")) if x]
        dup[i] = 1 - len(set(lines)) / len(lines)
        ended[i] = sum(x.endswith((b".", b"!", b"?")) for x in lines) / len(lines)
        line_words[i] = np.log1p(n / len(lines))
    rare = lambda x: np.log1p(100 * x)  # noqa: E731  shares near zero matter most
    return np.column_stack([
        np.log1p(words), np.minimum(chars / some, 30), rare(count(SYMBOL[data]) / some), rare(count(data == 33) / some), rare(count(data == 124) / some),
        count(UPPER[data]) / letters, rare(count(DIGIT[data]) / chars), rare(count(MARKS[data]) / some), count(HIGH[data]) / chars,
        distinct * (words > 0), repeated, rare(same), rare(dup), ended, line_words, (words > 0).astype(float),
    ])


def featured(docs: DataFrame) -> DataFrame:
    picked = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole, 1)):
            x = features(b.column(1)).astype(np.float32)
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), rows], ["doc_id", "x"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, x array<float>")


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of the labels that are 0 or 1."""
    return labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))


def logistic_differences(d: np.ndarray | DataFrame, width: int | None = None, rounds: int = 25, ridge: float = RIDGE) -> np.ndarray:
    """Weights w that minimise the mean of log(1 + exp(-d w)) with a ridge, by Newton steps.

    ``d`` is an array, or a written table (d array) of ``width`` numbers a row, which tasks sum over.
    """
    w = np.zeros(width or d.shape[1])
    k = len(w)
    for _ in range(rounds):
        total = _moments(d, w) if isinstance(d, np.ndarray) else _summed(d, w)
        n, grad, hess = total[0], total[1 : 1 + k], total[1 + k :].reshape(k, k)
        step = np.linalg.solve(hess / n + ridge * np.eye(k), grad / n + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _moments(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """How many rows there are, and the sums over them of the gradient and of the second derivatives at ``w``."""
    p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
    return np.concatenate([[len(d)], d.T @ (p - 1), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])


def _summed(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((_moments(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(w)), w) for b in batches), np.zeros(1 + len(w) + len(w) ** 2))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    return rows.select("d").mapInArrow(run, "s array<double>").rdd.map(lambda r: np.array(r[0])).treeReduce(np.add)


def differences(known: DataFrame, sizes: dict[int, int], scale: np.ndarray, each: int = EACH) -> DataFrame:
    """(d): scaled features of a good document less those of a bad one. ``known`` is a written table (doc_id, y, x).

    In turn r, the i-th document of the larger class meets the one of the smaller at i and r parts of ``each`` further on.
    """
    larger = int(sizes[1] >= sizes[0])
    few = sizes[1 - larger]
    places = salted_rank(known, ["y"], [F.col("doc_id"), F.col("x")], "at")
    at = F.pmod(F.col("at") + F.floor(F.col("turn") * F.lit(few) / F.lit(each)), F.lit(few))
    many = places.where(F.col("y") == larger).select("at", F.col("x").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("turn"))
    both = many.select(at.alias("at"), "a").join(places.where(F.col("y") == 1 - larger).select("at", F.col("x").alias("b")), "at")
    sign = [(1.0 if larger else -1.0) / float(s) for s in scale]
    return both.select(F.array(*[(F.col("a")[i].cast("double") - F.col("b")[i].cast("double")) * F.lit(s) for i, s in enumerate(sign)]).alias("d"))


def strength(w: np.ndarray) -> Column:
    return sum((F.col("x")[i].cast("double") * float(v) for i, v in enumerate(w)), F.lit(0.0))


def fit(x: np.ndarray, y: np.ndarray, sizes: dict[int, int], each: int = EACH) -> tuple[np.ndarray, float] | None:
    """(weights on raw features, threshold) of arrays; fit_table() does the same for a table."""
    if len(sizes) < 2:
        return None
    larger = int(sizes[1] >= sizes[0])
    scale = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1)
    many, few = x[y == larger] / scale, x[y != larger] / scale
    partners = [few[(np.arange(len(many)) + turn * len(few) // each) % len(few)] for turn in range(each)]
    w = logistic_differences((1 if larger else -1) * np.concatenate([many - p for p in partners])) / scale
    return w, float(np.sort(x @ w)[sizes[0] - 1 : sizes[0] + 1].mean())


def fit_table(known: DataFrame) -> tuple[np.ndarray, float] | None:
    """(weights on raw features, threshold) from all of ``known``, a written table (doc_id, y, x); None unless both classes are there."""
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    scale = np.array(known.agg(*[F.stddev_pop(F.col("x")[i].cast("double")) for i in range(len(FEATURES))]).first(), float)
    scale = np.where(scale > 1e-9, scale, 1)
    w = logistic_differences(cut(differences(known, sizes, scale), "quality-pairs"), len(FEATURES)) / scale
    # As many labelled documents lie below the threshold as are bad: half way between the two on its sides.
    order = ranked(known.select(strength(w).alias("s")), [F.asc("s")])
    between = order.where(F.col("_rank").isin(sizes[0], sizes[0] + 1)).agg(F.avg("s")).first()[0]
    return w, float(between)


def score(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality") -> DataFrame:
    """(doc_id, score, predicted). ``train`` is a condition on doc_id that says which labels may be learnt from."""
    measured = cut(featured(docs), "quality-features")
    model = fit_table(cut(measured.join(known_labels(labels.where(train), label), "doc_id").select("doc_id", "y", "x"), "quality-known"))
    if model is None:
        s = F.lit(0.5)
    else:
        w, threshold = model
        s = 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), strength(w) - F.lit(threshold)))))
    return measured.select("doc_id", s.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fold(ids: Column, parts: int) -> Column:
    return F.pmod(F.crc32(ids.cast("string").cast("binary")), F.lit(parts))


def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fold(F.col("doc_id"), 3)
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), part != 1)
    return out.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "score", "predicted")
