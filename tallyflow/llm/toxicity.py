"""Toxicity by maximum-scoring segments of token log-odds.

Token log-odds between toxic and other labelled documents carry an informative Dirichlet prior (the pooled
frequencies); a document counts once for a token, however often it repeats it. Tokens are words and their stems of four
to six bytes, as slurs are inflected; those whose log-odds stand out in units of their own deviation form the lexicon. A word scores as the strongest of its tokens there, and
any other word gets the common log-odds of not being in it, a small negative. In each text a linear-time scan finds every maximal
scoring segment. Scores of the best segment in clean text follow an extreme-value law with parameters lambda and K;
they turn a segment's score into a normalised one, and a document's is the sum over its significant segments. A
logistic curve, fitted on labelled documents that the lexicon hasn't seen, maps that to a score from 0 to 1.

Everything is learnt from all labelled documents: counts, the law's parameters and the curve are sums that tasks make. What
comes to the driver whole is the lexicon, and how often each of its values is in clean text.

Defined cases: a null or empty text has no segment and the score of a text without any; without labels of both
classes every score is 1 / (1 + e^30), next to 0; equal texts have equal scores; repeated rows get a row each; an empty table gives an empty result; texts are read whole;
other columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.common import cut, table
from tallyflow.llm.quality_model import fold, known_labels, logistic_differences

#: Weight of the prior in documents; least deviations from zero, least log-odds and least toxic documents of a token.
PRIOR_DOCS = 20.0
STANDS_OUT = 2.4
LEAST_ODDS = 0.7
LEAST_DOCS = 3
#: A segment counts as significant below this expected number in clean text.
EXPECTED = 0.05

#: Lower case, with ASCII punctuation as white space.
_FOLD = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i + 32 if 65 <= i <= 90 else i for i in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


STEMS = (4, 5, 6)


def features(words: list[bytes]) -> set[bytes]:
    """The words and stems of a text; a stem ends in a hyphen, which no word holds."""
    seen = set(words)
    return seen | {w[:k] + b"-" for w in seen for k in STEMS if len(w) > k}


class Values(dict):
    """word -> its score, 0 for none; remembers words, and forgets them all when they are many."""

    def __init__(self, lexicon: dict[bytes, float]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, w: bytes) -> float:
        if len(self) > 150_000:
            self.clear()
        get = self.lexicon.get
        value = max(get(w, 0.0), *(get(w[:k] + b"-", 0.0) for k in STEMS if len(w) > k), 0.0)
        self[w] = value
        return value


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) in linear time.

    ``hits`` are (position, positive score); each token between two hits scores -``drift``. Candidates keep the
    cumulative score before and after them and point to the nearest earlier one with a smaller score before it, so
    candidates once passed over are never walked again; a new one absorbs earlier ones while that makes a better segment.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, last, score before, score after, pointer
    total, before = 0.0, -1
    for at, s in hits:
        total -= drift * (at - before - 1)
        before = at
        first, left = at, total
        total += s
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            first, left = found[j][0], found[j][2]
            del found[j + 1 :]
            j = found.pop()[4]
        found.append((first, at, left, total, j))
    return [(a, b, r - left) for a, b, left, r, _ in found]


@dataclass
class Model:
    lexicon: dict[bytes, float] = field(default_factory=dict)
    drift: float = 0.01
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    shift: float = -30.0

    @cached_property
    def values(self) -> Values:
        return Values(self.lexicon)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words, values = tokens(text), self.values
        hits = [(i, v) for i, w in enumerate(words) if (v := values[w])]
        return len(words), segments(hits, self.drift) if hits else []

    def normal(self, n: int, score: float) -> float:
        """-log of the expected number of such segments in clean text of n tokens."""
        return self.lam * score - math.log(self.k * max(n, 1))

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Sum over the significant segments; the best one's, at most zero, where none is."""
        if not found:
            return 0.0
        least = -math.log(EXPECTED)
        marks = [self.normal(n, s) for _, _, s in found]
        strong = [m for m in marks if m >= least]
        return 1 + math.log1p(sum(strong)) if strong else max(0.0, min(1.0, max(marks) / least))

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * evidence + self.shift))))


def log_odds(counts: DataFrame, docs: tuple[int, int]) -> DataFrame:
    """(w, value): the lexicon from (w, a, b), the documents of class 0 and of class 1 with a token, and all of each."""
    n0, n1 = docs
    prior = PRIOR_DOCS * (F.col("a") + F.col("b")) / (n0 + n1)
    value = F.ln((F.col("b") + prior) / (n1 + PRIOR_DOCS)) - F.ln((F.col("a") + prior) / (n0 + PRIOR_DOCS))
    scored = counts.select("w", "b", value.alias("value"), F.sqrt(1 / (F.col("a") + prior) + 1 / (F.col("b") + prior)).alias("deviation"))
    return scored.where((F.col("b") >= LEAST_DOCS) & (F.col("value") >= STANDS_OUT * F.col("deviation")) & (F.col("value") > LEAST_ODDS)).select("w", "value")


def root(values: np.ndarray, share: np.ndarray, rest: float, drift: float) -> float:
    """The lambda above zero at which the mean of exp(lambda * score) over clean tokens is one.

    It exists where clean tokens score below zero on average and some of them above; else it is taken as 1.
    """
    if not len(values) or float((share * values).sum()) >= rest * drift:
        return 1.0
    f = lambda x: float((share * np.exp(np.minimum(x * values, 700))).sum() + rest * math.exp(-x * drift) - 1)
    low = high = 1e-6
    while f(high) < 0:
        high = high * 2 + 0.01
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def scale(best: list[tuple[int, float]], lam: float) -> float:
    """K by maximum likelihood, from clean texts' sizes and best scores: P(best < s) = exp(-K n exp(-lambda s))."""
    return len(best) / max(1e-300, sum(n * math.exp(-min(700.0, lam * s)) for n, s in best)) if best else 1.0


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Seven in ten labelled documents give the lexicon, the others the calibration."""
    part = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(10)) < 7
    # Joined in one way at any size: texts are shuffled once, in proportion to them, and never sorted.
    joined = docs.select("doc_id", "text").join(known_labels(labels, label).hint("shuffle_hash"), "doc_id")
    known = cut(joined.select("text", "y", part.alias("first")), "toxic-known")
    learn = known.where("first")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                seen[y].update(features(tokens(t.as_py())))
        words = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array([seen[y][w] for w in words], pa.int64()) for y in (0, 1))], ["w", "a", "b"])

    n = {r[0]: r[1] for r in learn.groupBy("y").count().collect()}
    if len(n) < 2:
        return Model()
    counts = learn.select("text", "y").mapInArrow(count, "w binary, a bigint, b bigint").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # What stands out, found by Spark, is all that comes to the driver.
    lexicon = {bytes(r[0]): r[1] for r in log_odds(counts, (n[0], n[1])).collect()}
    model = Model(lexicon)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, at, value, values = [], [], [], Values(sent.value)
            for t in b.column(0):
                words = tokens(t.as_py())
                mine = [(i, v) for i, w in enumerate(words) if (v := values[w])]
                size.append(len(words))
                at.append([i for i, _ in mine])
                value.append([v for _, v in mine])
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array(value, pa.list_(pa.float64())), *b.columns[1:]], ["n", "at", "value", "y", "first"])

    scanned = cut(known.mapInArrow(hits, "n bigint, at array<bigint>, value array<double>, y int, first boolean"), "toxic-hits")
    seen = {r[0]: (r[1], r[2]) for r in scanned.groupBy("y").agg(F.sum(F.size("at")), F.sum("n")).collect()}
    rate = lambda y: max(1e-5, seen[y][0] / max(1, seen[y][1]))
    model.drift = max(0.005, math.log((1 - min(0.5, rate(0))) / (1 - min(0.6, rate(1)))))
    held = scanned if scanned.where("NOT first").isEmpty() else scanned.where("NOT first")
    clean = held.where("y = 0")
    total = max(1, clean.agg(F.sum("n")).first()[0] or 0)
    times = clean.select(F.explode("value").alias("v")).groupBy("v").agg(F.count(F.lit(1))).orderBy("v").collect()  # a row a value of the lexicon at most
    values, share = np.array([r[0] for r in times]), np.array([r[1] for r in times]) / total
    model.lam = root(values, share, 1 - float(share.sum()), model.drift)

    drift = model.drift

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [[s for _, _, s in segments(list(zip(at, v, strict=True)), drift)] for at, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.list_(pa.float64())), b.column(3)], ["n", "found", "y"])

    found = cut(held.select("n", "at", "value", "y").mapInArrow(scan, "n bigint, found array<double>, y int"), "toxic-segments")
    # As scale() does, summed by Spark.
    best = F.coalesce(F.array_max("found"), F.lit(0.0))
    texts, mass = found.where("y = 0").agg(F.count(F.lit(1)), F.sum(F.col("n") * F.exp(-F.least(F.lit(700.0), F.lit(model.lam) * best)))).first()
    model.k = texts / max(1e-300, mass) if texts else 1.0
    if found.select("y").distinct().count() == 2:
        law = Model(drift=model.drift, lam=model.lam, k=model.k)

        def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = [law.evidence(n, [(0, 0, s) for s in f]) for n, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                d = [[v, 1.0] if y == 1 else [-v, -1.0] for v, y in zip(x, b.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.list_(pa.float64()))], ["d"])

        w = logistic_differences(cut(found.mapInArrow(sides, "d array<double>"), "toxic-evidence"), 2, ridge=1e-4)
        model.slope, model.shift = max(0.0, float(w[0])), float(w[1])
    else:
        model.slope, model.shift = 4.0, -4.0
    return model


SPANS = "array<struct<first:bigint,last:bigint,score:double,expected:double>>"


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", extra: list[str] | None = None) -> DataFrame:
    """(doc_id, score, predicted, passages): every significant passage as token positions, score and expectation.

    ``extra`` columns of the documents ride along; they may include the text.
    """
    extra = [c for c in extra or [] if c != "text"] + ["text"] * ("text" in (extra or []))
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label))
    picked = docs.select("doc_id", "text", *[c for c in extra if c != "text"])
    at = {c: picked.columns.index(c) for c in extra}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            scores, spans = [], []
            for t in b.column(1):
                n, found = model.scan(t.as_py())
                scores.append(model.score(model.evidence(n, found)))
                marked = [(f, z, s, math.exp(-model.normal(n, s))) for f, z, s in found]
                spans.append([{"first": f, "last": z, "score": s, "expected": e} for f, z, s, e in marked if e <= EXPECTED])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
            cols = [b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([*cols, *(b.column(at[c]) for c in extra)], ["doc_id", "score", "predicted", "passages", *extra])

    kinds = {f.name: f.dataType.simpleString() for f in picked.schema}
    return picked.mapInArrow(run, f"doc_id {kinds['doc_id']}, score double, predicted int, passages {SPANS}" + "".join(f", `{c}` {kinds[c]}" for c in extra))


def op2_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part: Column = fold(F.col("doc_id"), 5)
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(part != 0))
    return out.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", "predicted")
