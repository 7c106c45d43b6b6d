"""SimHash fingerprints and exact near-pair search with vantage-point trees.

A fingerprint is cut into blocks of bits. Two fingerprints within ``radius`` bits agree in at least one block to
within ``radius // blocks`` bits, so one vantage-point tree per block finds every pair. A tree node holds a
vantage point and a cut distance; a point goes left, right, or, when the triangle bound lets a partner lie on the
other side, to both. The top of each tree comes from a bounded sample and deals all fingerprints to shards with
overlapping borders; each shard grows its own lower tree and compares what is left in full width, so the links are
exact whatever the sample was.

Defined cases: a null or empty text has fingerprint zero and links like any other; repeated rows keep one result
row each; an empty table gives an empty result; columns other than the id and the text are ignored, whatever their
names; a component whose ids are all null has a null id; texts are read whole, however long, a batch's long texts in
slices; a bit that half of the shingles set, a tie, is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.llm.common import cut, row_hash, table

#: Bounds: fingerprints sampled to shape the trees' tops, and levels of those tops (at most 2**12 shards a block).
SAMPLE = 32_768
MAX_LEVELS = 12
SHARD_ROWS = 16_384
LEAF_ROWS = 256
#: A shard above this many rows is dealt as pairs of parts.
PART_ROWS = 16_384
#: A group of candidates with more texts or shingles than this is compared as pairs of parts, BLOCK texts by BLOCK at a time.
PART_SHINGLES, BLOCK = 1 << 22, 512
#: Bits of the finer comparison of near copies, and longs of all marks of a text.
FINE_BITS = 256
MARKS = 2 + FINE_BITS // 64 + 1


# ---------------------------------------------------------------- fingerprints


def _words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case; bytes.split() splits at ASCII white space only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _shingles(words: list[bytes], size: int) -> list[bytes]:
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half the 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of the whole text's shingles, repeats included."""
    parts = _shingles(_words(text), shingle)
    return majority_bits(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts))) if parts else 0


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _windows(h: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of the windows of so many words, from the words' hashes; of fewer words, the one of all."""
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, seed, np.uint64)
    for i in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : len(h) - size + 1 + i]
    return _mixed(out)


_KEYS = np.random.default_rng(42).integers(0, 1 << 32, (2, FINE_BITS, 1), np.uint32)


def least_bits(hashes: np.ndarray) -> np.ndarray:
    """FINE_BITS bits, one of the least of the hashes under each of as many rehashings: two sets with Jaccard similarity s
    agree in a bit with probability (1 + s) / 2."""
    hashes = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(FINE_BITS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(hashes), 256):
        x = hashes[None, at : at + 256] ^ _KEYS[0]
        x *= _KEYS[1] | np.uint32(1)
        np.minimum(least, x.min(axis=1), out=least)
    return np.packbits((least >> np.uint32(8)).astype(np.uint8) & 1, bitorder="little").view(np.uint64)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    words = _words(text)
    return _windows(_word_hashes(words), shingle, 44) if words else np.empty(0, np.uint64)


def marks(text: str | None, shingle: int) -> np.ndarray:
    """MARKS words: 128 SimHash bits over word pairs, FINE_BITS over the set of ``shingle``-word windows, a hash of all words."""
    words, out = _words(text), np.zeros(MARKS, np.uint64)
    if words:
        h = _word_hashes(words)
        out[:2] = [majority_bits(_windows(h, 2, seed)) for seed in (42, 43)]
        out[2:-1] = least_bits(_windows(h, shingle, 44))
    out[-1] = xxhash.xxh64_intdigest(b" ".join(words))
    return out


def _printed(docs: DataFrame, width: int, of) -> DataFrame:
    """(doc_id, fp) with fp = of(text), an array of ``width`` longs."""
    picked = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([of(t.as_py()) for t in b.column(1)], np.uint64).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(fps.view(np.int64)), pa.list_(pa.int64()))], ["doc_id", "fp"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, fp array<bigint>")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    return _printed(docs, 1, lambda t: fingerprint(t, shingle, seed))


def marked(docs: DataFrame, shingle: int) -> DataFrame:
    return _printed(docs, MARKS, lambda t: marks(t, shingle))


# ---------------------------------------------------------------- trees


def blocks_of(words: int, radius: int, per_word: int | None = None) -> list[tuple[int, np.uint64, int]]:
    """(word, mask, radius in the block): enough blocks that a pair within ``radius`` is within 1 bit in some block."""
    per_word = per_word or max(1, math.ceil((radius + 1) / 2 / words))
    edges = [round(64 * i / per_word) for i in range(per_word + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [(w, np.uint64(m), radius // (words * per_word)) for w in range(words) for m in masks]


def _split(x: np.ndarray, r: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point among ``x`` and the cut that balances it; None where no cut would separate anything.

    Left are distances up to the cut, right those from cut - r + 1 on: two points that differ by at most r cannot
    be at distances d <= cut - r and e > cut, as e - d would exceed r.
    """
    best = None
    for v in x[rng.integers(0, len(x), 4)]:
        d = np.bitwise_count(x ^ v).astype(np.int64)
        at = np.cumsum(np.bincount(d, minlength=2))
        for c in np.unique(np.clip(np.searchsorted(at, len(x) * np.array([0.4, 0.5, 0.6])), 0, len(at) - 1)):
            left, right = int(at[c]), len(x) - (int(at[c - r]) if c - r >= 0 else 0)
            cost = left * left + right * right
            if best is None or cost < best[0]:
                best = (cost, v, int(c))
    return (best[1], best[2]) if best and best[0] < 0.9 * len(x) * len(x) else None


def _sides(x: np.ndarray, v: np.uint64, c: int, r: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.bitwise_count(x ^ v).astype(np.int64)
    return d <= c, d > c - r


def grow_top(sample: np.ndarray, r: int, levels: int, seed: int) -> list[tuple[np.uint64, int] | None]:
    """A heap-ordered tree: node i has children 2i+1 and 2i+2; None is a shard."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple[np.uint64, int] | None] = [None] * (2 ** (levels + 1) - 1)
    todo = [(0, sample)]
    while todo:
        i, x = todo.pop()
        if i >= 2**levels - 1 or len(x) < 8 or (at := _split(x, r, rng)) is None:
            continue
        nodes[i] = at
        left, right = _sides(x, *at, r)
        todo += [(2 * i + 1, x[left]), (2 * i + 2, x[right])]
    return nodes


def route(x: np.ndarray, nodes: list, r: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions in x) of all shards that hold any of x or of what borders on it."""
    todo = [(0, np.arange(len(x)))]
    while todo:
        i, at = todo.pop()
        if not len(at):
            continue
        if nodes[i] is None:
            yield i, at
            continue
        left, right = _sides(x[at], *nodes[i], r)
        todo += [(2 * i + 1, at[left]), (2 * i + 2, at[right])]


@dataclass(frozen=True)
class Rule:
    """When two fingerprints are near: at most ``radius`` of the bits in the first ``words`` longs differ and, where
    ``fine`` says so, at most so many of the bits in the longs up to the last."""

    words: int = 1
    radius: int = 4
    fine: int | None = None

    def coarse(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
        for w in range(1, self.words):
            d = d + np.bitwise_count(a[:, None, w] ^ b[None, :, w])
        return d <= self.radius

    def length(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row by row, the bits that differ in the finer comparison, or in the whole."""
        part = slice(0, self.words) if self.fine is None else slice(self.words, -1)
        return np.bitwise_count(a[:, part] ^ b[:, part]).sum(axis=1, dtype=np.int64)

    def pairs(self, f: np.ndarray, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All near pairs (i, j) with i < j, between different sides if there are any, a slice of rows at a time."""
        step = max(1, (1 << 18) // max(1, len(f)))
        for at in range(0, len(f), step):
            near = np.triu(self.coarse(f[at : at + step], f[at:]), 1)
            if side is not None:
                near &= side[at : at + step, None] != side[None, at:]
            i, j = np.nonzero(near)
            i, j = i + at, j + at
            if self.fine is not None:
                ok = self.length(f[i], f[j]) <= self.fine
                i, j = i[ok], j[ok]
            yield i, j


def spanning(f: np.ndarray, rule: Rule, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Positions of links that join all that is linked in ``f``: a forest, not all pairs of a group.

    It is a shortest forest: two groups that one of its links joins have no shorter link between them. With ``side``, only
    links between different sides count.
    """
    linked = np.zeros(len(f), bool)
    for i, j in rule.pairs(f, side):
        linked[i] = linked[j] = True
    at = np.nonzero(linked)[0]
    f, side = f[at], None if side is None else side[at]
    far = np.iinfo(np.int64).max
    reach, via, out = np.full(len(at), far), np.zeros(len(at), np.int64), []
    waits = np.ones(len(at), bool)
    for _ in range(len(at)):
        u = int(np.argmin(np.where(waits, reach, far)))
        if reach[u] == far or not waits[u]:
            u = int(np.argmax(waits))
        else:
            out.append((int(at[via[u]]), int(at[u])))
        waits[u] = False
        near = rule.coarse(f[u : u + 1], f)[0] & waits
        if side is not None:
            near &= side != side[u]
        j = np.nonzero(near)[0]
        d = rule.length(f[u : u + 1], f[j])
        better = d < reach[j] if rule.fine is None else (d < reach[j]) & (d <= rule.fine)
        reach[j[better]], via[j[better]] = d[better], u
    return out


def search(f: np.ndarray, x: np.ndarray, r: int, rule: Rule, seed: int) -> list[tuple[int, int]]:
    """Links within one shard, a forest: the lower tree over the block's bits ``x``, then the rule on the full width ``f`` in
    its leaves."""
    rng, out, todo = np.random.default_rng(seed), [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        cuts = _split(x[at], r, rng) if len(at) > LEAF_ROWS else None
        if cuts is None:
            out += [(int(at[i]), int(at[j])) for i, j in spanning(f[at], rule)]
            continue
        left, right = _sides(x[at], *cuts, r)
        todo += [at[left], at[right]]
    return out


# ---------------------------------------------------------------- links and components


def links(distinct: DataFrame, rule: Rule, per_word: int | None = None, width: int = 1) -> DataFrame:
    """(u, v): links between different fingerprints (arrays of ``width`` longs) that join whatever is near by the rule.

    The links span each group of a shard; a group's other pairs follow from them. ``distinct`` holds each
    fingerprint once and should be a written table, as it is read three times.
    """
    spark = distinct.sparkSession
    words = rule.words
    blocks = blocks_of(words, rule.radius, per_word)
    n = distinct.count()
    share = min(1.0, SAMPLE / max(n, 1))
    by_hash = F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20) + 1)
    rows = distinct.where(by_hash).select("fp").limit(2 * SAMPLE).collect()
    sample = np.array([r[0][:words] for r in rows], np.int64).reshape(-1, words).view(np.uint64)
    sample = sample[np.lexsort(sample.T)]  # the same trees whatever the rows' order
    levels = min(MAX_LEVELS, max(0, math.ceil(math.log(max(n, 1) / SHARD_ROWS) / math.log(1.75))))
    tops = spark.sparkContext.broadcast([grow_top(sample[:, w] & m, r, levels, k) for k, (w, m, r) in enumerate(blocks)])
    size = 2 ** (MAX_LEVELS + 1)

    def deal(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, width)
            for k, (w, m, r) in enumerate(blocks):
                for shard, at in route(flat[:, w] & m, tops.value[k], r):
                    cols = [pa.array(np.full(len(at), k * size + shard, np.int32))]
                    cols += [pa.array(flat[at, i].view(np.int64)) for i in range(width)]
                    yield pa.RecordBatch.from_arrays(cols, ["shard", *(f"w{i}" for i in range(width))])

    cols = [f"w{i}" for i in range(width)]
    dealt = distinct.select("fp").mapInArrow(deal, "shard int, " + ", ".join(f"{c} bigint" for c in cols))
    dealt = cut(dealt, "simhash-dealt")
    large = dealt.groupBy("shard").count().where(F.col("count") > 2 * PART_ROWS).collect()  # those that no tree could split
    parts = {s: math.ceil(c / PART_ROWS) for s, c in large}
    if parts:  # a shard that the tree could not split: each pair of its parts is a group of its own
        many = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
        g = F.coalesce(many[F.col("shard")], F.lit(1))
        dealt = dealt.withColumn("g", g).withColumn("p", F.pmod(F.xxhash64(*cols), F.col("g")).cast("int"))
        other = F.explode(F.expr("sequence(0, g - 1)"))
        dealt = dealt.withColumn("q", other).select("shard", F.least("p", "q").cast("int").alias("a"), F.greatest("p", "q").cast("int").alias("b"), "p", *cols)
    else:
        zero = F.lit(0).cast("int")
        dealt = dealt.select("shard", zero.alias("a"), zero.alias("b"), zero.alias("p"), *cols)

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        f = np.column_stack([pdf[c].to_numpy(np.int64).view(np.uint64) for c in cols])
        f = f[order := np.lexsort(f[:, [-1, *range(words)]].T)]  # the last long tells all others of one SimHash apart
        shard, a, b = (int(pdf[c].iloc[0]) for c in ("shard", "a", "b"))
        k = shard // size
        w, m, r = blocks[k]
        part = pdf["p"].to_numpy()[order]
        pairs = search(f, f[:, w] & m, r, rule, shard) if a == b else spanning(f, rule, part)
        at = np.array(pairs, np.int64).reshape(-1, 2)
        signed = f.view(np.int64)
        return pd.DataFrame({c: pd.Series(signed[at[:, i]].tolist(), dtype=object) for i, c in enumerate("uv")})

    found = dealt.groupBy("shard", "a", "b").applyInPandas(within, "u array<bigint>, v array<bigint>")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): nodes of ``edges`` (u, v) and the least node that each reaches.

    Alternating large-star and small-star steps over written edge tables, until a step changes nothing. A step
    groups by node with partial minima, writes them and joins them back with a plain exchange on either side, so Spark
    can split the join of a hub's links.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "edges-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionAll(floor.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF)))).first())
        if now == seen:
            break
        seen = now
    tips = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return tips.unionAll(tips.select(F.col("root").alias("node"), "root").distinct())


def alike(f: np.ndarray, sets: list[np.ndarray], rule: Rule, similarity: float, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Positions of links of texts whose ``sets`` have this Jaccard similarity or more: a forest that joins all that do.

    Every pair that is near by the rule and not joined yet is compared, BLOCK texts with BLOCK texts at a time; with
    ``part``, pairs of different parts alone. Sets are numbers with a bit for each element that several of them have.
    """
    up, out = list(range(len(f))), []

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for a in range(0, len(f), BLOCK):
        for b in range(a, len(f), BLOCK):
            x, y = f[a : a + BLOCK], f[b : b + BLOCK]
            near = rule.coarse(x, y)
            if a == b:
                near = np.triu(near, 1)
            if part is not None:
                near &= part[a : a + BLOCK, None] != part[None, b : b + BLOCK]
            i, j = np.nonzero(near)
            ok = rule.length(x[i], y[j]) <= (rule.radius if rule.fine is None else rule.fine)
            i, j = (i[ok] + a).tolist(), (j[ok] + b).tolist()
            if not i:
                continue
            used = sorted({*i, *j})
            known, times = np.unique(np.concatenate([sets[k] for k in used]), return_counts=True)
            known = known[times > 1]
            bits = {}
            for k in used:
                flags = np.isin(known, sets[k], assume_unique=True)
                bits[k] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
            for u, v in zip(i, j, strict=True):
                if (p := top(u)) == (q := top(v)):
                    continue
                n, m = len(sets[u]), len(sets[v])
                both = (bits[u] & bits[v]).bit_count()
                if both >= similarity * (n + m - both):
                    up[p] = q
                    out.append((u, v))
    return out


def compared(members: DataFrame, rule: Rule, similarity: float) -> DataFrame:
    """(u, v): links of texts of enough similarity among the members (root, fp, items) of groups of candidates.

    A group of too many elements is dealt to parts by hash, and each pair of parts is a group of its own.
    """
    sizes = members.groupBy("root").agg(F.sum(F.size("items")).alias("total"), F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.greatest(F.col("total") / PART_SHINGLES, F.col("n") / PART_ROWS)).cast("int")
    large = cut(sizes.select(F.col("root").alias("l_root"), parts.alias("g")).where("g > 1"), "simhash-large")  # few: Spark broadcasts them while it can
    dealt = members.join(large, members["root"] == large["l_root"], "left").withColumn("g", F.coalesce("g", F.lit(1)))
    dealt = dealt.withColumn("p", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")).withColumn("q", F.explode(F.expr("sequence(0, g - 1)")))
    dealt = dealt.select("root", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "p", "fp", "items")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        f = np.array(pdf["fp"].tolist(), np.int64).view(np.uint64)
        order = np.lexsort(f.T)
        part = pdf["p"].to_numpy()[order] if pdf["a"].iloc[0] != pdf["b"].iloc[0] else None
        sets = [np.asarray(x, np.int64) for x in pdf["items"].to_numpy()[order]]
        at = np.array(alike(f[order], sets, rule, similarity, part), np.int64).reshape(-1, 2)
        signed = f[order].view(np.int64)
        return pd.DataFrame({c: pd.Series(signed[at[:, i]].tolist(), dtype=object) for i, c in enumerate("uv")})

    return dealt.groupBy("root", "a", "b").applyInPandas(within, "u array<bigint>, v array<bigint>")


def near_groups(fps: DataFrame, rule: Rule, per_word: int | None = None, width: int = 1, confirm=None) -> DataFrame:
    """(doc_id, fp, component_id) for (doc_id, fp) rows; component_id is the least doc_id reachable by links.

    Where it is given, ``confirm(nodes)`` finds the links that count among the nodes (root, fp, doc_id) of each group of
    candidates; doc_id is the fingerprint's least.
    """
    fps = cut(fps, "simhash-fps")
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    linked = components(links(reps, rule, per_word, width))
    if confirm:
        nodes = linked.join(reps, linked["node"] == reps["fp"]).select("root", "fp", F.col("first_id").alias("doc_id"))
        linked = components(confirm(cut(nodes, "simhash-candidates")))
    known = linked.join(reps, linked["node"] == reps["fp"]).select("node", "root", "first_id")
    least = known.groupBy("root").agg(F.min("first_id").alias("least_id"))
    placed = known.join(least, "root").select(F.col("node").alias("fp"), "least_id")
    named = reps.join(placed, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    # Written first, so that the join has a plain exchange on either side and a fingerprint of many copies can be split.
    named = cut(named, "simhash-components")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def near_fingerprints(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) by exact 64-bit SimHash links of at most ``radius`` differing bits."""
    out = near_groups(fingerprints(docs, shingle), Rule(1, radius))
    return out.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, fp, component_id): documents joined by links of word-shingle similarity ``similarity`` or more.

    ``doc_id`` must tell different texts apart. Candidates lie within 19 of 128 SimHash bits over word pairs, which word
    edits, cuts and insertions move little, and within so many of 256 bits of the shingles' least hashes that a pair of
    the wanted similarity is missed at three and a half deviations. Links between candidates make groups; within a group
    every pair of candidates is compared by the Jaccard similarity of their whole shingle sets (as 64-bit hashes), so a
    text that is near many others but like none of them hides no copy. Only texts of the same words share a fingerprint.
    """
    texts = docs.select("doc_id", "text")
    apart = FINE_BITS * (1 - similarity) / 2
    rule = Rule(2, 19, math.ceil(apart + 3.5 * math.sqrt(apart * (1 + similarity) / 2)))

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in b.column(2)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sets], ["root", "fp", "items"])

    def confirm(nodes: DataFrame) -> DataFrame:
        # Rows of one id have one text.
        of = texts.join(nodes, "doc_id").select("root", "fp", "text").dropDuplicates(["fp"])
        return compared(cut(of.mapInArrow(items, "root array<bigint>, fp array<bigint>, items array<bigint>"), "simhash-items"), rule, similarity)

    return near_groups(marked(texts, shingle), rule, 5, MARKS, confirm)


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, one of each group of near copies: the one with the least id (null ids come last)."""
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"))
    groups = near_copies(docs.select(key.alias("doc_id"), "text"), shingle, similarity)
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_stay")).distinct()
    # The document's own columns stay in one, where no name can clash; repeated rows have one key.
    keyed = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    both = keyed.join(stay.withColumnRenamed("_stay", "key"), "key")
    one = both.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(row_hash(docs, "doc")))).where("nth = 1")
    return one.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_fingerprints(table(spark, sf_dir, "documents"))
