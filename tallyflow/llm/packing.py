"""Packing token sequences: shortest-pack-first over the histogram of piece lengths.

Documents are tokenised once and cut at every 1024 ids; the pieces' lengths form a histogram of at most 1024
counts. The packing is planned on that histogram alone, longest lengths first, each placed on the shortest pattern
of lengths so far; patterns with their counts then meet the pieces again by the piece's rank among its length.

Defined cases: a null or empty text is its end token alone; repeated rows are packed each for itself; an empty table
gives an empty result; texts are read whole, however long; pieces of one length are
ranked by a hash of their document, start and ids, and those that agree in all are interchangeable; other columns may have any name.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyflow.llm.common import cut, salted_rank, table

LENGTH = 1024
#: Rows of the plan that are broadcast (40 bytes each).
MOST_SLOTS = 100_000
TOKENIZER = "byte_bpe_50k.json"
#: The published split of byte-level BPE, and the same without its look-ahead, which only runs of white space need.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FAST_SPLIT = SPLIT.replace(r"\s+(?!\S)|", "")
RUNS = re.compile(r"\s\s")
LONG_WORD = re.compile(r"\S{2000}")


class Encoder:
    """Ids of texts as the tokenizers library gives them.

    Most texts go through tiktoken over the same vocabulary, which is several times faster and gives the same ids;
    texts that hold the string of a special token or a very long word go through tokenizers itself.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}  # the published byte alphabet
        ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("fast", pat_str=FAST_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.full = tiktoken.Encoding("full", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def exact(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special) or LONG_WORD.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return (self.full if RUNS.search(text) else self.fast).encode_ordinary(text)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document's ids, cut at each ``length``."""
    picked = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        for b in batches:
            row, start, size, crc, total = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                ids = np.array([*encode(t.as_py() or ""), end], "<u4")
                for at in range(0, len(ids), length):
                    part = ids[at : at + length]
                    row.append(i)
                    start.append(at)
                    size.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
            cols = [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, size, crc, total))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a pack, packs) by shortest-pack-first: longest lengths first, each on the shortest packs."""
    by_total: dict[int, list[list]] = {}  # total -> [pattern, packs]
    totals: list[int] = []

    def add(pattern: tuple[int, ...], packs: int) -> None:
        total = sum(pattern)
        if total not in by_total:
            by_total[total] = []
            heapq.heappush(totals, total)
        for old in by_total[total]:
            if old[0] == pattern:
                old[1] += packs
                return
        by_total[total].append([pattern, packs])

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if totals and totals[0] + size <= length:
                total = totals[0]
                group = by_total[total][-1]
                n = min(left, group[1])
                group[1] -= n
                if not group[1]:
                    by_total[total].pop()
                    if not by_total[total]:
                        del by_total[total]
                        heapq.heappop(totals)
                add((*group[0], size), n)
            else:
                n = left
                add((size,), n)
            left -= n
    return sorted((tuple(p), n) for groups in by_total.values() for p, n in groups)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = 0) -> DataFrame:
    """The pieces with sequence_id and offset. Sequences are gapless from 0; what they lack to ``length`` is padding."""
    spark = docs.sparkSession
    cuts = cut(pieces(docs, tokenizer, length, end), "pack-pieces")
    histogram = {r[0]: r[1] for r in cuts.groupBy("length").count().collect()}  # at most `length` rows
    first: dict[int, int] = {}
    slots, sequence = [], 0
    for pattern, packs in patterns(histogram, length):
        offset = 0
        for size in pattern:
            low = first.get(size, 0)
            slots.append((size, low, low + packs, sequence - low, offset))
            first[size] = low + packs
            offset += size
        sequence += packs
    # A placement ends a length or a pattern's packs, so slots grow with the lengths and not with the input; Spark
    # broadcasts them while they are few and joins by length otherwise.
    places = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "p_length bigint, low bigint, high bigint, shift bigint, offset bigint")
    ranked = salted_rank(cuts, ["length"], [F.col("doc_id"), F.col("start"), F.col("ids_crc32")])
    at = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    both = ranked.join(F.broadcast(places) if len(slots) <= MOST_SLOTS else places, at)
    return both.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("shift")).alias("sequence_id"), "offset")


def op8_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
