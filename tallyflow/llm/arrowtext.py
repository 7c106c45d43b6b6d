"""Counts over whole Arrow string columns with numpy, without a Python object per text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1]]; a null is empty."""
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the flagged bytes each text has."""
    out = np.zeros(len(offsets) - 1, np.int64)
    some = offsets[:-1] < offsets[1:]
    if some.any():
        out[some] = np.add.reduceat(flags, offsets[:-1][some], dtype=np.int64)
    return out


def parts(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text each, so that arrays over bytes stay small; a longer text is a slice of its own."""
    ends = np.cumsum(np.diff(raw(batch.column(column))[1]))
    at = 0
    while at < batch.num_rows:
        start = ends[at - 1] if at else 0
        n = max(1, int(np.searchsorted(ends, start + most, side="right")) - at)
        yield batch.slice(at, n)
        at += n


def word_starts(data: np.ndarray, offsets: np.ndarray, space: np.ndarray | None = None) -> np.ndarray:
    space = SPACE[data] if space is None else space
    starts = ~space
    if len(data):
        starts[1:] &= space[:-1]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts[first] = ~space[first]
    return starts


def word_counts(col: pa.Array) -> np.ndarray:
    data, offsets = raw(col)
    return per_text(word_starts(data, offsets), offsets)
