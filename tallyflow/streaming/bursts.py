"""Counts of near rows on a stream: how many rows of the same key lie within some seconds before or after each row.

A row's counts are known when the watermark has passed the end of its longest span, as rows that come later are later
than the watermark. Until then a key's times wait in its state, with those that its waiting rows may still look back to;
an event-time timer wakes a key that gets no more rows. So a state holds two spans of a key's rows and the lateness.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

SPANS = {"burst_5m": 300, "burst_1h": 3600}


def burst_stream(stream: DataFrame, key: str, ts: str, ident: str, spans: dict[str, int] | None = None, late: str = "10 minutes") -> DataFrame:
    """(key, ts, ident, and a count for each of ``spans``) in append mode, each row once its counts are final.

    Counts include the row itself and equal features.burst_counts() over the rows that weren't too late. Rows that come
    again with the same time and ``ident`` count once; rows ``late`` behind the latest are left out by the watermark.
    Rows come out when a later batch moves the watermark past them.
    """
    spans = spans or SPANS
    reach = max(spans.values()) * 1_000_000
    rows = stream.select(key, ts, F.col(ident).cast("string").alias(ident)).withWatermark(ts, late)
    kinds = dict(rows.dtypes)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, idents, done = state.get if state.exists else ([], [], None)
        known = set(zip(times, idents, strict=True))
        if not state.hasTimedOut:
            for f in frames:
                known.update(zip(f[ts].astype("datetime64[us]").astype("int64").tolist(), f[ident].tolist(), strict=True))
        rows = sorted(known, key=lambda r: (r[0], r[1] is None, r[1] or ""))
        at = np.array([t for t, _ in rows], np.int64)
        mark = state.getCurrentWatermarkMs() * 1000
        final = mark - reach  # rows up to here have their counts
        low = 0 if done is None else int(np.searchsorted(at, done, "right"))
        high = max(low, int(np.searchsorted(at, final, "right")))
        if high > low:
            here = at[low:high]
            counts = {n: np.searchsorted(at, here + s * 1_000_000, "right") - np.searchsorted(at, here - s * 1_000_000, "left") for n, s in spans.items()}
            yield pd.DataFrame({key: [k[0]] * len(here), ts: here.astype("datetime64[us]"), ident: [i for _, i in rows[low:high]], **counts})
        if high == len(rows) and (not rows or at[-1] < mark - 2 * reach):
            state.remove()
            return
        keep = int(np.searchsorted(at, final - reach, "left"))
        kept = rows[keep:]
        state.update(([t for t, _ in kept], [i for _, i in kept], max(final, done) if done is not None else final))
        wake = (int(at[high]) + reach) // 1000 + 1 if high < len(rows) else (int(at[-1]) + 3 * reach) // 1000 + 1
        state.setTimeoutTimestamp(max(wake, mark // 1000 + 1))

    out = f"`{key}` {kinds[key]}, `{ts}` timestamp, `{ident}` string" + "".join(f", `{n}` bigint" for n in spans)
    return rows.groupBy(key).applyInPandasWithState(run, out, "times array<bigint>, idents array<string>, done bigint", "append", "EventTimeTimeout")
