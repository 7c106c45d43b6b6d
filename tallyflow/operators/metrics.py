"""Evaluation: ranking, calibration, distribution distances, splits, stress tests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions import ranges
from tallyflow.functions.scan import gaps


def brier(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def calibration_error(df: DataFrame, p: str = "p", y: str = "y", bins: int = 10, right_closed: bool = True) -> DataFrame:
    """Expected calibration error; bins are (lo, hi] with the first closed, or [lo, hi) with the last closed."""
    at = F.greatest(F.ceil(F.col(p) * bins), F.lit(1)) if right_closed else F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    per = df.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(p).cast("double")).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def running(per: DataFrame, order: Column, names: list[str]) -> DataFrame:
    """Adds to rows of distinct ``order`` the running sums of the named columns as run_<name> and their totals as all_<name>.

    Sums run inside ranges of about equally many rows and are lifted by the ranges before, so no task sees all rows.
    """
    parts = ranges.placed(per, [order])
    lifted = ranges.before(parts, {f"_b{i}": F.sum(c) for i, c in enumerate(names)})
    inside = Window.partitionBy("_part").orderBy("_at")
    run = parts.select("*", *[F.sum(c).over(inside).alias(f"_r{i}") for i, c in enumerate(names)]).join(F.broadcast(lifted), "_part")  # a row a range
    return run.select(*per.columns, *[(F.col(f"_r{i}") + F.col(f"_b{i}")).alias(f"run_{c}") for i, c in enumerate(names)], *[F.col(f"_b{i}_all").alias(f"all_{c}") for i, c in enumerate(names)])


def score_counts(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """(p, tp, fp, pos, neg): running counts from the highest score down, equal scores together."""
    per = df.groupBy(F.col(p).alias("p")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.sum(1 - F.col(y).cast("bigint")).alias("neg"))
    run = running(per, F.desc("p"), ["pos", "neg"])
    return run.select("p", F.col("pos").alias("pos_here"), F.col("run_pos").alias("tp"), F.col("run_neg").alias("fp"), F.col("all_pos").alias("pos"), F.col("all_neg").alias("neg"))


def average_precision(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Sum of precision times the step in recall."""
    c = score_counts(df, p, y)
    return c.agg(F.sum(F.col("pos_here") / F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def fpr_at_tpr(df: DataFrame, target: float = 0.9, p: str = "p", y: str = "y") -> DataFrame:
    """False-positive rate where the ROC, joined by straight lines, first reaches the target."""
    roc = score_counts(df, p, y).select((F.col("tp") / F.col("pos")).alias("tpr"), (F.col("fp") / F.col("neg")).alias("fpr"))
    below = roc.where(F.col("tpr") < target).agg(F.max(F.struct("tpr", "fpr")).alias("a"))
    reach = roc.where(F.col("tpr") >= target).agg(F.min(F.struct("tpr", "fpr")).alias("b"))
    a_t, a_f = F.coalesce(F.col("a.tpr"), F.lit(0.0)), F.coalesce(F.col("a.fpr"), F.lit(0.0))
    b_t, b_f = F.col("b.tpr"), F.col("b.fpr")
    return below.crossJoin(reach).select((a_f + (b_f - a_f) * (target - a_t) / (b_t - a_t)).alias("fpr"))


def ks_statistic(df: DataFrame, value: str, group: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of a value between group 0 and group 1, over all rows."""
    per = df.groupBy(F.col(value).alias("v")).agg(F.count(F.when(F.col(group) == 0, 1)).alias("a"), F.count(F.when(F.col(group) == 1, 1)).alias("b"))
    run = running(per, F.asc("v"), ["a", "b"])
    return run.agg(F.max(F.abs(F.col("run_a") / F.col("all_a") - F.col("run_b") / F.col("all_b"))).alias("ks"))


def correlation_distance(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Mean absolute difference of the two frames' Pearson correlations over pairs of columns."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    one = lambda df, p: df.agg(*[F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0)).alias(f"{p}{k}") for k, (x, y) in enumerate(pairs)])
    both = one(a, "a").crossJoin(one(b, "b"))
    return both.select((sum((F.abs(F.col(f"a{k}") - F.col(f"b{k}")) for k in range(len(pairs))), F.lit(0.0)) / len(pairs)).alias("distance"))


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as z-scores; a spread below 1e-9 counts as 1."""
    one = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    scale = lambda c: F.when(F.col(f"_s_{c}") < 1e-9, 1.0).otherwise(F.col(f"_s_{c}"))
    return df.crossJoin(F.broadcast(one)).select(*[c for c in df.columns if c not in columns], *[((F.col(c) - F.col(f"_m_{c}")) / scale(c)).alias(c) for c in columns])


#: Queries and rows that meet in one block of nearest_two().
QUERIES_A_BLOCK, ROWS_A_BLOCK = 4096, 16_384


def _two_nearest(q: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(positions of queries, distances): each query's two least distances to the rows y.

    A matrix product tells which rows may be among the two, with room for its rounding; only their distances are then summed,
    one place after the other.
    """
    ids, found = [], []
    lengths = (y * y).sum(axis=1)
    for at in range(0, len(x), 256):
        own = (x[at : at + 256] ** 2).sum(axis=1)[:, None]
        near = own + lengths - 2 * (x[at : at + 256] @ y.T)
        if same:
            near[q[at : at + 256, None] == b] = np.inf
        room = 1e-9 * (own + lengths.max(initial=0.0))
        second = np.partition(near, 1, axis=1)[:, 1:2] if len(y) > 1 else near
        i, j = np.nonzero((near <= second + room) & np.isfinite(near))
        for cut_at in range(0, len(i), 65_536):
            k, m = i[cut_at : cut_at + 65_536], j[cut_at : cut_at + 65_536]
            d = np.sqrt(np.add.accumulate((x[at + k] - y[m]) ** 2, axis=1)[:, -1])
            order = np.lexsort((d, k))
            k, d = k[order], d[order]
            first = np.concatenate([[True], k[1:] != k[:-1]])
            keep = first | np.concatenate([[False], first[:-1]])  # two of a query
            ids.append(at + k[keep])
            found.append(d[keep])
    return np.concatenate(ids or [np.empty(0, int)]), np.concatenate(found or [np.empty(0)])


def nearest_two(queries: DataFrame, base: DataFrame, vector: str, query_id: str, base_id: str, same: bool = False) -> DataFrame:
    """(query id, d1, d2): distances to the two nearest rows of ``base`` (not itself if ``same``).

    The queries are a stated set; blocks of them meet blocks of rows, each pair of blocks in one task, and a query's two
    least distances of each are compared at the end. Vectors have one length; a row without one is no neighbour.
    """
    q = queries.select(F.col(query_id).alias("_q"), F.col(vector).cast("array<double>").alias("_x"))
    b = base.select(F.col(base_id).alias("_b"), F.col(vector).cast("array<double>").alias("_y")).where("_y IS NOT NULL")
    n_q, n_b = (max(1, -(-df.count() // size)) for df, size in ((q, QUERIES_A_BLOCK), (b, ROWS_A_BLOCK)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    parts = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = q.where("_x IS NOT NULL").select(block("_q", n_q).alias("_i"), parts(n_b).alias("_j"), "_q", "_x")
    right = b.select(parts(n_q).alias("_i"), block("_b", n_b).alias("_j"), "_b", "_y")

    def met(one: pa.Table, two: pa.Table) -> pa.Table:
        rows = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
        if not len(one) or not len(two):
            return pa.table({"_q": one["_q"].slice(0, 0), "d": pa.array([], pa.float64())})
        at, d = _two_nearest(one["_q"].to_numpy(), rows(one["_x"]), two["_b"].to_numpy(), rows(two["_y"]), same)
        return pa.table({"_q": one["_q"].take(pa.array(at)), "d": pa.array(d)})

    pairs = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(met, f"_q {q.schema['_q'].dataType.simpleString()}, d double")
    pairs = pairs.unionByName(q.where("_x IS NULL").select("_q", F.lit(None).cast("double").alias("d")))
    top = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("_q").orderBy("d"))).where("_r <= 2")
    return top.groupBy("_q").agg(F.min("d").alias("d1"), F.max(F.when(F.col("_r") == 2, F.col("d"))).alias("d2")).withColumnRenamed("_q", query_id)


def _first_share(share: float) -> Column:
    return F.when(F.col("_rank") <= F.floor(F.col("_n") * share), "train").otherwise("test")


def temporal_split(df: DataFrame, ts: str, tie: str, share: float = 0.7) -> DataFrame:
    """Adds ``part``: train for the earliest ``share`` of the rows, test for the rest; ties by ``tie``."""
    return ranges.ranked(df, [F.asc(ts), F.asc(tie)]).select(*df.columns, _first_share(share).alias("part"))


#: Ranges of time that late_part() counts rows by.
SPANS = 65_536


def late_part(df: DataFrame, ts: str, tie: str, share: float = 0.7) -> DataFrame:
    """The rows that temporal_split() calls test, of a written table: those after the earliest ``share``; ties by ``tie``.

    Rows are counted by short spans of time, and only those of the span that the border is in are put in order.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high, n = df.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
    first = int(n * share)  # so many rows are early
    if low is None or not first:
        return temporal_split(df, ts, tie, share).where("part = 'test'").select(*df.columns)
    width = (high - low) // SPANS + 1
    span = F.coalesce(F.floor((at - low) / width), F.lit(-1))  # what has no time comes first
    before, border = 0, None
    for k, c in sorted(df.groupBy(span.alias("k")).count().collect()):  # a row a span
        if before + c >= first:
            border = k
            break
        before += c
    here = ranges.ranked(df.where(span == border).select(at.alias("_t"), F.col(tie).alias("_tie")), [F.asc("_t"), F.asc("_tie")])
    last = here.where(F.col("_rank") == first - before).select("_t", "_tie")  # one row
    after = (at > F.col("_t")) | (at.eqNullSafe(F.col("_t")) & (F.col(tie) > F.col("_tie")))
    return df.crossJoin(F.broadcast(last)).where((span > border) | ((span == border) & after)).select(*df.columns)


def random_split(df: DataFrame, key: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """Adds ``part``: train for the first ``share`` of the rows in the order of a seeded hash of the key."""
    return ranges.ranked(df, [F.xxhash64(F.lit(seed), key).asc(), F.asc(key)]).select(*df.columns, _first_share(share).alias("part"))


def community_disjoint(split: DataFrame, members: DataFrame, key: str, share: float = 0.3) -> DataFrame:
    """Rows of the last ``share`` of community ids go to test and the other communities' to train; unknown ones stay."""
    order = ranges.ranked(members.select("community").distinct(), [F.asc("community")])
    side = order.select("community", F.when(F.col("_rank") > F.floor(F.col("_n") * (1 - share)), "test").otherwise("train").alias("_side"))
    of = members.join(side, "community").select(F.col("id").alias("_id"), "_side")
    return split.join(of, split[key] == of["_id"], "left").withColumn("part", F.coalesce("_side", "part")).drop("_id", "_side")


def stratified_split(df: DataFrame, y: str, key: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """Adds ``part`` by hash order within each class: the first ``share`` of a class is train."""
    classes = df.groupBy(F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_c"))
    lower = classes.select("_y", "_c", F.coalesce(F.sum("_c").over(Window.orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"))  # a row a class
    order = ranges.ranked(df, [F.asc(y), F.xxhash64(F.lit(seed), key).asc(), F.asc(key)]).join(F.broadcast(lower), F.col(y).eqNullSafe(F.col("_y")))
    return order.withColumn("part", F.when(F.col("_rank") - F.col("_below") <= F.floor(F.col("_c") * share), "train").otherwise("test")).select(*df.columns, "part")


def stress(df: DataFrame, p: str = "p", illicit: Column | None = None, level: float = 0.95) -> DataFrame:
    """(threshold, detection, false_alarms) with the threshold at a percentile of the normal rows' scores."""
    bad = illicit if illicit is not None else F.col("y") == 1
    limit = ranges.percentile(df.where(~bad), p, level, "threshold")
    over = (F.col(p) > F.col("threshold")).cast("double")
    return df.crossJoin(F.broadcast(limit)).groupBy("threshold").agg(F.avg(F.when(bad, over)).alias("detection"), F.avg(F.when(~bad, over)).alias("false_alarms"))


def l1_distance(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Sum of absolute differences of two one-row frames."""
    both = a.select([F.col(c).alias(f"a_{c}") for c in columns]).crossJoin(b.select([F.col(c).alias(f"b_{c}") for c in columns]))
    return both.select(sum((F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in columns), F.lit(0.0)).alias("distance"))


def fit_lognormal(df: DataFrame, amount: str, keys: list[str] | None = None) -> DataFrame:
    """(keys ..., mu, sigma) of the logarithms of positive amounts, in one pass for all groups; a table without any has zeros."""
    logs = df.where(F.col(amount) > 0).select(*(keys or []), F.ln(amount).alias("l"))
    return logs.groupBy(*(keys or [])).agg(F.coalesce(F.avg("l"), F.lit(0.0)).alias("mu"), F.coalesce(F.stddev_pop("l"), F.lit(0.0)).alias("sigma"))


def fit_rate(df: DataFrame, key: str, ts: str, tie: str, default: float = 1 / 600) -> DataFrame:
    """One over the median positive gap in seconds between a key's consecutive rows."""
    return ranges.percentile(gaps(df.select(key, ts, tie), key, ts, tie).where("gap > 0"), "gap", 0.5, "median").select(F.coalesce(1 / F.col("median"), F.lit(default)).alias("rate"))


def sweep_decision(scores: DataFrame, setting: str, value: str, limit: float = 0.03) -> DataFrame:
    """One row: the largest difference of a measure between two settings, and whether it is too small to keep the setting."""
    span = (F.max(value) - F.min(value)).alias("largest_difference")
    return scores.agg(F.count(setting).alias("n"), span).withColumn("drop", F.col("largest_difference") <= limit)
