"""Ranks and quantiles over whole tables, without a task that sees all rows.

Spark deals the rows to ranges of the order that hold about equally many, ties included; a row's rank is its place in
its range plus the rows of the ranges before. What is brought together is one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions.tables import cut

_PLACES = 33  # bits of a row's place in monotonically_increasing_id()


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with ``_part``, the number of their range, and ``_at``, their place in it from 0; a written table."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return cut(rows, "ranges").select(*df.columns, F.shiftright("_id", _PLACES).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << _PLACES) - 1)).alias("_at"))


def before(parts: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(_part, and for each named sum what the ranges before it have, and all have as <name>_all): a row a range."""
    each = parts.groupBy("_part").agg(*[c.alias(n) for n, c in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("_part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums], *[F.sum(n).over(Window.partitionBy()).alias(f"{n}_all") for n in sums])


def ranked(df: DataFrame, order: list[Column], name: str = "_rank", total: str = "_n") -> DataFrame:
    """Adds each row's rank from 1 in a total order, and the number of rows."""
    parts = placed(df, order)
    first = before(parts, {"_first": F.count(F.lit(1))})
    both = parts.join(F.broadcast(first), "_part")  # as many rows as ranges
    return both.select(*df.columns, (F.col("_first") + F.col("_at") + 1).alias(name), F.col("_first_all").alias(total))


def percentile(df: DataFrame, value: str, level: float, name: str) -> DataFrame:
    """One row: the value at ``level`` of the non-null ones, on the line between the two nearest; null where there is none.

    Equal values are counted first, so that a value that most rows have is one row of a range.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    parts = placed(per, [F.asc("_v")])
    run = F.sum("_c").over(Window.partitionBy("_part").orderBy("_at"))
    rows = parts.withColumn("_run", run).join(F.broadcast(before(parts, {"_b": F.sum("_c")})), "_part")  # a row a range
    at = (F.col("_b_all") - 1) * F.lit(level) + 1
    last = F.col("_run") + F.col("_b")
    has = lambda rank: F.max(F.when((rank <= last) & (rank > last - F.col("_c")), F.col("_v")))
    low, high = has(F.floor(at)), has(F.ceil(at))
    return rows.agg((low + (high - low) * F.max(at - F.floor(at))).alias(name))
