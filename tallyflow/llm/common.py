"""Helpers shared by the text operators: shared storage for cut lineage, salted ranks, row hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions.tables import cut, drop_cuts, shared_dir
from tallyflow.functions.tables import load as table

__all__ = ["ROWS_A_SALT", "cut", "drop_cuts", "row_hash", "salted_rank", "shared_dir", "table"]

#: A range of a group's rows that one task ranks holds about so many rows of the whole table at most.
ROWS_A_SALT = 250_000


def row_hash(df: DataFrame, struct: str) -> Column:
    """A hash of all columns of ``df`` that can be hashed, held in the column ``struct``."""
    return F.xxhash64(*[F.col(struct).getField(f.name) for f in df.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))])


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank", salts: int | None = None) -> DataFrame:
    """Add ``rank``: 0, 1, 2 ... within each group of ``keys``, in an order drawn from ``order``'s hash.

    A hot group is spread over ``salts`` ranges of that hash, as many as the table has ROWS_A_SALT rows (64 at least).
    Rows are ranked inside a range, and a range's first rank is the count of the rows in the ranges below it, so no
    task sees a whole group and the order is the same on every run. Rows that agree in all of ``order`` are
    interchangeable. ``df`` should be a written table: it is counted first.
    """
    salts = salts or max(64, -(-df.count() // ROWS_A_SALT))
    salted = df.withColumn("_h", F.xxhash64(*order)).withColumn("_s", F.pmod(F.shiftrightunsigned("_h", 16), F.lit(salts)))
    counts = salted.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*keys, "_s", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_first"))
    first = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_s").alias("_ks"), "_first")
    inside = Window.partitionBy(*keys, "_s").orderBy("_h", *order)
    ranked = salted.withColumn("_r", F.row_number().over(inside) - 1)
    on = F.col("_s") == F.col("_ks")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranked.join(first, on).withColumn(rank, F.col("_r") + F.col("_first")).select(*df.columns, rank)
