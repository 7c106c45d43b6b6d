"""A labelled transaction graph from three CSV files: features by step, edges, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The classes (1 illicit, 2 licit, 0 unknown), the steps, and the names a header may hold.
FIRST_STEP, LAST_STEP = 1, 49
HEADER_NAMES = ("txid", "tx_id", "txid1", "txid2", "class", "time_step", "timestep")
WIDTH = 166
PROXY_FEATURES, PROXY_LOW, PROXY_HIGH = 10, 0.01, 10.0


def label(raw: Column) -> Column:
    """1 or 2 where the text says so, else 0."""
    return F.coalesce(F.when(F.trim(raw).isin("1", "2"), F.trim(raw).try_cast("int")), F.lit(0))


def step(raw: Column) -> Column:
    return F.least(F.lit(LAST_STEP), F.greatest(F.lit(FIRST_STEP), F.coalesce(raw.try_cast("int"), F.lit(1))))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Columns c0, c1, ... as text, with the header row left out if there is one; short and long lines are read."""
    lines = spark.read.text(path, recursiveFileLookup=True).where(F.trim("value") != "")
    cells = F.transform(F.split("value", ","), lambda c: F.trim(c))
    names = F.array(*[F.lit(n) for n in HEADER_NAMES])
    return lines.select(cells.alias("c")).where(~F.exists(F.slice("c", 1, 5), lambda c: F.array_contains(names, F.lower(c))))


def load(spark: SparkSession, features: str, edges: str, classes: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes with id, step, features (166 numbers, missing ones 0), label and amount."""
    f = read_table(spark, features)
    at = F.sequence(F.lit(2), F.lit(WIDTH + 1))
    x = f.select(F.get("c", F.lit(0)).alias("id"), step(F.get("c", F.lit(1))).alias("step"), F.transform(at, lambda i: F.coalesce(F.get("c", i).try_cast("double"), F.lit(0.0))).alias("features"))
    k = read_table(spark, classes).select(F.get("c", F.lit(0)).alias("k_id"), label(F.get("c", F.lit(1))).alias("label"))
    nodes = x.join(k, x["id"] == k["k_id"], "left").select("id", "step", "features", F.coalesce("label", F.lit(0)).alias("label"))
    return with_amount(nodes), read_table(spark, edges).select(F.get("c", F.lit(0)).alias("src"), F.get("c", F.lit(1)).alias("dst"))


def with_amount(nodes: DataFrame) -> DataFrame:
    """Adds ``amount``: the mean size of the first ten features, stretched to 0.01 to 10 over all nodes; 1 where all are alike."""
    first = F.slice("features", 1, PROXY_FEATURES)
    mean = F.aggregate(first, F.lit(0.0), lambda s, v: s + F.abs(v)) / F.greatest(F.size(first), F.lit(1))
    marked = nodes.withColumn("_m", mean)
    span = marked.agg(F.min("_m").alias("_lo"), F.max("_m").alias("_hi"))  # one row
    scaled = (F.col("_m") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (PROXY_HIGH - PROXY_LOW) + PROXY_LOW
    return marked.crossJoin(F.broadcast(span)).withColumn("amount", F.when(F.col("_hi") - F.col("_lo") < 1e-9, 1.0).otherwise(scaled)).drop("_m", "_lo", "_hi")


def statistics(nodes: DataFrame) -> DataFrame:
    """One row: nodes, illicit, licit and unknown ones, distinct steps and their bounds."""
    n = lambda v: F.count_if(F.col("label") == v)
    return nodes.agg(F.count(F.lit(1)).alias("n"), n(1).alias("illicit"), n(2).alias("licit"), n(0).alias("unknown"), F.countDistinct("step").alias("steps"), F.min("step").alias("first"), F.max("step").alias("last"))


def amount_statistics(nodes: DataFrame) -> DataFrame:
    """(label, mean, sd) for all three labels, zeros where a label has no node."""
    all_labels = nodes.sparkSession.createDataFrame([(0,), (1,), (2,)], "label int")
    found = nodes.groupBy("label").agg(F.avg("amount").alias("m"), F.stddev_pop("amount").alias("s"))
    return all_labels.join(found, "label", "left").select("label", F.coalesce("m", F.lit(0.0)).alias("mean"), F.coalesce("s", F.lit(0.0)).alias("sd"))
