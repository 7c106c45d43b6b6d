"""Registration of queries, and the record roles that the sample tables play."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions.tables import dealt, load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with the SQL that gives the same rows where SQL can say it."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events")


def payments(spark: SparkSession, d: str) -> DataFrame:
    """Orders as transactions: txid, wallet, ts, outputs and amounts from the lines, fee."""
    li = load(spark, d, "lineitem")
    n = li.count()
    lines = dealt(li.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_tax"), n, "l_orderkey").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_extendedprice"))).alias("lines"),
        F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("fee"),
    )
    orders = dealt(load(spark, d, "orders"), n, "o_orderkey")
    both = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"])
    return both.select(
        F.col("o_orderkey").alias("txid"), F.col("o_custkey").alias("wallet"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("script"),
        F.col("o_totalprice").alias("amount"), F.col("lines.l_suppkey").alias("outputs"), F.col("lines.l_extendedprice").alias("amounts"), "fee",
    )


PAYMENTS = """pay AS (SELECT o_orderkey AS txid, o_custkey AS wallet, o_orderdate AS ts, o_orderpriority AS script, o_totalprice AS amount,
  list(l_suppkey ORDER BY l_linenumber, l_suppkey, l_extendedprice) AS outputs, list(l_extendedprice ORDER BY l_linenumber, l_suppkey, l_extendedprice) AS amounts, sum(l_extendedprice * l_tax) AS fee
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""


def nation_edges(spark: SparkSession, d: str) -> DataFrame:
    """A weighted graph of nations: the customer's to the supplier's, a line each."""
    li, o, c, s = (load(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    li = li.select("l_orderkey", "l_suppkey", "l_extendedprice")
    return (
        li.join(o.select("o_orderkey", "o_custkey", "o_orderdate"), li["l_orderkey"] == F.col("o_orderkey"))
        .join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), F.col("l_extendedprice").alias("amount"), F.col("o_orderdate").alias("ts"), "l_orderkey")
    )


NATIONS = """ne AS (SELECT c_nationkey AS src, s_nationkey AS dst, l_extendedprice AS amount, o_orderdate AS ts, l_orderkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def wallet_edges(spark: SparkSession, d: str) -> DataFrame:
    """Customers to the suppliers they paid: src c<key>, dst s<key>, weight the number of lines."""
    li, o = load(spark, d, "lineitem"), load(spark, d, "orders")
    n = li.count()
    li, o = dealt(li.select("l_orderkey", "l_suppkey"), n, "l_orderkey"), dealt(o.select("o_orderkey", "o_custkey"), n, "o_orderkey")
    both = dealt(li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("o_custkey", "l_suppkey"), n, "o_custkey", "l_suppkey")
    pairs = both.groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("weight"))  # keys are shorter than names
    return pairs.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), "weight")


WALLETS = """we AS (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, count(*)::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a score from 0 to 1 and a label: id, p, y."""
    li = load(spark, d, "lineitem")
    p = (F.col("l_quantity") / 50 + F.col("l_discount") * 5 + F.when(F.col("l_returnflag") == "R", 0.3).otherwise(0.0)) / 2
    return li.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), "l_orderkey", "l_suppkey", F.col("l_shipdate").alias("ts"),
        F.round(F.least(F.lit(1.0), p.cast("double")), 4).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


SCORES = """sc AS (SELECT l_orderkey * 100 + l_linenumber AS id, l_orderkey, l_suppkey, l_shipdate AS ts,
  round(least(1.0::DOUBLE, ((l_quantity::DOUBLE / 50::DOUBLE + l_discount::DOUBLE * 5::DOUBLE + CASE WHEN l_returnflag = 'R' THEN 0.3::DOUBLE ELSE 0::DOUBLE END) / 2::DOUBLE)), 4) AS p,
  (l_returnflag = 'R')::INT AS y FROM lineitem)"""


def r6(c, digits: int = 6):
    """A rounded double without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def betweenness_sql(edges: str, pivots: str, depth: int = 10) -> str:
    """CTEs that end in bw(id, betweenness), for graphs whose nodes are at most ``depth`` steps from a root."""
    ctes = [f"be AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({edges}) WHERE src <> dst)", "bl AS MATERIALIZED (SELECT src AS a, dst AS b FROM be UNION SELECT dst, src FROM be)", f"pt0 AS MATERIALIZED (SELECT id AS root, id, 1.0::DOUBLE AS paths FROM ({pivots}))", "seen0 AS MATERIALIZED (SELECT root, id FROM pt0)"]
    for i in range(1, depth + 1):
        ctes.append(f"pt{i} AS MATERIALIZED (SELECT p.root, b AS id, sum(p.paths) AS paths FROM pt{i - 1} p JOIN bl ON p.id = a WHERE NOT EXISTS (SELECT 1 FROM seen{i - 1} s WHERE s.root = p.root AND s.id = b) GROUP BY ALL)")
        ctes.append(f"seen{i} AS MATERIALIZED (SELECT * FROM seen{i - 1} UNION ALL SELECT root, id FROM pt{i})")
    ctes.append(f"ow{depth} AS MATERIALIZED (SELECT root, id, paths, 0.0::DOUBLE AS owed FROM pt{depth})")
    for i in range(depth - 1, -1, -1):
        ctes.append(f"ow{i} AS MATERIALIZED (SELECT p.root, p.id, p.paths, p.paths * coalesce(sum((1 + c.owed) / c.paths), 0) AS owed FROM pt{i} p LEFT JOIN (bl JOIN ow{i + 1} c ON c.id = b) ON c.root = p.root AND a = p.id GROUP BY p.root, p.id, p.paths)")
    every = " UNION ALL ".join(f"SELECT root, id, owed FROM ow{i}" for i in range(depth + 1))
    ctes.append(f"bw AS MATERIALIZED (SELECT n.id, coalesce(s, 0) / 2 AS betweenness FROM (SELECT DISTINCT a AS id FROM bl) n LEFT JOIN (SELECT id, sum(owed) AS s FROM ({every}) WHERE id <> root GROUP BY id) o ON n.id = o.id)")
    return ", ".join(ctes)
