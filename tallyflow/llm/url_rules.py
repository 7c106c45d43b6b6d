"""URL filters by expressions of host suffix and path prefix.

Each distinct (host, path) is expanded to its host suffixes times the path prefixes of the lengths that rules have;
the expressions meet the rules in an equi-join on a short prefix of their SHA-256, and the full digests confirm it.
The longest rule wins; of equal ones a block.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule; repeated rows keep a
row each; a url of any length is judged whole; an empty table or rule set gives an empty result or the default verdict; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.common import cut, table

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DEFAULT = "allow"
PREFIX = 8


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict). ``rules`` has host, path and verdict."""
    shape = rules.agg(F.collect_set(F.size(F.split("host", r"\."))), F.collect_set(F.length("path"))).first()
    labels, lengths = sorted(shape[0]), sorted(shape[1])  # distinct counts only: a few numbers for any rule set
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parts = F.split("host", r"\.")
    suffixes = F.array(*[F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")) for n in labels])
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    some = urls.select("host", "path").distinct() if labels and lengths else None
    if some is None:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hosts = some.select("host", "path", F.explode(F.array_compact(suffixes)).alias("s"))
    tried = hosts.select("host", "path", "s", F.explode(F.array_compact(prefixes)).alias("p"))
    # The length of the host part keeps ("ab", "c") and ("a", "bc") apart.
    digest = lambda h, p: F.sha2(F.concat(F.length(h).cast("string"), F.lit(":"), h, p), 256)
    tried = tried.select("host", "path", digest(F.col("s"), F.col("p")).alias("full")).withColumn("short", F.substring("full", 1, PREFIX))
    ruled = rules.select(F.concat("host", "path").alias("rule"), "verdict", digest(F.col("host"), F.col("path")).alias("r_full"))
    ruled = ruled.withColumn("short", F.substring("r_full", 1, PREFIX))
    hits = tried.join(ruled, "short").where("full = r_full")
    order = F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), F.col("rule"), F.col("verdict"))
    best = hits.groupBy("host", "path").agg(F.max(order).alias("best"))
    best = best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "best.rule", "best.verdict")
    # Written, so that both sides have a plain exchange and Spark can split the join of a url that many rows share.
    best = cut(best, "url-best")
    both = urls.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left")
    return both.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rules_frame(spark))


def _sql() -> str:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH r(rh, rp, rv) AS (VALUES {rows}),
u AS (SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT u.rid, r.rh || r.rp AS rule, r.rv, row_number() OVER (PARTITION BY u.rid ORDER BY length(r.rh || r.rp) DESC, r.rv DESC, r.rh || r.rp DESC) AS k
      FROM u JOIN r ON (u.host = r.rh OR ends_with(u.host, '.' || r.rh)) AND starts_with(u.path, r.rp))
SELECT u.page_id, u.host, u.path, h.rule, coalesce(h.rv, '{DEFAULT}') AS verdict FROM u LEFT JOIN h ON u.rid = h.rid AND h.k = 1
"""


SQL = _sql()
