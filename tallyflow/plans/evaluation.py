"""Queries over ranking, serving, evaluation, models, generators and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyflow.functions import scalars
from tallyflow.functions.tables import cut, load, shared_dir
from tallyflow.operators import features, generate, metrics, models, serving
from tallyflow.plans.base import PAYMENTS, SCORES, events, payments, query, r6, scores
from tallyflow.plans.records import RAW, _order_rules, _raw_orders, order_records
from tallyflow.sources.records import split
from tallyflow.streaming import streams

# ---------------------------------------------------------------- evaluation

CURVE = f"""{SCORES}, pp AS (SELECT p, sum(y) AS a, sum(1 - y) AS b FROM sc GROUP BY p),
cv AS (SELECT p, a, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER () AS pos, sum(b) OVER () AS neg FROM pp WINDOW w AS (ORDER BY p DESC))"""


@query("a20_brier", f"WITH {SCORES} SELECT round(avg(pow(p - y, 2)), 6) AS brier FROM sc")
def a20_brier(spark, d):
    return metrics.brier(scores(spark, d)).select(r6("brier").alias("brier"))


_ECE = """, b AS (SELECT {bin} AS bin, count(*) AS n, avg(p) AS mp, avg(y::DOUBLE) AS my FROM sc GROUP BY 1) SELECT round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM b"""


@query("a21_ece_right_closed", f"WITH {SCORES}" + _ECE.format(bin="greatest(ceil(p * 10), 1)"))
def a21_ece_right_closed(spark, d):
    return metrics.calibration_error(scores(spark, d)).select(r6("ece").alias("ece"))


@query("a22_ece_left_closed", f"WITH {SCORES}" + _ECE.format(bin="least(floor(p * 10), 9)"))
def a22_ece_left_closed(spark, d):
    return metrics.calibration_error(scores(spark, d), right_closed=False).select(r6("ece").alias("ece"))


@query("a23_average_precision", f"WITH {CURVE} SELECT round(sum(a / pos * tp / (tp + fp)), 6) AS average_precision FROM cv")
def a23_average_precision(spark, d):
    return metrics.average_precision(scores(spark, d)).select(r6("average_precision").alias("average_precision"))


@query(
    "a24_fpr_at_tpr",
    f"""WITH {CURVE}, r AS (SELECT tp / pos AS tpr, fp / neg AS fpr FROM cv), x AS (SELECT coalesce(max(tpr), 0) AS t0 FROM r WHERE tpr < 0.9), f0 AS (SELECT coalesce(max(fpr), 0) AS f0 FROM r, x WHERE tpr = t0),
    z AS (SELECT min(tpr) AS t1 FROM r WHERE tpr >= 0.9), f1 AS (SELECT min(fpr) AS f1 FROM r, z WHERE tpr = t1) SELECT round(f0 + (f1 - f0) * (0.9 - t0) / (t1 - t0), 6) AS fpr FROM x, f0, z, f1""",
)
def a24_fpr_at_tpr(spark, d):
    return metrics.fpr_at_tpr(scores(spark, d)).select(r6("fpr").alias("fpr"))


@query(
    "a25_stress",
    f"WITH {SCORES}, t AS (SELECT quantile_cont(p, 0.95) AS threshold FROM sc WHERE y = 0) SELECT round(threshold, 6) AS threshold, round(avg((p > threshold)::INT::DOUBLE) FILTER (y = 1), 6) AS detection, round(avg((p > threshold)::INT::DOUBLE) FILTER (y = 0), 6) AS false_alarms FROM sc, t GROUP BY threshold",
)
def a25_stress(spark, d):
    return metrics.stress(scores(spark, d)).select(*[r6(c).alias(c) for c in ("threshold", "detection", "false_alarms")])


@query(
    "a26_ks",
    """WITH v AS (SELECT round(value, 3) AS v, (event_type = 'click')::INT AS g FROM events), n AS (SELECT v, count(*) FILTER (g = 0) AS a, count(*) FILTER (g = 1) AS b FROM v GROUP BY v),
    c AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb FROM n) SELECT round(max(abs(fa - fb)), 6) AS ks FROM c""",
)
def a26_ks(spark, d):
    e = events(spark, d).select(F.round("value", 3).alias("v"), (F.col("event_type") == "click").cast("int").alias("g"))
    return metrics.ks_statistic(e, "v", "g").select(r6("ks").alias("ks"))


@query(
    "a27_correlation_distance",
    """WITH a AS (SELECT * FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT * FROM lineitem WHERE l_returnflag <> 'R'),
    x AS (SELECT corr(l_quantity, l_extendedprice) AS p, corr(l_quantity, l_discount) AS q, corr(l_extendedprice, l_discount) AS r FROM a), y AS (SELECT corr(l_quantity, l_extendedprice) AS p, corr(l_quantity, l_discount) AS q, corr(l_extendedprice, l_discount) AS r FROM b)
    SELECT round((abs(x.p - y.p) + abs(x.q - y.q) + abs(x.r - y.r)) / 3, 6) AS distance FROM x, y""",
)
def a27_correlation_distance(spark, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    li = load(spark, d, "lineitem").select("l_returnflag", *[F.col(c).cast("double").alias(c) for c in cols])
    return metrics.correlation_distance(li.where("l_returnflag = 'R'"), li.where("l_returnflag <> 'R'"), cols).select(r6("distance").alias("distance"))


@query(
    "a30_nearest_two",
    """WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    d AS (SELECT q.vec_id, list_distance(q.e, b.e) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, b.e)) AS k FROM q JOIN b ON q.vec_id <> b.vec_id)
    SELECT vec_id, round(min(d) FILTER (k = 1), 4) AS dcr, round(min(d) FILTER (k = 1) / min(d) FILTER (k = 2), 4) AS nndr FROM d WHERE k <= 2 GROUP BY vec_id""",
)
def a30_nearest_two(spark, d):
    """For every vector whose id is divisible by 100, distance to the closest other and its ratio to the second."""
    v = load(spark, d, "embeddings")
    n = metrics.nearest_two(v.where("vec_id % 100 = 0"), v, "embedding", "vec_id", "vec_id", same=True)
    return n.select("vec_id", r6("d1", 4).alias("dcr"), r6(F.try_divide("d1", "d2"), 4).alias("nndr"))  # none where both are 0


@query("a29_l1_distance", "WITH x AS (SELECT count(*) AS n, avg(s_acctbal) AS m FROM supplier), y AS (SELECT count(*) AS n, avg(c_acctbal) AS m FROM customer) SELECT round(abs(x.n - y.n) + abs(x.m - y.m), 4) AS distance FROM x, y")
def a29_l1_distance(spark, d):
    a = load(spark, d, "supplier").agg(F.count(F.lit(1)).alias("n"), F.avg("s_acctbal").alias("m"))
    b = load(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("m"))
    return metrics.l1_distance(a, b, ["n", "m"]).select(r6("distance", 4).alias("distance"))


@query("a16_group_statistics", "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS sd, count(*) AS n FROM lineitem GROUP BY 1")
def a16_group_statistics(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(F.avg("l_extendedprice"), 4).alias("mean"), r6(F.stddev_pop("l_extendedprice"), 4).alias("sd"), F.count(F.lit(1)).alias("n"))


@query("a19_label_histogram", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def a19_label_histogram(spark, d):
    load(spark, d, "orders").createOrReplaceTempView("tallyflow_orders")
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM tallyflow_orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@query("a17_lognormal_fit", "SELECT o_orderstatus, round(avg(ln(o_totalprice)), 6) AS mu, round(stddev_pop(ln(o_totalprice)), 6) AS sigma FROM orders WHERE o_totalprice > 0 GROUP BY 1")
def a17_lognormal_fit(spark, d):
    return metrics.fit_lognormal(load(spark, d, "orders"), "o_totalprice", ["o_orderstatus"]).select("o_orderstatus", r6("mu").alias("mu"), r6("sigma").alias("sigma"))


@query(
    "a18_rate_fit",
    "WITH g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events) SELECT round(1 / quantile_cont(gap, 0.5), 9) AS rate FROM g WHERE gap > 0",
)
def a18_rate_fit(spark, d):
    return metrics.fit_rate(events(spark, d), "user_id", "ts", "event_id").select(r6("rate", 9).alias("rate"))


@query(
    "w6_temporal_split",
    f"WITH {SCORES} SELECT id, CASE WHEN row_number() OVER (ORDER BY ts, id) <= floor(count(*) OVER () * 0.7) THEN 'train' ELSE 'test' END AS part FROM sc",
)
def w6_temporal_split(spark, d):
    return metrics.temporal_split(scores(spark, d).select("id", "ts"), "ts", "id").select("id", "part")


@query(
    "m8_community_disjoint_split",
    f"""WITH {SCORES}, s AS (SELECT id, l_suppkey, CASE WHEN row_number() OVER (ORDER BY ts, id) <= floor(count(*) OVER () * 0.7) THEN 'train' ELSE 'test' END AS part FROM sc),
    c AS (SELECT DISTINCT s_nationkey AS community FROM supplier), r AS (SELECT community, row_number() OVER (ORDER BY community) > floor(count(*) OVER () * 0.7) AS test FROM c)
    SELECT id, CASE WHEN r.test IS NULL THEN part WHEN r.test THEN 'test' ELSE 'train' END AS part FROM s LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN r ON s_nationkey = community""",
)
def m8_community_disjoint_split(spark, d):
    s = metrics.temporal_split(scores(spark, d).select("id", "ts", "l_suppkey"), "ts", "id")
    m = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("community"))
    return metrics.community_disjoint(s, m, "l_suppkey").select("id", "part")


@query("m7_stratified_sizes", f"WITH {SCORES}, n AS (SELECT y, count(*) AS n FROM sc GROUP BY y) SELECT y, 'train' AS part, floor(n * 0.7)::BIGINT AS n FROM n UNION ALL SELECT y, 'test', n - floor(n * 0.7)::BIGINT FROM n")
def m7_stratified_sizes(spark, d):
    return metrics.stratified_split(scores(spark, d).select("id", "y"), "y", "id").groupBy("y", "part").agg(F.count(F.lit(1)).alias("n"))


@query("m9_random_split_sizes", f"WITH {SCORES} SELECT 'train' AS part, floor(count(*) * 0.7)::BIGINT AS n FROM sc UNION ALL SELECT 'test', count(*) - floor(count(*) * 0.7)::BIGINT FROM sc")
def m9_random_split_sizes(spark, d):
    return metrics.random_split(scores(spark, d).select("id"), "id").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("k9_pseudo_labels", f"WITH {SCORES} SELECT id, (row_number() OVER (ORDER BY p DESC, id) <= floor(count(*) OVER () * 0.02))::INT AS y FROM sc")
def k9_pseudo_labels(spark, d):
    return models.pseudo_labels(scores(spark, d).select("id", "p"), "p", "id").select("id", "y")


# ---------------------------------------------------------------- ranking and serving


@query("w1_ranked_alerts", f"WITH {SCORES} SELECT id, row_number() OVER (ORDER BY p DESC, id) AS rank, p, CASE WHEN p > 0.90 THEN 'critical' WHEN p > 0.75 THEN 'high' WHEN p > 0.50 THEN 'medium' ELSE 'low' END AS tier FROM sc")
def w1_ranked_alerts(spark, d):
    r = serving.ranked(scores(spark, d).select("id", "p"), "p", "id")
    return r.select("id", F.col("rank").cast("bigint").alias("rank"), "p", scalars.tier(F.col("p")).alias("tier"))


@query(
    "v3_alerts_page",
    f"""WITH {SCORES}, r AS (SELECT id, p, l_suppkey, row_number() OVER (ORDER BY p DESC, id) AS rank FROM sc) SELECT id, rank, p FROM r WHERE p > 0.75 AND p <= 0.90 AND contains(lower('Supplier#' || l_suppkey), '#1') ORDER BY rank LIMIT 50 OFFSET 50""",
)
def v3_alerts_page(spark, d):
    """The second page of the high tier for a search."""
    r = serving.ranked(scores(spark, d).select("id", "p", F.concat(F.lit("Supplier#"), "l_suppkey").alias("wallet")), "p", "id")
    r = r.withColumn("tier", scalars.tier(F.col("p"))).withColumn("rank", F.col("rank").cast("bigint"))
    some, _ = serving.alerts(r, tier="high", q="#1", columns=["wallet"], limit=50, offset=50)
    return some.select("id", "rank", "p")


@query("f4_replay", "SELECT event_id, user_id, ts FROM events WHERE ts <= (SELECT min(ts) + INTERVAL 5 DAY FROM events) ORDER BY ts, event_id LIMIT 1000")
def f4_replay(spark, d):
    """The first 1000 events as of five days in."""
    e = events(spark, d)
    at = e.agg((F.min("ts") + F.expr("INTERVAL 5 DAYS")).alias("at")).first()[0]
    return serving.replay(e, "ts", "event_id", F.lit(at).cast("timestamp_ntz")).select("event_id", "user_id", "ts")


@query(
    "v1_burst_histogram",
    """WITH g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events)
    SELECT user_id, CASE WHEN gap < 300 THEN '0-5m' WHEN gap < 600 THEN '5-10m' WHEN gap < 1800 THEN '10-30m' WHEN gap < 3600 THEN '30-60m' ELSE '60m+' END AS bucket, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL""",
)
def v1_burst_histogram(spark, d):
    return serving.burst_histogram(events(spark, d), "user_id", "ts", "event_id")


@query(
    "v1_evidence",
    f"""WITH {PAYMENTS}, f AS (SELECT wallet, k, v FROM (SELECT wallet, avg(amount)::DOUBLE AS mean_amount, max(len(outputs))::DOUBLE AS most_outputs, max(fee)::DOUBLE AS top_fee, count(*)::DOUBLE AS n FROM pay GROUP BY wallet) UNPIVOT (v FOR k IN (mean_amount, most_outputs, top_fee, n))),
    r AS (SELECT wallet, k, round(v, 4) AS v, row_number() OVER (PARTITION BY wallet ORDER BY v DESC, k) AS rank FROM f),
    top AS (SELECT wallet, string_agg(k, ',' ORDER BY rank) FILTER (rank <= 3) AS top, count(*)::INT AS n_values, round(sum(v), 2) AS sum_values FROM r GROUP BY wallet)
    SELECT wallet, count(*) AS n_records, min(ts) AS first_seen, max(ts) AS last_seen, round(sum(amount), 2) AS total_amount, any_value(top) AS top, any_value(n_values) AS n_values, any_value(sum_values) AS sum_values,
      count(*)::INT AS n_flow, round(arg_max(amount, (ts, amount)), 2) AS last_amount FROM pay JOIN top USING (wallet) GROUP BY wallet""",
)
def v1_evidence(spark, d):
    """A bundle for each wallet: its four figures as attribution, the top three of them, its flow and its sums."""
    p = payments(spark, d).withColumnRenamed("ts", "timestamp")
    figures = p.groupBy("wallet").agg(F.avg(F.col("amount").cast("double")).alias("mean_amount"), F.max(F.size("outputs")).cast("double").alias("most_outputs"), F.max(F.col("fee").cast("double")).alias("top_fee"), F.count(F.lit(1)).cast("double").alias("n"))
    pairs = F.array_sort(F.array(*[F.struct((-F.col(c)).alias("v"), F.lit(c).alias("feature")) for c in ("mean_amount", "most_outputs", "top_fee", "n")]))
    table = figures.select("wallet", F.posexplode(pairs).alias("at", "e")).select("wallet", (F.col("at") + 1).alias("rank"), "e.feature", (-F.col("e.v")).alias("value"))
    out = serving.evidence(p.select("wallet").distinct(), table, p, key="wallet")
    values = F.aggregate(F.map_values("values"), F.lit(0.0), lambda s, x: s + x)
    return out.select(
        "wallet", "n_records", "first_seen", "last_seen", r6("total_amount", 2).alias("total_amount"), F.array_join("top.feature", ",").alias("top"), F.size("values").alias("n_values"), r6(values, 2).alias("sum_values"),
        F.size("amount_flow").alias("n_flow"), r6(F.element_at("amount_flow", -1)["amount"], 2).alias("last_amount"),
    )


@query(
    "w8_top_attribution",
    """WITH f AS (SELECT s_suppkey AS k, [{'f': 'balance', 'v': s_acctbal / 1000}, {'f': 'nation', 'v': s_nationkey::DOUBLE - 12}, {'f': 'key', 'v': (s_suppkey % 10)::DOUBLE}, {'f': 'region', 'v': (s_nationkey % 5)::DOUBLE}] AS l FROM supplier),
    u AS (SELECT k, unnest(l) AS x FROM f), r AS (SELECT k, x.f AS feature, x.v AS value, row_number() OVER (PARTITION BY k ORDER BY abs(x.v) DESC, x.f) AS rank FROM u) SELECT k, rank::INT AS rank, feature, round(value, 6) AS value FROM r WHERE rank <= 3""",
)
def w8_top_attribution(spark, d):
    s = load(spark, d, "supplier").withColumnRenamed("s_suppkey", "k")
    v = {"balance": F.col("s_acctbal") / 1000, "nation": F.col("s_nationkey").cast("double") - 12, "key": (F.col("k") % 10).cast("double"), "region": (F.col("s_nationkey") % 5).cast("double")}
    return serving.top_absolute(s, "k", v).select("k", "rank", "feature", r6("value").alias("value"))


@query("f12_text_search", "SELECT c_custkey FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'auto')")
def f12_text_search(spark, d):
    return serving.search(load(spark, d, "customer"), "AUTO", ["c_name", "c_mktsegment"]).select("c_custkey")


@query(
    "f6_validation_report",
    f"""WITH {RAW}, e AS (SELECT id, concat_ws('; ', CASE WHEN e1 THEN 'port: out of range' END, CASE WHEN e2 THEN 'fee: not a float' END, CASE WHEN e3 THEN 'script: unknown name' END) AS error FROM raw WHERE e1 OR e2 OR e3)
    SELECT id AS row, error FROM e WHERE id % 3 <> 2""",
)
def f6_validation_report(spark, d):
    """The quarantined rows of the files that a report on batch.csv covers: by their last part or a piece of their path."""
    k = F.col("id")
    file = F.when(k % 3 == 0, "/in/a/batch.csv").when(k % 3 == 1, "/in/batch.csv.d/b.csv").otherwise("/in/c.csv")
    _, bad = split(_raw_orders(spark, d).withColumn("_file", file).withColumn("_row", k), _order_rules())
    return serving.validation_report(bad, "batch.csv").select("row", "error")


@query("f13_of_wallet", f"WITH {PAYMENTS} SELECT txid FROM pay WHERE wallet = (SELECT min(wallet) FROM pay) OR list_contains(outputs, (SELECT min(wallet) FROM pay))")
def f13_of_wallet(spark, d):
    """Orders whose customer or one of whose suppliers has the number of the first customer with an order."""
    p = payments(spark, d).select("txid", F.array(F.col("wallet").cast("string")).alias("input_addresses"), F.transform("outputs", lambda x: x.cast("string")).alias("output_addresses"), "wallet")
    return serving.of_wallet(p, str(p.agg(F.min("wallet")).first()[0])).select("txid")


# ---------------------------------------------------------------- generators


LABELLED = """('0x' || substr(sha256('42|' || {k}), 1, 13))::UBIGINT::BIGINT / 4503599627370496::DOUBLE AS u"""
LABEL = f"CASE WHEN u < 0.04 THEN {[k for k in generate.PATTERNS if k != 'normal']}[floor(u / 0.04::DOUBLE * 8)::INT + 1] ELSE 'normal' END"
#: Orders with their planted labels and how many inputs and outputs their records have.
PLANTED = f"""h AS (SELECT o_orderkey AS k, {LABELLED.format(k='o_orderkey')} FROM orders), lb AS (SELECT k, {LABEL} AS label FROM h),
    pt(label, i0, i1, o0, o1) AS (VALUES {", ".join(f"('{n}', {v[2][0]}, {v[2][1]}, {v[3][0]}, {v[3][1]})" for n, v in generate.PATTERNS.items())}),
    dr AS (SELECT k, label, (i0 + ('0x' || substr(sha256('42|' || k || '|n_in'), 1, 8))::UBIGINT::BIGINT % (i1 - i0 + 1))::BIGINT AS a, (o0 + ('0x' || substr(sha256('42|' || k || '|n_out'), 1, 8))::UBIGINT::BIGINT % (o1 - o0 + 1))::BIGINT AS b,
      label = 'mixer' AND ('0x' || substr(sha256('42|' || k || '|side'), 1, 13))::UBIGINT::BIGINT / 4503599627370496::DOUBLE >= 0.5 AS turned FROM lb JOIN pt USING (label)),
    sz AS (SELECT k, label, CASE WHEN turned THEN b ELSE a END AS n_in, CASE WHEN turned THEN a ELSE b END AS n_out FROM dr)"""


def _amount_checks(rows):
    """By label: how many rows, inputs and outputs, and how many rows break each rule of amounts."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    gap = F.abs(total("input_amounts") - total("output_amounts") - F.col("fee"))
    bad = lambda c: F.count(F.when(c, 1))
    sizes = [F.sum(F.size(f"{c}_amounts")).cast("bigint").alias(f"{c}s") for c in ("input", "output")]
    return [F.count(F.lit(1)).alias("n"), *sizes, bad(gap > 1e-7).alias("unbalanced"), bad(F.col("fee") > 0.2 * total("input_amounts") + 1e-7).alias("fee_too_high"), bad((F.array_min("output_amounts") <= 0) | (F.array_min("input_amounts") <= 0)).alias("not_positive")]


CHECKED = f"WITH {PLANTED} SELECT label, count(*) AS n, sum(n_in)::BIGINT AS inputs, sum(n_out)::BIGINT AS outputs, 0::BIGINT AS unbalanced, 0::BIGINT AS fee_too_high, 0::BIGINT AS not_positive{{more}} FROM sz GROUP BY label"


@query("n3_conservation", CHECKED.format(more=", 0::BIGINT AS out_of_bounds"))
def n3_conservation(spark, d):
    """Log-normal amounts for every order by its planted label: lists' sizes, and rows that break the rules of amounts."""
    plan = generate.injection_plan(load(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    r = generate.with_amounts(plan, "label", F.lit(42), F.col("o_orderkey"))
    outside = F.exists("input_amounts", lambda x: (x < generate.LEAST) | (x > generate.MOST))
    return r.groupBy("label").agg(*_amount_checks(r), F.count(F.when(outside, 1)).alias("out_of_bounds"))


@query("n2_uniform_amounts", CHECKED.format(more=", 0::BIGINT AS out_of_bounds"))
def n2_uniform_amounts(spark, d):
    """Even amounts for every order by its planted label: the same, and inputs outside the label's bounds."""
    plan = generate.injection_plan(load(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    r = generate.with_amounts(plan, "label", F.lit(42), F.col("o_orderkey"), even=True)
    low, high = (F.create_map(*[F.lit(x) for n, v in generate.PATTERNS.items() for x in (n, v[1][k])])[F.col("label")] for k in (0, 1))
    outside = F.exists("input_amounts", lambda x: (x < low - 1e-6) | (x > high + 1e-6))
    return r.groupBy("label").agg(*_amount_checks(r), F.count(F.when(outside, 1)).alias("out_of_bounds"))


@query("n7_address_pools", "SELECT n_nationkey AS community, least(800, greatest(20, count(c_custkey)))::BIGINT AS n, 20::BIGINT AS countries FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def n7_address_pools(spark, d):
    """The sizes of the nations' pools, and the countries in each."""
    c = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("community")).agg(F.count(F.lit(1)).alias("n"))
    return generate.address_pools(c).groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("country").alias("countries"))


@query(
    "n1_generated_records",
    f"""WITH {PLANTED} SELECT sha256('42|tx|' || k) AS txid, label, n_in, n_out, (8333 + ('0x' || substr(sha256('42|src_port|' || k), 1, 8))::UBIGINT::BIGINT % 10001)::INT AS src_port,
    (1000 + ('0x' || substr(sha256('42|asn|' || k), 1, 8))::UBIGINT::BIGINT % 499001)::BIGINT AS geo_asn FROM sz""",
)
def n1_generated_records(spark, d):
    """A generated record for every order."""
    r = generate.records_for(load(spark, d, "orders"), "o_orderkey")
    return r.select("txid", "label", F.size("input_amounts").cast("bigint").alias("n_in"), F.size("output_addresses").cast("bigint").alias("n_out"), "src_port", "geo_asn")


@query(
    "n8_injection_plan",
    f"""WITH h AS (SELECT o_orderkey, ('0x' || substr(sha256('42|' || o_orderkey), 1, 13))::UBIGINT::BIGINT / 4503599627370496::DOUBLE AS u FROM orders)
    SELECT o_orderkey, {LABEL} AS label FROM h""",
)
def n8_injection_plan(spark, d):
    return generate.injection_plan(load(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "label")


@query(
    "n9_chain_edges",
    f"""WITH h AS (SELECT o_orderkey AS id, {LABELLED.format(k='o_orderkey')}, lead(o_orderkey) OVER w AS one, lead(o_orderkey, 2) OVER w AS two FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
    SELECT id AS src, one AS dst FROM h WHERE one IS NOT NULL UNION ALL SELECT id, two FROM h WHERE two IS NOT NULL AND u < 0.12""",
)
def n9_chain_edges(spark, d):
    """Each customer's orders as a chain, with its skip edges."""
    n = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("step"))
    return generate.chain_edges(n).select("src", "dst")


# ---------------------------------------------------------------- models

_MODEL_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark, d):
    li = load(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), *[F.col(c).cast("double").alias(c) for c in _MODEL_COLUMNS])


@query("m1_isolation_forest")
def m1_isolation_forest(spark, d):
    li = _lines(spark, d)
    return models.fit_forest(li, _MODEL_COLUMNS, "id").transform(li).select("id", r6("anomaly").alias("anomaly"))


@query("m13_forest_attribution")
def m13_forest_attribution(spark, d):
    """The three features of all 38 that make each order odd or plain, by Shapley value."""
    table = cut(features.features(order_records(spark, d)), "features")
    return models.fit_forest(table, list(features.FEATURES), "txid").attribute(table, "txid", 3).select("txid", "rank", "feature", r6("value").alias("value"))


@query("m2_local_outlier_factor")
def m2_local_outlier_factor(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return models.local_outlier_factor(c, ["balance", "nation"], "id").select("id", r6("lof").alias("lof"))


@query("m5_platt")
def m5_platt(spark, d):
    s = metrics.stratified_split(scores(spark, d).select("id", "p", "y"), "y", "id")
    return models.platt(s.where("part = 'train'"))(s).select("id", "part", r6("calibrated").alias("calibrated"))


@query("m5_isotonic")
def m5_isotonic(spark, d):
    s = metrics.stratified_split(scores(spark, d).select("id", "p", "y"), "y", "id")
    return models.isotonic(s.where("part = 'train'"))(s).select("id", "part", r6("calibrated").alias("calibrated"))


@query("m12_sigma_sweep")
def m12_sigma_sweep(spark, d):
    """Average precision of the later part under time jitter of three widths."""
    sigmas, out = (5.0, 30.0, 120.0), None
    base = scores(spark, d).select("id", "p", "y", *[generate.jittered(F.col("ts").cast("timestamp"), s * 86400, F.col("id"), F.lit(s)).alias(f"ts{i}") for i, s in enumerate(sigmas)])
    base = cut(base, "jittered")  # all widths at once
    for i, sigma in enumerate(sigmas):
        late = metrics.late_part(base.select("id", "p", "y", F.col(f"ts{i}").alias("ts")), "ts", "id")
        one = metrics.average_precision(late).select(F.lit(sigma).alias("sigma"), r6("average_precision").alias("average_precision"))
        out = one if out is None else out.unionByName(one)
    return out


@query("m12_sigma_decision")
def m12_sigma_decision(spark, d):
    """The largest difference of the sweep, and whether jitter is to be dropped for it."""
    return metrics.sweep_decision(m12_sigma_sweep(spark, d), "sigma", "average_precision").select("n", r6("largest_difference").alias("largest_difference"), "drop")


# ---------------------------------------------------------------- streams


def _streamed(spark, d, build, mode="complete"):
    schema = events(spark, d).schema
    s = streams.table_stream(spark, d, "events", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    streams.run_to_table(build(s), f"{out}/data", f"{out}/checkpoint", mode)
    return spark.read.parquet(f"{out}/data")


@query("t_stream_tumbling_5m", "SELECT event_type, epoch_us(time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01')) AS start_micros, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t_stream_tumbling_5m(spark, d):
    w = _streamed(spark, d, lambda s: streams.tumbling(s, "ts", "5 minutes", ["event_type"]))
    return w.select("event_type", F.unix_micros("window.start").alias("start_micros"), "n", r6("total", 4).alias("total"))


@query(
    "t_stream_sessions_1h",
    """WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 3600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, t, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(t) AS start_micros, count(*) AS n FROM s GROUP BY user_id, k""",
)
def t_stream_sessions_1h(spark, d):
    w = _streamed(spark, d, lambda s: streams.sessions(s, "ts", "1 hour", "user_id"))
    return w.select("user_id", F.unix_micros("session_window.start").alias("start_micros"), "n")


@query("t_stream_dedup", "SELECT count(DISTINCT event_id) AS n FROM events")
def t_stream_dedup(spark, d):
    w = _streamed(spark, d, lambda s: streams.deduplicated(s, "event_id", "ts").select("event_id"), "append")
    return w.agg(F.count(F.lit(1)).alias("n"))
