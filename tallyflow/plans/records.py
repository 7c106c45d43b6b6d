"""Queries over ingest, validation, geography, features and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.functions import aggregates, scalars
from tallyflow.functions.tables import cut, load, scratch
from tallyflow.operators import features, geo, iterative, metrics
from tallyflow.plans.base import NATIONS, PAYMENTS, betweenness_sql, events, nation_edges, payments, query, r6, wallet_edges
from tallyflow.sources import files
from tallyflow.sources.records import Rule, checked, contract_projection, schema_difference

# ---------------------------------------------------------------- files


@query("s4_json_arrays", """SELECT o_orderkey::VARCHAR AS txid, o_orderstatus || '}{"\\' || o_orderpriority AS script_type FROM orders""")
def s4_json_arrays(spark, d):
    """Orders to files of one JSON array each, with braces, quotes and backslashes in their strings, and back by blocks."""
    made = load(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("txid"), F.concat("o_orderstatus", F.lit('}{"\\'), "o_orderpriority").alias("script_type"))
    files.write_json_arrays(made, path := scratch(spark, "json-arrays"))
    return files.read_json(spark, path).select("txid", "script_type")


# ---------------------------------------------------------------- validation


def _raw_orders(spark, d):
    """Orders as raw text with faults: keys past the port range, totals without a point, other states."""
    o = load(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("port"), F.when(F.col("o_orderkey") % 7 == 0, F.floor("o_totalprice").cast("bigint").cast("string")).otherwise(F.format_string("%.2f", "o_totalprice")).alias("fee"),
        F.col("o_orderstatus").alias("script"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("txid"), F.col("o_orderkey").alias("id"),
    )


def _order_rules():
    port = scalars.coerce_integer(F.col("port"))
    fee = scalars.coerce_float(F.col("fee"))
    return [
        Rule("port", port, port.between(0, 50000), "port: out of range"), Rule("fee", fee, fee.isNotNull(), "fee: not a float"),
        Rule("script", F.col("script"), F.col("script").isin("F", "O"), "script: unknown name"), Rule("txid", F.col("txid"), F.col("txid").rlike("^[a-f0-9]{64}$"), "txid: not 64 hex digits"),
    ]


RAW = """raw AS (SELECT o_orderkey AS id, o_orderkey > 50000 AS e1, o_orderkey % 7 = 0 AS e2, o_orderstatus NOT IN ('F', 'O') AS e3 FROM orders)"""


@query("f1_validate_split", f"WITH {RAW} SELECT id, (e1::INT + e2::INT + e3::INT)::INT AS n_errors, NOT (e1 OR e2 OR e3) AS clean FROM raw")
def f1_validate_split(spark, d):
    m = checked(_raw_orders(spark, d), _order_rules())
    return m.select("id", F.size("errors").alias("n_errors"), (F.size("errors") == 0).alias("clean"))


@query(
    "f1_quarantine_reasons",
    f"""WITH {RAW}, r AS (SELECT unnest([CASE WHEN e1 THEN 'port: out of range' END, CASE WHEN e2 THEN 'fee: not a float' END, CASE WHEN e3 THEN 'script: unknown name' END]) AS reason FROM raw)
    SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason""",
)
def f1_quarantine_reasons(spark, d):
    m = checked(_raw_orders(spark, d), _order_rules())
    return m.select(F.explode("errors").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f2_coerce_numeric",
    r"""WITH t AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'x' || event_id WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE printf('%.3f', value) END AS s FROM events)
    SELECT event_id, CASE WHEN regexp_matches(s, '^[0-9]+$') THEN s::BIGINT END AS whole, CASE WHEN regexp_matches(s, '[.eE]') THEN round(try_cast(s AS DOUBLE), 3) END AS real FROM t""",
)
def f2_coerce_numeric(spark, d):
    s = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), "event_id")).when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.format_string("%.3f", "value"))
    t = events(spark, d).select("event_id", s.alias("s"))
    return t.select("event_id", scalars.coerce_integer(F.col("s")).alias("whole"), r6(scalars.coerce_float(F.col("s")), 3).alias("real"))


@query("x6_json_fields", "SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def x6_json_fields(spark, d):
    p = F.from_json("props", "k bigint")
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(p["k"]).alias("total"))


@query("x6_json_lists", f"WITH {PAYMENTS} SELECT txid, len(amounts)::INT AS n, round(list_sum(amounts), 2) AS total FROM pay")
def x6_json_lists(spark, d):
    """Lists through JSON text and back."""
    p = payments(spark, d).select("txid", F.to_json("amounts").alias("t"))
    a = F.from_json("t", "array<double>")
    return p.select("txid", F.size(a).alias("n"), r6(aggregates.array_sum(a), 2).alias("total"))


@query("f3_contract_projection", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def f3_contract_projection(spark, d):
    return contract_projection(load(spark, d, "customer"), ["c_custkey", "c_name", "c_acctbal", "not_there"])


@query(
    "f5_instants",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts)) - 19800000000 ELSE NULL END AS micros FROM events""",
)
def f5_instants(spark, d):
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(base, F.lit("Z"))).when(F.col("event_id") % 3 == 1, F.concat(base, F.lit("+05:30"))).otherwise(F.lit("not a time"))
    return events(spark, d).select("event_id", F.unix_micros(scalars.parse_instant(text)).alias("micros"))


@query("f7_private_addresses", "SELECT c_custkey, (c_custkey % 256 IN (10, 127) OR (c_custkey % 256 = 192 AND c_nationkey * 8 = 168) OR (c_custkey % 256 = 172 AND c_nationkey * 8 BETWEEN 16 AND 31)) AS private FROM customer")
def f7_private_addresses(spark, d):
    ip = F.concat_ws(".", (F.col("c_custkey") % 256).cast("string"), (F.col("c_nationkey") * 8).cast("string"), F.lit("0"), F.lit("1"))
    return load(spark, d, "customer").select("c_custkey", scalars.private_ip(ip).alias("private"))


@query("s17_schema_difference", "SELECT * FROM (VALUES ('s_suppkey', 'bigint', NULL), ('s_name', 'string', NULL), ('s_nationkey', 'int', NULL), ('s_acctbal', 'double', NULL), ('n_name', NULL, 'string'), ('n_nationkey', NULL, 'int'), ('n_regionkey', NULL, 'int')) v(name, in_a, in_b)")
def s17_schema_difference(spark, d):
    return schema_difference(load(spark, d, "supplier"), load(spark, d, "nation"))


@query("s9_union_by_name", "SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_nationkey, s_acctbal, NULL FROM supplier")
def s9_union_by_name(spark, d):
    c = load(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = load(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


# ---------------------------------------------------------------- geography

LAT, LNG = "((n_nationkey * 37) % 170 - 85)::DOUBLE", "((n_nationkey * 53) % 360 - 180)::DOUBLE"
HAVERSINE = "2 * 6371.0088::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians({b}lat) - radians({a}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin((radians({b}lng) - radians({a}lng)) / 2), 2))))"
PLACES = f"pl AS (SELECT n_nationkey AS k, n_name, n_regionkey AS asn, {LAT} AS lat, {LNG} AS lng FROM nation)"


def _places(spark, d):
    k = F.col("n_nationkey")
    return load(spark, d, "nation").select(k.alias("k"), "n_name", F.col("n_regionkey").alias("asn"), ((k * 37) % 170 - 85).cast("double").alias("lat"), ((k * 53) % 360 - 180).cast("double").alias("lng"))


@query(
    "x1_haversine_pairs",
    f"WITH {NATIONS}, {PLACES}, p AS (SELECT DISTINCT src, dst FROM ne) SELECT src, dst, round({HAVERSINE.format(a='a.', b='b.')}, 3) AS km, coalesce(a.asn <> b.asn, false) OR {HAVERSINE.format(a='a.', b='b.')} > 1000 AS inconsistent FROM p JOIN pl a ON src = a.k JOIN pl b ON dst = b.k",
)
def x1_haversine_pairs(spark, d):
    """Distance and inconsistency of each pair of trading nations."""
    p = _places(spark, d)
    a = p.select(F.col("k").alias("src"), F.col("asn").alias("a_asn"), F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"))
    b = p.select(F.col("k").alias("dst"), F.col("asn").alias("b_asn"), F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"))
    km = scalars.haversine_km(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))
    pairs = nation_edges(spark, d).select("src", "dst").distinct()
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", r6(km, 3).alias("km"), scalars.geo_inconsistent(F.col("a_asn"), F.col("b_asn"), km).alias("inconsistent"))


@query("s25_geo_enrich", "SELECT c_custkey, n_name AS geo_country, n_regionkey AS geo_asn FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def s25_geo_enrich(spark, d):
    p = _places(spark, d)
    cache = p.select(F.col("k").alias("ip"), F.col("n_name").alias("country"), F.lit(None).cast("string").alias("city"), "asn", "lat", "lng", F.lit(100.0).alias("radius"))
    return geo.enrich(load(spark, d, "customer"), cache, "c_nationkey").select("c_custkey", "geo_country", "geo_asn")


@query(
    "s23_cache_upsert",
    "WITH r AS (SELECT user_id AS ip, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS k FROM events) SELECT ip, event_type, ts FROM r WHERE k = 1",
)
def s23_cache_upsert(spark, d):
    """The newest event of each user, after an upsert of the clicks into the rest."""
    e = events(spark, d).select(F.col("user_id").alias("ip"), "event_type", "ts")
    old, new = e.where("event_type <> 'click'"), e.where("event_type = 'click'")
    return geo.upsert(old, new, "ip", "ts").select("ip", "event_type", "ts")


@query("s24_cache_misses", "SELECT count(DISTINCT user_id) AS n_ids, count(DISTINCT user_id) FILTER (user_id % 3 <> 0) AS n_misses FROM events")
def s24_cache_misses(spark, d):
    """Ids of a batch and those that a cache of every third lacks."""
    ids = events(spark, d).select(F.col("user_id").alias("ip")).distinct()
    cache = ids.where("ip % 3 = 0")
    misses = ids.join(cache, "ip", "left_anti")
    return ids.agg(F.count(F.lit(1)).alias("n_ids")).crossJoin(misses.agg(F.count(F.lit(1)).alias("n_misses")))


@query(
    "j9_networks",
    """SELECT c_custkey, CASE WHEN c_custkey % 200 < 100 THEN 'narrow-' || (c_custkey % 4) ELSE 'wide-' || (c_custkey % 4) END AS network FROM customer""",
)
def j9_networks(spark, d):
    """Addresses 10.<k mod 4>.<k mod 200>.1 in a wide network per second octet and a narrow one of its lower hundred."""
    c = F.col("c_custkey")
    ips = load(spark, d, "customer").select("c_custkey", F.concat_ws(".", F.lit("10"), (c % 4).cast("string"), (c % 200).cast("string"), F.lit("1")).alias("ip"))
    nets = [(f"10.{k}.0.0", f"10.{k}.99.255", f"narrow-{k}") for k in range(4)] + [(f"10.{k}.0.0", f"10.{k}.255.255", f"wide-{k}") for k in range(4)]
    networks = spark.createDataFrame(nets, "start string, end string, network string")
    return geo.in_networks(ips, networks).select("c_custkey", "network")


@query(
    "a13_hop_rate",
    f"""WITH {PAYMENTS}, n AS (SELECT txid, wallet, ts, s_nationkey AS asn FROM pay JOIN supplier ON outputs[1] = s_suppkey),
    h AS (SELECT wallet, asn <> lag(asn) OVER w AS hop, row_number() OVER w AS i FROM n WINDOW w AS (PARTITION BY wallet ORDER BY ts, txid))
    SELECT wallet, round(coalesce(avg(coalesce(hop, false)::INT::DOUBLE) FILTER (i > 1), 0), 6) AS hop_rate, count(*) AS n FROM h GROUP BY wallet""",
)
def a13_hop_rate(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("asn"))
    p = payments(spark, d).select("txid", "wallet", "ts", F.get("outputs", F.lit(0)).alias("s_suppkey")).join(s, "s_suppkey")
    return geo.hops(p, "wallet", ["ts", "txid"], "asn").select("wallet", r6("hop_rate").alias("hop_rate"), "n")


# ---------------------------------------------------------------- features


@query(
    "feat_amounts",
    f"""WITH {PAYMENTS}, e AS (SELECT txid, fee, len(outputs) AS n_out, len(list_distinct(outputs)) AS n_in, amounts, list_sort(amounts) AS so, list_sum(amounts) AS total, list_max(amounts) AS hi, list_min(amounts) AS lo, list_sort(list_concat(amounts, [amount])) AS al FROM pay),
    v AS (SELECT *, list_sum(list_transform(amounts, lambda x: pow(x - total / n_out, 2))) / n_out AS var, list_sum(list_transform(so, lambda x, i: i * x)) AS ranked FROM e)
    SELECT txid, n_in::DOUBLE AS fan_in, n_out::DOUBLE AS fan_out, round(CASE WHEN n_out < 2 THEN 0 ELSE var END, 2) AS output_amount_variance, round(fee * 1e8 / 250, 2) AS fee_sat_per_vb,
    round(CASE WHEN n_out <= 1 OR total = 0 THEN 0 ELSE 2 * ranked / (n_out * total) - (n_out + 1) / n_out END, 6) AS output_dispersion_gini,
    CASE WHEN n_in = 1 AND n_out = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS peel_depth, CASE WHEN n_out = 2 AND hi > 0 AND (hi - lo) / hi > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS change_addr_likelihood,
    len(list_filter(amounts, lambda x: x < 0.00005))::DOUBLE AS dust_outputs, round((al[(len(al) + 1) // 2] + al[len(al) // 2 + 1]) / 2, 4) AS value_median FROM v""",
)
def feat_amounts(spark, d):
    p = payments(spark, d)
    f = features.amount_features(F.col("amounts"), F.array("amount"), F.size(F.array_distinct("outputs")), F.size("outputs"), F.col("fee"))
    digits = {"output_amount_variance": 2, "fee_sat_per_vb": 2, "value_median": 4}
    names = ["fan_in", "fan_out", "output_amount_variance", "fee_sat_per_vb", "output_dispersion_gini", "peel_depth", "change_addr_likelihood", "dust_outputs", "value_median"]
    return p.select("txid", *[r6(f[n], digits.get(n, 6)).alias(n) for n in names])


@query(
    "feat_bursts",
    """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events)
    SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 300000000 PRECEDING AND 300000000 FOLLOWING) AS burst_5m,
    count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND 3600000000 FOLLOWING) AS burst_1h FROM e""",
)
def feat_bursts(spark, d):
    e = features.burst_counts(events(spark, d).select("event_id", "user_id", "ts"), "user_id", "ts", {"burst_5m": 300, "burst_1h": 3600})
    return e.select("event_id", "burst_5m", "burst_1h")


@query(
    "feat_intervals",
    """WITH g AS (SELECT user_id, epoch_us(ts) AS t, abs((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, count(*) AS n, round(CASE WHEN count(gap) < 2 THEN 0 ELSE stddev_pop(gap) END, 3) AS interval_std, round((max(t) - min(t)) / 3.6e9, 6) AS uptime_hours FROM g GROUP BY user_id""",
)
def feat_intervals(spark, d):
    s = features.series_features(events(spark, d), "user_id", "ts", "event_id")
    return s.select("user_id", "n", r6("interval_std", 3).alias("interval_std"), r6("uptime_hours").alias("uptime_hours"))


@query(
    "feat_clock_entropy",
    """WITH h AS (SELECT user_id, hour(ts) AS v, count(*)::DOUBLE AS c FROM events GROUP BY ALL), w AS (SELECT user_id, isodow(ts) - 1 AS v, count(*)::DOUBLE AS c FROM events GROUP BY ALL),
    a AS (SELECT user_id, round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 6) AS hour_entropy FROM h GROUP BY 1), b AS (SELECT user_id, round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 6) AS day_of_week_entropy FROM w GROUP BY 1)
    SELECT user_id, hour_entropy, day_of_week_entropy FROM a JOIN b USING (user_id)""",
)
def feat_clock_entropy(spark, d):
    e = features.clock_entropies(events(spark, d), "user_id", "ts")
    return e.select("user_id", r6("hour_entropy").alias("hour_entropy"), r6("day_of_week_entropy").alias("day_of_week_entropy"))


@query(
    "feat_peers",
    f"""WITH {NATIONS}, p AS (SELECT src AS k, dst AS v FROM ne UNION SELECT dst, src FROM ne) SELECT k, count(*) AS unique_peers FROM p GROUP BY k""",
)
def feat_peers(spark, d):
    e = nation_edges(spark, d).select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return both.groupBy(F.col("src").alias("k")).agg(F.count(F.lit(1)).alias("unique_peers"))


@query(
    "feat_port_entropy",
    """WITH c AS (SELECT l_suppkey, l_partkey % 65536 AS v, count(*)::DOUBLE AS c FROM lineitem GROUP BY ALL) SELECT l_suppkey, round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 6) AS port_entropy FROM c GROUP BY 1""",
)
def feat_port_entropy(spark, d):
    li = load(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 65536).alias("port"))
    return aggregates.entropy(li, ["l_suppkey"], "port", "port_entropy").select("l_suppkey", r6("port_entropy").alias("port_entropy"))


@query(
    "feat_distance_variance",
    f"""WITH {NATIONS}, {PLACES}, k AS (SELECT src, {HAVERSINE.format(a='a.', b='b.')} AS km FROM ne JOIN pl a ON src = a.k JOIN pl b ON dst = b.k) SELECT src, round(var_pop(km), 1) AS km_variance, round(avg(km), 3) AS km_mean FROM k GROUP BY src""",
)
def feat_distance_variance(spark, d):
    p = _places(spark, d)
    e = nation_edges(spark, d).select("src", "dst")
    a = F.broadcast(p.select(F.col("k").alias("src"), F.col("lat").alias("a1"), F.col("lng").alias("o1")))  # a row a nation
    b = F.broadcast(p.select(F.col("k").alias("dst"), F.col("lat").alias("a2"), F.col("lng").alias("o2")))
    km = e.join(a, "src").join(b, "dst").select("src", scalars.haversine_km(F.col("a1"), F.col("o1"), F.col("a2"), F.col("o2")).alias("km"))
    return km.groupBy("src").agg(r6(F.var_pop("km"), 1).alias("km_variance"), r6(F.avg("km"), 3).alias("km_mean"))


@query("feat_port_anomaly", "SELECT l_orderkey, l_linenumber, round(abs(l_partkey % 65536 - 8333) / 8333 + abs(l_suppkey % 65536 - 8333) / 8333, 6) AS port_anomaly FROM lineitem")
def feat_port_anomaly(spark, d):
    port = lambda c: F.abs(F.col(c) % 65536 - 8333) / 8333
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(port("l_partkey") + port("l_suppkey")).alias("port_anomaly"))


def order_records(spark, d):
    """Orders as records of the contract: customers and suppliers as addresses, at the places of their nations."""
    p, at = payments(spark, d), _places(spark, d)
    src = at.select(F.col("k").alias("_a"), F.col("lat").alias("src_lat"), F.col("lng").alias("src_lng"))
    dst = at.select(F.col("k").alias("_b"), F.col("lat").alias("dst_lat"), F.col("lng").alias("dst_lng"))
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("_s"), F.col("s_nationkey").alias("geo_asn")).join(F.broadcast(dst), F.col("geo_asn") == F.col("_b"))  # a row a nation
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("_c"), F.col("c_nationkey").alias("_n")).join(F.broadcast(src), F.col("_n") == F.col("_a"))
    both = p.join(c, p["wallet"] == c["_c"]).join(s, F.get("outputs", F.lit(0)) == s["_s"])
    return both.select(
        F.col("ts").cast("timestamp").alias("timestamp"), _address(F.col("wallet")).alias("src_ip"), _address(F.col("_s")).alias("dst_ip"), (F.col("txid") % 65536).cast("int").alias("src_port"), F.lit(8333).alias("dst_port"),
        F.col("txid").cast("string").alias("txid"), F.array(F.concat(F.lit("w"), "wallet")).alias("input_addresses"), F.transform("outputs", lambda x: F.concat(F.lit("s"), x)).alias("output_addresses"),
        F.array("amount").alias("input_amounts"), F.col("amounts").alias("output_amounts"), "fee", F.lit("P2WPKH").alias("script_type"), F.col("_n").cast("string").alias("geo_country"), F.col("geo_asn").cast("bigint").alias("geo_asn"),
        "src_lat", "src_lng", "dst_lat", "dst_lng",
    )


def _address(k):
    return F.concat_ws(".", F.lit("10"), *[(F.floor(k / n) % 256).cast("string") for n in (65536, 256, 1)])


def order_graph(spark, d, r):
    """(communities, centrality, gains) of the orders' wallets: nations as communities, betweenness of addresses between all pairs."""
    edges = wallet_edges(spark, d).select(F.concat(F.lit("w"), F.substring("src", 2, 20)).alias("src"), "dst", "weight")
    c = load(spark, d, "customer").select(F.concat(F.lit("w"), "c_custkey").alias("id"), F.col("c_nationkey").alias("community"))
    s = load(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("community"))
    members = c.unionByName(s)
    return members, iterative.whole_betweenness(r.select(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"))), iterative.modularity_gains(edges, members)


FEATURE_DIGITS = {"geo_distance_variance_km": 1, "inv_jitter_std": 3, "inter_tx_interval_std": 3, "output_amount_variance": 2, "fee_sat_per_vb": 2, "value_median": 4, "modularity_delta": 12}


@query(
    "features_all",
    f"""WITH {PAYMENTS}, {PLACES},
    rec AS (SELECT txid, wallet, fee, amount, outputs, amounts, epoch_us(ts) AS tm, ts, outputs[1] AS s1, s_nationkey AS asn, c_nationkey AS nat, txid % 65536 AS sp, {HAVERSINE.format(a='a.', b='b.')} AS km
      FROM pay JOIN customer ON wallet = c_custkey JOIN supplier ON outputs[1] = s_suppkey JOIN pl a ON a.k = c_nationkey JOIN pl b ON b.k = s_nationkey),
    sq AS (SELECT wallet, tm, (tm - lag(tm) OVER o) / 1e6 AS gap, CASE WHEN lag(tm) OVER o IS NOT NULL THEN (asn <> lag(asn) OVER o)::INT::DOUBLE END AS hop FROM rec WINDOW o AS (PARTITION BY wallet ORDER BY tm, txid::VARCHAR)),
    sr AS (SELECT wallet, CASE WHEN count(gap) < 2 THEN 0 ELSE stddev_pop(gap) END AS jitter, (max(tm) - min(tm)) / 3.6e9 AS uptime, coalesce(avg(hop), 0) AS hop FROM sq GROUP BY 1),
    vals AS (SELECT wallet, 'asn' AS kind, asn::BIGINT AS v FROM rec UNION ALL SELECT wallet, 'port', sp FROM rec UNION ALL SELECT wallet, 'both', sp FROM rec UNION ALL SELECT wallet, 'both', 8333 FROM rec
      UNION ALL SELECT wallet, 'hour', hour(ts) FROM rec UNION ALL SELECT wallet, 'day', isodow(ts) FROM rec),
    cnt AS (SELECT wallet, kind, v, count(*)::DOUBLE AS c FROM vals GROUP BY ALL),
    ent AS (SELECT wallet, kind, sum(c) AS n, count(*) AS d, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS e FROM cnt GROUP BY ALL),
    pe AS (SELECT x.wallet, CASE WHEN x.d > 1 THEN x.e WHEN x.n <= 1 OR y.d > 1 THEN y.e ELSE x.e END AS e FROM ent x JOIN ent y ON x.wallet = y.wallet AND x.kind = 'port' AND y.kind = 'both'),
    g AS (SELECT wallet, CASE WHEN count(*) < 2 THEN 0 ELSE var_pop(km) END AS km_var, count(DISTINCT s1) AS peers, count(DISTINCT nat) AS countries FROM rec GROUP BY 1),
    dg AS (SELECT id, count(*) AS degree FROM (SELECT wallet AS id FROM rec UNION ALL SELECT s1 FROM rec) GROUP BY 1),
    br AS (SELECT txid, count(*) OVER (PARTITION BY wallet ORDER BY tm RANGE BETWEEN 300000000 PRECEDING AND 300000000 FOLLOWING) AS b5, count(*) OVER (PARTITION BY wallet ORDER BY tm RANGE BETWEEN 3600000000 PRECEDING AND 3600000000 FOLLOWING) AS b60 FROM rec),
    mem AS (SELECT 'w' || c_custkey AS id, c_nationkey AS com FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier), cs AS (SELECT com, count(*) AS size FROM mem GROUP BY 1),
    we AS (SELECT 'w' || o_custkey AS a, 's' || l_suppkey AS b, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), lk AS (SELECT a, b, w FROM we UNION ALL SELECT b, a, w FROM we),
    own AS (SELECT a AS id, sum(w) AS k, any_value(com) AS com FROM lk JOIN mem ON a = id GROUP BY 1), tot AS (SELECT com, sum(k) AS total FROM own GROUP BY 1), mm AS (SELECT sum(w) AS mm FROM lk),
    ins AS (SELECT a AS id, sum(w) AS w_in FROM lk JOIN mem x ON a = x.id JOIN mem y ON b = y.id WHERE x.com = y.com GROUP BY 1),
    gn AS (SELECT own.id, 2 * coalesce(w_in, 0) / mm - 2 * k * (total - k) / (mm * mm) AS gain FROM own JOIN tot USING (com) LEFT JOIN ins ON own.id = ins.id, mm),
    {betweenness_sql("SELECT wallet AS src, s1 AS dst FROM rec", "SELECT wallet AS id FROM rec UNION SELECT s1 FROM rec")}, bz AS (SELECT avg(betweenness) AS m, stddev_pop(betweenness) AS sd FROM bw),
    am AS (SELECT txid, len(amounts) AS n_out, amounts, list_sort(amounts) AS so, list_sum(amounts) AS total, list_max(amounts) AS hi, list_min(amounts) AS lo, list_avg(amounts) AS mean, list_sort(list_concat(amounts, [amount])) AS al FROM rec),
    av AS (SELECT *, CASE WHEN n_out < 2 THEN 0 ELSE list_sum(list_transform(amounts, lambda x: pow(x - total / n_out, 2))) / n_out END AS var, list_sum(list_transform(so, lambda x, i: i * x)) AS ranked, coalesce(n_out >= 2 AND mean <> 0 AND (hi - lo) / abs(mean) < 0.01, false) AS eq FROM am)
    SELECT r.txid::VARCHAR AS txid, peers::DOUBLE AS unique_peers, round(ea.e, 6) AS asn_entropy, round(pe.e, 6) AS port_entropy, round(km_var, 1) AS geo_distance_variance_km, round(jitter, 3) AS inv_jitter_std, (d1.degree + d2.degree)::DOUBLE AS peer_degree, round(hop, 6) AS asn_hopping_rate,
    round(abs(sp - 8333) / 8333, 6) AS port_anomaly_score, countries::DOUBLE AS country_diversity, b5::DOUBLE AS p2p_burst_count, 0.0::DOUBLE AS rtt_proxy_ms, round(uptime, 6) AS uptime_hours, 1.0::DOUBLE AS tor_flag,
    (50 + ('0x' || substr(sha256('10.' || (r.wallet // 65536) % 256 || '.' || (r.wallet // 256) % 256 || '.' || r.wallet % 256), 1, 8))::UBIGINT % 251)::DOUBLE AS accuracy_radius_mean, 0.0::DOUBLE AS ws_reconnects, 1.0::DOUBLE AS fan_in, n_out::DOUBLE AS fan_out, round(var, 2) AS output_amount_variance,
    round(fee * 1e8 / 250, 2) AS fee_sat_per_vb, 1.0::DOUBLE AS "script_type_hist_P2WPKH_ratio", 1.0::DOUBLE AS input_count, round(CASE WHEN n_out <= 1 OR total = 0 THEN 0 ELSE 2 * ranked / (n_out * total) - (n_out + 1) / n_out END, 6) AS output_dispersion_gini, 0.0::DOUBLE AS utxo_age_blocks,
    CASE WHEN n_out = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS peel_depth, 0.0::DOUBLE AS mixer_score, CASE WHEN coalesce(fee / nullif(r.amounts[1], 0) BETWEEN 0.4 AND 0.7, false) AND eq THEN 1.0 ELSE 0.0 END::DOUBLE AS coinjoin_prob,
    CASE WHEN n_out = 2 AND hi > 0 AND (hi - lo) / hi > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS change_addr_likelihood, len(list_filter(r.amounts, lambda x: x < 0.00005))::DOUBLE AS dust_outputs, 0.0::DOUBLE AS op_return_flag, round((al[(len(al) + 1) // 2] + al[len(al) // 2 + 1]) / 2, 4) AS value_median,
    b5::DOUBLE AS burst_5m_count, b60::DOUBLE AS burst_1h_count, round(jitter, 3) AS inter_tx_interval_std, round(coalesce(gain, 0), 12) AS modularity_delta, round(eh.e, 6) AS hour_entropy, round(ed.e, 6) AS day_of_week_entropy, size::DOUBLE AS community_size,
    round(CASE WHEN sd > 0 THEN coalesce((betweenness - m) / sd, 0) ELSE 0 END, 6) AS betweenness_z
    FROM rec r JOIN sr USING (wallet) JOIN g USING (wallet) JOIN pe USING (wallet) JOIN br USING (txid) JOIN av ON av.txid = r.txid JOIN ent ea ON ea.wallet = r.wallet AND ea.kind = 'asn' JOIN ent eh ON eh.wallet = r.wallet AND eh.kind = 'hour'
    JOIN ent ed ON ed.wallet = r.wallet AND ed.kind = 'day' JOIN dg d1 ON d1.id = r.wallet JOIN dg d2 ON d2.id = s1 JOIN cs ON cs.com = nat LEFT JOIN gn ON gn.id = 'w' || r.wallet LEFT JOIN bw ON bw.id = r.wallet, bz""",
)
def features_all(spark, d):
    """All 38 features of orders, with what the graphs of their wallets and addresses give."""
    r = cut(order_records(spark, d), "order-records")  # the features and the graph read it
    f = features.features(r, *order_graph(spark, d, r))
    return f.select("txid", *[r6(n, FEATURE_DIGITS.get(n, 6)).alias(n) for n in features.FEATURES])


@query(
    "a31_first_addresses",
    "WITH e AS (SELECT user_id AS wallet, ts, event_id::VARCHAR AS txid, event_type AS src_ip FROM events) SELECT wallet, src_ip AS address FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY ts, txid) AS k FROM e) WHERE k = 1",
)
def a31_first_addresses(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("wallet"), "ts", F.col("event_id").cast("string").alias("txid"), F.col("event_type").alias("src_ip"))
    return features.first_addresses(e)


@query(
    "j12_wallet_centrality",
    "WITH c AS (SELECT event_type AS id, count(*)::DOUBLE AS v FROM events GROUP BY 1), f AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS a FROM events GROUP BY 1) SELECT id, v AS betweenness FROM c UNION ALL SELECT 'u' || user_id, v FROM f JOIN c ON a = c.id",
)
def j12_wallet_centrality(spark, d):
    """A count of each event type stands in for centrality; users get that of their first event's type."""
    e = events(spark, d).select(F.concat(F.lit("u"), "user_id").alias("wallet"), "ts", F.col("event_id").alias("txid"), F.col("event_type").alias("src_ip"))
    c = e.groupBy(F.col("src_ip").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("betweenness"))
    return features.carried_to_wallets(c, e)


@query(
    "feat_output_ages",
    f"""WITH {PAYMENTS}, p AS (SELECT DISTINCT unnest(outputs) AS k, epoch_us(ts) AS t FROM pay), w AS (SELECT txid, outputs[1] AS k, epoch_us(ts) AS t FROM pay)
    SELECT w.txid::VARCHAR AS txid, round(min(w.t - p.t) / 600000000, 6) AS age FROM w JOIN p ON w.k = p.k AND p.t < w.t GROUP BY 1""",
)
def feat_output_ages(spark, d):
    """Blocks since an order's first supplier was last paid by another, as if it were the one who pays now."""
    p = payments(spark, d).select(F.col("txid").cast("string").alias("txid"), "ts", F.get("outputs", F.lit(0)).alias("wallet"), F.col("outputs").alias("output_addresses"))
    return features.output_ages(p).select("txid", r6("age").alias("age"))


# ---------------------------------------------------------------- scalar functions


@query("x4_hash_numbers", "SELECT c_custkey, ('0x' || substr(sha256(c_custkey || '|' || c_nationkey), 1, 16))::UBIGINT::VARCHAR AS wide, (50 + ('0x' || substr(sha256(c_name), 1, 8))::UBIGINT % 251)::BIGINT AS radius FROM customer")
def x4_hash_numbers(spark, d):
    return load(spark, d, "customer").select("c_custkey", scalars.hash_int(F.col("c_custkey"), F.col("c_nationkey")).cast("string").alias("wide"), scalars.radius_km(F.col("c_name")).alias("radius"))


@query("x8_clock", "SELECT event_id, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS weekday FROM events")
def x8_clock(spark, d):
    return events(spark, d).select("event_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"))


@query(
    "x9_fused_scores",
    """WITH s AS (SELECT event_id, 1 / (1 + exp(-value / 50)) AS a, 1 / (1 + exp(1 - (event_id % 7) / 2)) AS b FROM events), f AS (SELECT *, 0.4::DOUBLE * a + 0.6::DOUBLE * b AS fused FROM s)
    SELECT event_id, round(a, 6) AS p_if, round(b, 6) AS p_gnn, round(fused, 6) AS fused, round(CASE WHEN abs(a - b) < 0.05 THEN a ELSE fused END, 6) AS hedged,
    CASE WHEN fused > 0.90 THEN 'critical' WHEN fused > 0.75 THEN 'high' WHEN fused > 0.50 THEN 'medium' ELSE 'low' END AS tier FROM f""",
)
def x9_fused_scores(spark, d):
    e = events(spark, d)
    a, b = scalars.anomaly_probability(-F.col("value") / 50), scalars.softmax_second(F.lit(1.0), (F.col("event_id") % 7) / 2)
    s = e.select("event_id", a.alias("a"), b.alias("b"))
    fused = scalars.fuse(F.col("a"), F.col("b"))
    hedged = scalars.hedge(F.col("a"), F.col("b"), fused, F.abs(F.col("a") - F.col("b")))
    return s.select("event_id", r6("a").alias("p_if"), r6("b").alias("p_gnn"), r6(fused).alias("fused"), r6(hedged).alias("hedged"), scalars.tier(fused).alias("tier"))


@query(
    "x16_display_scalars",
    """WITH RECURSIVE h(k, name, i, v) AS (SELECT n_nationkey, n_name, 0, 0::BIGINT FROM nation UNION ALL SELECT k, name, i + 1, (v * 31 + ascii(substr(name, i + 1, 1))) & 4294967295 FROM h WHERE i < length(name))
    SELECT k, v AS hash, round(least(64, greatest(16, 24 + 6 * ln(1 + k) + 20 * 0.5)), 6) AS node_size, CASE WHEN length(name) <= 6 THEN name ELSE substr(name, 1, 3) || '…' || right(name, 2) END AS short,
    printf('showing %d/%d', k, 25) AS badge FROM h WHERE i = length(name)""",
)
def x16_display_scalars(spark, d):
    n = load(spark, d, "nation")
    return n.select(
        F.col("n_nationkey").alias("k"), scalars.string_hash31(F.col("n_name")).alias("hash"), r6(scalars.node_size(F.col("n_nationkey"), F.lit(0.5))).alias("node_size"),
        scalars.shorten(F.col("n_name"), 3, 2).alias("short"), F.format_string("showing %d/%d", "n_nationkey", F.lit(25)).alias("badge"),
    )


@query(
    "x21_heuristic_scores",
    f"""WITH {PAYMENTS}, q AS (SELECT txid, len(list_distinct(outputs)) AS fi, len(outputs) AS fo, fee, list_max(amounts) AS hi FROM pay)
    SELECT txid, round(least(0.99, greatest(0.01, 0.15 + CASE WHEN fo >= 5 OR fi >= 5 THEN 0.35 ELSE 0 END + CASE WHEN fo >= 10 THEN 0.2 ELSE 0 END + CASE WHEN fee > 0.01 THEN 0.25 ELSE 0 END + CASE WHEN fi = 1 AND fo = 2 THEN 0.15 ELSE 0 END + CASE WHEN fo >= 5 AND hi < 1 THEN 0.1 ELSE 0 END))::DOUBLE, 6) AS score FROM q""",
)
def x21_heuristic_scores(spark, d):
    p = payments(spark, d)
    return p.select("txid", r6(scalars.heuristic_score(F.size(F.array_distinct("outputs")), F.size("outputs"), F.col("fee"), F.array_max("amounts"))).alias("score"))


@query(
    "x22_stretched_scores",
    """WITH p AS (SELECT s_suppkey, s_acctbal, 0.5 + s_acctbal / CASE WHEN s_nationkey % 2 = 0 THEN 1e6 ELSE 1e4 END AS v, s_nationkey % 2 AS g FROM supplier), m AS (SELECT g, min(v) AS lo, max(v) AS hi FROM p GROUP BY g), z AS (SELECT avg(s_acctbal) AS mean, stddev_pop(s_acctbal) AS sd FROM supplier)
    SELECT s_suppkey, round(CASE WHEN hi - lo >= 0.05 THEN v WHEN hi > lo THEN 0.2 + 0.6 * (v - lo) / (hi - lo) ELSE 0.5 END, 6) AS stretched, round((s_acctbal - mean) / CASE WHEN sd < 1e-9 THEN 1 ELSE sd END, 6) AS z FROM p JOIN m USING (g), z""",
)
def x22_stretched_scores(spark, d):
    """Two groups of scores, of which only the narrow one is drawn out."""
    s = load(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("b"), (F.col("s_nationkey") % 2).alias("g"))
    p = s.withColumn("v", 0.5 + F.col("b") / F.when(F.col("g") == 0, 1e6).otherwise(1e4))
    m = p.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    z = metrics.standardised(s.select("s_suppkey", "b"), ["b"]).withColumnRenamed("b", "z")
    return p.join(m, "g").join(z, "s_suppkey").select("s_suppkey", r6(scalars.stretched(F.col("v"), F.col("lo"), F.col("hi"))).alias("stretched"), r6("z").alias("z"))


@query(
    "x15_geo_tiers",
    """WITH RECURSIVE n AS (SELECT n_nationkey AS k, n_name || '-' || coalesce((CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey END)::VARCHAR, '0') AS s FROM nation),
    h(k, s, i, v) AS (SELECT k, s, 0, 0::BIGINT FROM n UNION ALL SELECT k, s, i + 1, (v * 31 + ascii(substr(s, i + 1, 1))) & 4294967295 FROM h WHERE i < length(s))
    SELECT k, ['tier1', 'tier2', 'tier3'][(v % 3)::INT + 1] AS by_place, CASE WHEN k / 25 >= 0.8 THEN 'tier1' WHEN k / 25 >= 0.5 THEN 'tier2' ELSE 'tier3' END AS by_score FROM h WHERE i = length(s)""",
)
def x15_geo_tiers(spark, d):
    k = F.col("n_nationkey")
    return load(spark, d, "nation").select(k.alias("k"), scalars.place_tier(F.col("n_name"), F.when(k % 4 != 0, F.col("n_regionkey"))).alias("by_place"), scalars.geo_tier(k / 25).alias("by_score"))


@query(
    "x20_explanations",
    f"""WITH {PAYMENTS} SELECT txid, 'Wallet ' || wallet || ' flagged: ' || len(outputs) || ' outputs <1 BTC in 5 min, peers 2 ASN 1 — conf ' || printf('%.2f', 0.25::DOUBLE + (txid % 3) / 4) || ' (fan_out+fee+gini)' AS text FROM pay""",
)
def x20_explanations(spark, d):
    p = payments(spark, d)
    t = scalars.explanation_text(F.col("wallet").cast("string"), F.size("outputs"), F.lit(5), F.lit(2), F.lit(1), 0.25 + (F.col("txid") % 3) / 4, [F.lit("fan_out"), F.lit("fee"), F.lit("gini")])
    return p.select("txid", t.alias("text"))


@query("v9_marker_points", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey <> 0 THEN c_custkey::DOUBLE WHEN c_nationkey % 2 = 0 THEN 39.8::DOUBLE ELSE 51.1657::DOUBLE END AS lat FROM customer")
def v9_marker_points(spark, d):
    own = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("double")).when(F.col("c_custkey") % 3 == 1, 0.0)
    country = F.when(F.col("c_nationkey") % 2 == 0, " us").otherwise("DE")
    lat, _ = geo.marker_point(own, own, country)
    return load(spark, d, "customer").select("c_custkey", lat.alias("lat"))


X24 = "('0x' || substr(sha256({}), 1, 16))::UBIGINT"


@query(
    "x24_made_up_places",
    f"""SELECT c_custkey, ['US', 'CN', 'RU', 'DE', 'JP', 'GB', 'IN', 'BR', 'CA', 'AU', 'FR', 'KR', 'NL', 'SG', 'TR', 'NG', 'ZA', 'IR', 'UA', 'SE'][({X24.format("c_custkey::VARCHAR")} % 20)::INT + 1] AS country,
    (1000 + {X24.format("c_nationkey || ':' || c_custkey")} % 499001)::BIGINT AS network, CASE WHEN {X24.format("c_custkey || ':src'")} % 10 < 6 THEN 8333 WHEN {X24.format("c_custkey || ':src'")} % 2 = 0 THEN 18333 ELSE 9735 END AS port FROM customer""",
)
def x24_made_up_places(spark, d):
    k = F.col("c_custkey").cast("string")
    return load(spark, d, "customer").select("c_custkey", geo.made_up_country(k).alias("country"), geo.made_up_network(F.col("c_nationkey").cast("string"), k).alias("network"), geo.made_up_port(k, "src").alias("port"))
