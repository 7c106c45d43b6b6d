"""Queries over edge layers and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.functions.tables import cut, dealt, load
from tallyflow.operators import centrality, generate, graph, iterative, network
from tallyflow.plans.base import NATIONS, PAYMENTS, WALLETS, betweenness_sql, events, nation_edges, payments, query, r6, wallet_edges
from tallyflow.plans.records import order_records

TEMPORAL = """g AS (SELECT user_id, ts, event_id, lag(event_id) OVER w AS src, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
te AS (SELECT src, event_id AS dst, user_id, ts, gap, exp(-abs(gap) / 300) AS weight FROM g WHERE gap >= 0 AND gap <= 3600)"""


@query("g3_temporal_edges", f"WITH {TEMPORAL} SELECT src, dst, ts, round(gap, 6) AS gap, round(weight, 6) AS weight FROM te")
def g3_temporal_edges(spark, d):
    e = graph.temporal_edges(events(spark, d), "user_id", "ts", "event_id")
    return e.select("src", "dst", "ts", r6("gap").alias("gap"), r6("weight").alias("weight"))


@query("g4_linked_wallets", f"WITH {TEMPORAL} SELECT user_id, count(*) AS n_links, round(sum(weight), 6) AS strength FROM te GROUP BY user_id")
def g4_linked_wallets(spark, d):
    """Each wallet's links in time and their decayed strength."""
    ev = events(spark, d)
    e = graph.temporal_edges(ev, "user_id", "ts", "event_id")
    of = ev.select(F.col("event_id").alias("dst"), "user_id")
    return e.join(of, "dst").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_links"), r6(F.sum("weight")).alias("strength"))


@query("g1_p2p_edges", f"WITH {NATIONS} SELECT src, dst, 'p2p' AS type, 0.0::DOUBLE AS amount, ts, 1.0::DOUBLE AS weight FROM ne")
def g1_p2p_edges(spark, d):
    return graph.p2p_edges(nation_edges(spark, d), "src", "dst", "ts")


@query(
    "g2_utxo_edges",
    f"""WITH {PAYMENTS}, e AS (SELECT 'w' || wallet AS src, 't' || txid AS dst, amount, ts FROM pay
    UNION ALL SELECT 't' || txid, 's' || unnest(outputs), unnest(amounts), ts FROM pay)
    SELECT src, dst, amount, ts, round(amount / (SELECT max(amount) FROM e), 6) AS weight FROM e""",
)
def g2_utxo_edges(spark, d):
    p = payments(spark, d)
    rec = p.select(
        F.concat(F.lit("t"), "txid").alias("txid"), "ts", F.array(F.concat(F.lit("w"), "wallet")).alias("input_addresses"), F.array("amount").alias("input_amounts"),
        F.transform("outputs", lambda x: F.concat(F.lit("s"), x)).alias("output_addresses"), F.col("amounts").alias("output_amounts"),
    )
    return graph.utxo_edges(rec, "ts").select("src", "dst", "amount", "ts", r6("weight").alias("weight"))


@query("g5_default_weights", f"WITH {WALLETS} SELECT src, dst, CASE WHEN weight > 1 THEN weight ELSE 0.5 END AS weight FROM we")
def g5_default_weights(spark, d):
    e = wallet_edges(spark, d).select("src", "dst", F.when(F.col("weight") > 1, F.col("weight")).alias("weight"), F.lit("utxo").alias("type"))
    return graph.with_default_weight(e).select("src", "dst", "weight")


COINJOIN = f"""{PAYMENTS}, s AS (SELECT txid, wallet, len(outputs) AS n_out, list_distinct(outputs) AS d, amounts, fee, list_aggregate(amounts, 'avg') AS m, list_max(amounts) AS hi, list_min(amounts) AS lo, amounts[1] AS first FROM pay),
q AS (SELECT *, len(d) AS n_in, coalesce(len(amounts) >= 2 AND m <> 0 AND (hi - lo) / abs(m) < 0.01, false) AS eq FROM s),
k AS (SELECT *, CASE WHEN n_out::DOUBLE / n_in BETWEEN 0.4 AND 0.7 THEN n_out::DOUBLE / n_in WHEN first <> 0 THEN fee / first END AS cand FROM q),
cj AS (SELECT txid, wallet, n_in, n_out, eq, CASE WHEN n_in >= 20 AND n_out >= 20 AND eq THEN 'wasabi' WHEN coalesce(cand BETWEEN 0.4 AND 0.7, false) AND eq THEN 'joinmarket' WHEN n_in > 5 AND n_out >= 5 AND eq THEN 'kappos' ELSE '' END AS reason FROM k)"""


def _coinjoins(spark, d):
    p = payments(spark, d).withColumn("n_in", F.size(F.array_distinct("outputs"))).withColumn("n_out", F.size("outputs"))
    flag, reason = graph.coinjoin_columns(F.col("n_in"), F.col("n_out"), F.col("amounts"), F.col("fee"))
    return p.withColumn("is_coinjoin", flag).withColumn("reason", reason).withColumn("equal", graph.within_one_percent(F.col("amounts")))


@query("g6_coinjoin_flags", f"WITH {COINJOIN} SELECT txid, n_in::BIGINT AS n_in, n_out::BIGINT AS n_out, eq AS equal_outputs, reason <> '' AS is_coinjoin, reason FROM cj")
def g6_coinjoin_flags(spark, d):
    """Sample tables have no inputs: distinct outputs stand in for them."""
    return _coinjoins(spark, d).select("txid", F.col("n_in").cast("bigint").alias("n_in"), F.col("n_out").cast("bigint").alias("n_out"), F.col("equal").alias("equal_outputs"), "is_coinjoin", "reason")


@query("g12_coinjoin_quarantine", f"WITH {COINJOIN} SELECT wallet, count(*) AS n_tx FROM cj WHERE NOT (eq AND n_out >= 2) GROUP BY wallet")
def g12_coinjoin_quarantine(spark, d):
    """Transactions per wallet without those of equal outputs."""
    c = _coinjoins(spark, d)
    bad = c.where(F.col("equal") & (F.col("n_out") >= 2)).select("txid")
    return c.join(bad, "txid", "left_anti").groupBy("wallet").agg(F.count(F.lit(1)).alias("n_tx"))


@query("u3_node_set", f"WITH {WALLETS} SELECT src AS id FROM we UNION SELECT dst FROM we")
def u3_node_set(spark, d):
    return graph.node_set(wallet_edges(spark, d))


@query(
    "u1_edges_by_type",
    f"""WITH {NATIONS}, {WALLETS}, {TEMPORAL}, e AS (SELECT 'p2p' AS type, 1.0::DOUBLE AS weight FROM ne UNION ALL SELECT 'utxo', weight FROM we UNION ALL SELECT 'temporal', weight FROM te)
    SELECT type, count(*) AS n, round(sum(weight), 4) AS total FROM e GROUP BY type""",
)
def u1_edges_by_type(spark, d):
    p2p = graph.p2p_edges(nation_edges(spark, d), "src", "dst", "ts").select("type", "weight")
    utxo = wallet_edges(spark, d).select(F.lit("utxo").alias("type"), "weight")
    temporal = graph.temporal_edges(events(spark, d), "user_id", "ts", "event_id").select("type", "weight")
    return p2p.unionByName(utxo).unionByName(temporal).groupBy("type").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("weight"), 4).alias("total"))


@query(
    "j7_cospend_pairs",
    f"""WITH {PAYMENTS}, i AS (SELECT DISTINCT txid, unnest(outputs) AS w FROM pay)
    SELECT x.w AS a, y.w AS b, count(*) AS n_tx FROM i x JOIN i y ON x.txid = y.txid AND x.w < y.w GROUP BY ALL""",
)
def j7_cospend_pairs(spark, d):
    li, o = load(spark, d, "lineitem"), load(spark, d, "orders")
    n = li.count()
    li, o = dealt(li.select("l_orderkey", "l_suppkey"), n, "l_orderkey"), dealt(o.select("o_orderkey"), n, "o_orderkey")
    return graph.cospend_pairs(li.join(o, li["l_orderkey"] == o["o_orderkey"], "left_semi"), "l_orderkey", "l_suppkey", n)


@query(
    "g11_components",
    """WITH RECURSIVE u AS (SELECT l_orderkey AS o, min(l_partkey) AS first FROM lineitem GROUP BY 1),
    e AS (SELECT DISTINCT l_partkey AS a, first AS b FROM lineitem JOIN u ON o = l_orderkey WHERE l_partkey <> first),
    b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(id, component) AS (SELECT a, a FROM b UNION SELECT b.b, r.component FROM r JOIN b ON r.id = b.a WHERE r.component < b.b)
    SELECT id, min(component) AS component FROM r GROUP BY id""",
)
def g11_components(spark, d):
    """Parts that orders tie together."""
    links = cut(_part_links(spark, d), "part-links")  # read for links and for nodes
    return iterative.connected_components(links)


@query(
    "a2_supercluster_ratio",
    "WITH s AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT round(max(n) / nullif(sum(n), 0), 6) AS ratio FROM s",
)
def a2_supercluster_ratio(spark, d):
    sizes = load(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return graph.supercluster_ratio(sizes).select(r6("ratio").alias("ratio"))


@query(
    "g14_guarded_communities",
    """WITH s AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), r AS (SELECT max(n) / sum(n) AS ratio FROM s)
    SELECT c_custkey AS id, CASE WHEN ratio >= 0.05 THEN c_custkey ELSE c_nationkey END AS community FROM customer, r""",
)
def g14_guarded_communities(spark, d):
    m = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("community"))
    return graph.guarded_communities(m)


@query(
    "a1_community_sizes",
    "SELECT c_custkey AS id, count(*) OVER (PARTITION BY c_nationkey) AS size FROM customer",
)
def a1_community_sizes(spark, d):
    m = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    return m.join(m.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("size")), "c_nationkey").select("id", "size")


@query("a11_degree", f"WITH {WALLETS} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM we UNION ALL SELECT dst FROM we) GROUP BY id")
def a11_degree(spark, d):
    return graph.degree(wallet_edges(spark, d))


@query(
    "f9_induced_subgraph",
    f"WITH {WALLETS}, k AS (SELECT id FROM (SELECT src AS id FROM we UNION ALL SELECT dst FROM we) GROUP BY id HAVING count(*) >= 20) SELECT src, dst, weight FROM we WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)",
)
def f9_induced_subgraph(spark, d):
    e = wallet_edges(spark, d)
    return graph.induced(e, graph.degree(e).where("degree >= 20"))


@query(
    "f10_time_ordered_edges",
    f"""WITH {WALLETS}, t AS (SELECT 'c' || o_custkey AS id, min(o_orderdate) AS step FROM orders GROUP BY 1 UNION ALL SELECT 's' || l_suppkey, min(l_shipdate) FROM lineitem GROUP BY 1)
    SELECT src, dst FROM we JOIN t a ON src = a.id JOIN t b ON dst = b.id WHERE a.step <= b.step""",
)
def f10_time_ordered_edges(spark, d):
    o = load(spark, d, "orders").groupBy(F.concat(F.lit("c"), "o_custkey").alias("id")).agg(F.min("o_orderdate").alias("step"))
    s = load(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("id")).agg(F.min("l_shipdate").alias("step"))
    return graph.ordered_in_time(wallet_edges(spark, d), o.unionByName(s)).select("src", "dst")


@query(
    "k5_graph_page",
    f"WITH {WALLETS}, n AS (SELECT DISTINCT id FROM (SELECT src AS id FROM we UNION ALL SELECT dst FROM we) ORDER BY id DESC LIMIT 500) SELECT src, dst FROM we WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)",
)
def k5_graph_page(spark, d):
    """The edges among a page of 500 nodes, from the last id down so that both kinds are on it."""
    e = wallet_edges(spark, d)
    some = graph.node_set(e).orderBy(F.desc("id")).limit(500)
    return graph.induced(e, some).select("src", "dst")


@query("g23_simple_graph", f"WITH {NATIONS} SELECT src, dst, count(*) AS n, round(max(amount), 2) AS weight FROM ne WHERE src <> dst GROUP BY ALL")
def g23_simple_graph(spark, d):
    e = nation_edges(spark, d).withColumnRenamed("amount", "weight")
    return graph.simple_edges(e).select("src", "dst", "n", r6("weight", 2).alias("weight"))


def _pagerank_sql(steps: int) -> str:
    ctes = [WALLETS, "s AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM we)", "n AS MATERIALIZED (SELECT src AS id FROM s UNION SELECT dst FROM s)", "c AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM n)", "r0 AS MATERIALIZED (SELECT id, 1 / c.n AS rank FROM n, c)"]
    for i in range(1, steps + 1):
        ctes.append(f"l{i} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS lost FROM r{i - 1} WHERE id NOT IN (SELECT src FROM s))")
        ctes.append(f"g{i} AS MATERIALIZED (SELECT dst, sum(rank * share) AS got FROM s JOIN r{i - 1} ON src = id GROUP BY dst)")
        ctes.append(f"r{i} AS MATERIALIZED (SELECT n.id, 0.15::DOUBLE / c.n + 0.85::DOUBLE * (coalesce(got, 0) + lost / c.n) AS rank FROM n LEFT JOIN g{i} ON n.id = dst, c, l{i})")
    return f"WITH {', '.join(ctes)} SELECT id, round(rank, 9) AS rank FROM r{steps}"


@query("g16_pagerank", _pagerank_sql(10))
def g16_pagerank(spark, d):
    return iterative.pagerank(wallet_edges(spark, d)).select("id", r6("rank", 9).alias("rank"))


@query(
    "g17_bfs_levels",
    f"""WITH RECURSIVE {WALLETS}, und AS (SELECT src AS a, dst AS b FROM we UNION SELECT dst, src FROM we), s AS (SELECT min(src) AS id FROM we),
    r(id, level) AS (SELECT id, 0 FROM s UNION SELECT b, level + 1 FROM r JOIN und ON id = a WHERE level < 14) SELECT id, min(level) AS level FROM r GROUP BY id""",
)
def g17_bfs_levels(spark, d):
    e = wallet_edges(spark, d)
    return iterative.bfs_levels(e, e.agg(F.min("src").alias("id")))


@query("g20_dag_levels", "SELECT o_orderkey AS id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS level FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def g20_dag_levels(spark, d):
    """The place of each order on the longest way along its customer's chain, which has skip edges too."""
    n = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("step"))
    return iterative.dag_levels(generate.chain_edges(n))


@query("g24_trained_network")
def g24_trained_network(spark, d):
    """A small network over the wallets' graph, trained for three steps to tell customers who owe from others, a third of them known."""
    e = cut(wallet_edges(spark, d).select("src", "dst"), "wallet-edges")  # several steps read it
    c = load(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), "c_custkey", (F.col("c_acctbal") < 0).cast("int").alias("y"))
    deg = graph.degree(e)
    x = cut(deg.select("id", F.array(F.startswith("id", F.lit("c")).cast("double"), F.ln(F.col("degree").cast("double"))).alias("x")), "features")
    matrix = iterative._propagation(e, x)
    net, _ = network.fit_network(e, x, c.where("c_custkey % 3 = 0").select("id", "y"), (4, 3), epochs=3, matrix=matrix)
    return net.predict(e, x, matrix).select("id", r6(F.get("p", F.lit(1))).alias("p"))


PARTS = """u0 AS (SELECT l_orderkey AS o, min(l_partkey) AS f FROM lineitem GROUP BY 1), u AS (SELECT DISTINCT f AS a, l_partkey AS b FROM lineitem JOIN u0 ON o = l_orderkey WHERE l_partkey <> f),
    g AS (SELECT id, count(*)::DOUBLE AS k FROM (SELECT a AS id FROM u UNION ALL SELECT b FROM u) GROUP BY id),
    c AS (SELECT count(*) AS n, (sum(k) / 2)::BIGINT AS m, sum(k * (k - 1) / 2) AS w FROM g),
    t AS (SELECT x.a AS i, x.b AS j, y.b AS l FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b),
    tn AS (SELECT id, count(*) AS t FROM (SELECT i AS id FROM t UNION ALL SELECT j FROM t UNION ALL SELECT l FROM t) GROUP BY id),
    lc AS (SELECT avg(CASE WHEN k > 1 THEN 2 * coalesce(tn.t, 0) / (k * (k - 1)) ELSE 0 END) AS cl, (coalesce(sum(tn.t), 0) / 3)::BIGINT AS tri FROM g LEFT JOIN tn USING (id)),
    ab AS (SELECT x.k AS x, y.k AS y FROM u JOIN g x ON a = x.id JOIN g y ON b = y.id), asr AS (SELECT corr(x, y) AS r FROM (SELECT x, y FROM ab UNION ALL SELECT y, x FROM ab))"""


def _part_links(spark, d):
    """Parts tied to the least part of each order they are in."""
    li = load(spark, d, "lineitem")
    return graph.cospend_links(li, "l_orderkey", "l_partkey", li.count())


@query(
    "a28_graph_summary",
    f"WITH {PARTS} SELECT n, m, round(2 * m / (n * (n - 1)), 9) AS density, round(2 * m / n, 6) AS average_degree, tri AS triangles, round(3 * tri / w, 6) AS transitivity, round(cl, 6) AS clustering, round(r, 6) AS assortativity FROM c, lc, asr",
)
def a28_graph_summary(spark, d):
    s = graph.summary(_part_links(spark, d))
    return s.select("n", "m", r6("density", 9).alias("density"), r6("average_degree").alias("average_degree"), "triangles", *[r6(c).alias(c) for c in ("transitivity", "clustering", "assortativity")])


@query(
    "a28_summary_vector",
    f"WITH {PARTS}, v AS (SELECT n / 1000 AS v0, m / 1000 AS v1, 2 * m / (n * (n - 1)) AS v2, 2 * m / n / 10 AS v3, cl AS v4, (r + 1) / 2 AS v5, 3 * tri / n / 10 AS v6 FROM c, lc, asr) SELECT {', '.join(f'round(least(5.0, greatest(0.0, v{i}))::DOUBLE, 6) AS v{i}' for i in range(7))} FROM v",
)
def a28_summary_vector(spark, d):
    return graph.summary_vector(graph.summary(_part_links(spark, d))).select(*[r6(f"v{i}").alias(f"v{i}") for i in range(7)])


@query("g10_communities")
def g10_communities(spark, d):
    return iterative.modularity_communities(wallet_edges(spark, d))


def _spent_together(spark, d):
    """Wallets that are inputs of the same payments, without those that are mixed."""
    c = cut(_coinjoins(spark, d).select("txid", "outputs", "is_coinjoin", "equal", "n_out"), "coinjoins")
    inputs = cut(c.select("txid", F.explode("outputs").alias("w")).distinct(), "inputs")
    return inputs, graph.cospend_edges(inputs, c.where("is_coinjoin OR equal AND n_out >= 2").select("txid"), "txid", "w", inputs.count())


@query(
    "g10_cospend_edges",
    f"""WITH {COINJOIN}, i AS (SELECT DISTINCT txid, unnest(outputs) AS w FROM pay SEMI JOIN (SELECT txid FROM cj WHERE NOT (reason <> '' OR eq AND n_out >= 2)) USING (txid))
    SELECT x.w AS src, y.w AS dst, count(*)::DOUBLE AS weight FROM i x JOIN i y ON x.txid = y.txid AND x.w < y.w GROUP BY ALL""",
)
def g10_cospend_edges(spark, d):
    return _spent_together(spark, d)[1]


@query("g10_cospend_communities")
def g10_cospend_communities(spark, d):
    """Communities of wallets over payments that aren't mixed; a wallet without such a payment is one of its own."""
    inputs, edges = _spent_together(spark, d)
    edges = cut(edges, "cospends")
    return graph.with_fresh_communities(inputs.select(F.col("w").alias("id")), iterative.modularity_communities(edges))


@query("g10_modularity")
def g10_modularity(spark, d):
    e = wallet_edges(spark, d)
    return iterative.modularity(e, iterative.modularity_communities(e)).select(r6("modularity").alias("modularity"))


@query(
    "g10_modularity_gains",
    f"""WITH {WALLETS}, lk AS (SELECT src AS a, dst AS b, weight AS w FROM we UNION ALL SELECT dst, src, weight FROM we), mem AS (SELECT 'c' || c_custkey AS id, c_nationkey AS com FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier),
    own AS (SELECT a AS id, sum(w) AS k, any_value(com) AS com FROM lk JOIN mem ON a = id GROUP BY 1), tot AS (SELECT com, sum(k) AS total FROM own GROUP BY 1), mm AS (SELECT sum(w) AS mm FROM lk),
    ins AS (SELECT a AS id, sum(w) AS w_in FROM lk JOIN mem x ON a = x.id JOIN mem y ON b = y.id WHERE x.com = y.com GROUP BY 1)
    SELECT own.id, round(2 * coalesce(w_in, 0) / mm - 2 * k * (total - k) / (mm * mm), 12) AS gain FROM own JOIN tot USING (com) LEFT JOIN ins ON own.id = ins.id, mm""",
)
def g10_modularity_gains(spark, d):
    c = load(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_nationkey").alias("community"))
    s = load(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("community"))
    return iterative.modularity_gains(wallet_edges(spark, d), c.unionByName(s)).select("id", r6("gain", 12).alias("gain"))


@query("g13_fresh_communities", "SELECT c_custkey AS id, coalesce(s_nationkey::BIGINT, 1000000 + c_custkey) AS community FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def g13_fresh_communities(spark, d):
    """Customers that are suppliers too have their nation as community, others one of their own."""
    m = load(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("id"), F.col("s_nationkey").cast("bigint").alias("community"))
    nodes = load(spark, d, "customer").select((F.col("c_custkey") + 1_000_000).alias("id"))
    return graph.with_fresh_communities(nodes, m).select((F.col("id") - 1_000_000).alias("id"), "community")


@query("g23_without_dangling", f"WITH {WALLETS}, k AS (SELECT dst AS id FROM we GROUP BY 1 HAVING count(*) % 2 = 0 UNION ALL SELECT DISTINCT src FROM we WHERE src LIKE '%1') SELECT src, dst, 1::BIGINT AS n FROM we WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def g23_without_dangling(spark, d):
    e = wallet_edges(spark, d)
    some = e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 0").select("id")
    return graph.without_dangling(e, some.unionByName(e.select(F.col("src").alias("id")).where("id LIKE '%1'").distinct())).select("src", "dst", "n")


@query("k6_edge_cap", f"WITH {WALLETS} SELECT src, dst FROM we ORDER BY src, dst LIMIT 500")
def k6_edge_cap(spark, d):
    """The feature is the cap: twice as many edges as a page of 250 nodes has."""
    return graph.capped_edges(wallet_edges(spark, d), 250).select("src", "dst")


@query("g17_bfs_sample", f"WITH {WALLETS} SELECT least(400, count(DISTINCT id)) AS n FROM (SELECT src AS id FROM we UNION ALL SELECT dst FROM we)")
def g17_bfs_sample(spark, d):
    """The size of a sample of 400 nodes round the first customer."""
    e = wallet_edges(spark, d)
    return iterative.bfs_sample(e, e.agg(F.min("src").alias("id")), 400).agg(F.countDistinct("id").alias("n"))


@query(
    "g15_betweenness",
    f"WITH {WALLETS}, {betweenness_sql('SELECT src, dst FROM we', 'SELECT DISTINCT dst AS id FROM we ORDER BY dst LIMIT 4')} SELECT id, round(betweenness, 4) AS betweenness FROM bw",
)
def g15_betweenness(spark, d):
    """Paths from the first four suppliers through the graph of customers and suppliers."""
    e = wallet_edges(spark, d)
    pivots = e.select(F.col("dst").alias("id")).distinct().orderBy("id").limit(4)
    return iterative.betweenness(e.select("src", "dst"), pivots).select("id", r6("betweenness", 4).alias("betweenness"))


def payment_graph(spark, d):
    """Orders as transactions between wallets, a supplier being the wallet of its number: inputs, outputs and a wallet's next transaction, weighted."""
    r = order_records(spark, d).withColumn("output_addresses", F.transform("output_addresses", lambda x: F.concat(F.lit("w"), F.substring(x, 2, 20))))
    r = cut(r.select("txid", "timestamp", "input_addresses", "output_addresses", "input_amounts", "output_amounts"), "payments")
    near = graph.temporal_edges(r.withColumn("wallet", F.get("input_addresses", F.lit(0))), "wallet", "timestamp", "txid")
    return graph.utxo_edges(r).select("src", "dst", "weight").unionByName(near.select("src", "dst", "weight"))


#: Shortest paths by recursion on better distances; their edges; all of them, node by node; what each gives the nodes inside.
PATHS = f"""{PAYMENTS}, top AS (SELECT greatest(max(amount), max(list_max(amounts)))::DOUBLE AS top FROM pay),
    e0 AS (SELECT 'w' || wallet AS src, txid::VARCHAR AS dst, amount::DOUBLE / top AS w FROM pay, top UNION ALL SELECT txid::VARCHAR, 'w' || unnest(outputs), unnest(amounts)::DOUBLE / top FROM pay, top
      UNION ALL SELECT p, txid::VARCHAR, exp(-gap / 300) FROM (SELECT txid, lag(txid) OVER o::VARCHAR AS p, (epoch_us(ts) - lag(epoch_us(ts)) OVER o) / 1e6 AS gap FROM pay WINDOW o AS (PARTITION BY wallet ORDER BY ts, txid::VARCHAR)) WHERE gap BETWEEN 0 AND 3600),
    e AS MATERIALIZED (SELECT src, dst, min(coalesce(nullif(w, 0), 1)) AS w FROM e0 WHERE src <> dst GROUP BY ALL), n AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e),
    pv AS MATERIALIZED (SELECT id FROM n ORDER BY md5(id), id LIMIT {{pivots}}),
    ds(root, id, d) USING KEY (root, id) AS (SELECT id, id, 0::DOUBLE FROM pv UNION SELECT f.root, e.dst, min(f.d + e.w) FROM ds f JOIN e ON f.id = e.src LEFT JOIN recurring.ds r ON r.root = f.root AND r.id = e.dst WHERE r.d IS NULL OR f.d + e.w < r.d GROUP BY f.root, e.dst),
    dm AS MATERIALIZED (SELECT * FROM ds), tt AS MATERIALIZED (SELECT a.root, e.src, e.dst FROM dm a JOIN e ON a.id = e.src JOIN dm b ON b.root = a.root AND b.id = e.dst AND a.d + e.w = b.d),
    ph(root, id, inside) AS (SELECT id, id, []::VARCHAR[] FROM pv UNION ALL SELECT p.root, dst, CASE WHEN p.id = p.root THEN inside ELSE list_append(inside, p.id) END FROM ph p JOIN tt ON tt.root = p.root AND tt.src = p.id),
    sh AS (SELECT unnest(inside) AS id, part FROM (SELECT inside, 1.0::DOUBLE / count(*) OVER (PARTITION BY root, id) AS part FROM ph))"""


@query("g15_weighted_betweenness", "WITH RECURSIVE " + PATHS.format(pivots=200) + " SELECT n.id, round(coalesce(sum(part), 0), 4) AS betweenness FROM n LEFT JOIN sh ON n.id = sh.id GROUP BY n.id")
def g15_weighted_betweenness(spark, d):
    """Shortest weighted paths from 200 pivots through the directed graph of wallets and transactions."""
    e = cut(payment_graph(spark, d), "payment-graph")
    return centrality.weighted_betweenness(e, centrality.chosen_pivots(e, 200)).select("id", r6("betweenness", 4).alias("betweenness"))


@query(
    "g24_graph_convolution",
    f"""WITH {WALLETS}, n AS (SELECT DISTINCT id FROM (SELECT src AS id FROM we UNION ALL SELECT dst FROM we)), x AS (SELECT id, CASE WHEN id LIKE 'c%' THEN 1.0 ELSE 0.0 END::DOUBLE AS x0, length(id)::DOUBLE AS x1 FROM n),
    a AS (SELECT src, dst FROM we UNION SELECT dst, src FROM we UNION SELECT id, id FROM n), g AS (SELECT src AS id, count(*)::DOUBLE AS d FROM a GROUP BY 1)
    SELECT a.src AS id, round(sum(x0 / sqrt(p.d * q.d)), 6) AS x0, round(sum(x1 / sqrt(p.d * q.d)), 6) AS x1 FROM a JOIN g p ON a.src = p.id JOIN g q ON a.dst = q.id JOIN x ON a.dst = x.id GROUP BY 1""",
)
def g24_graph_convolution(spark, d):
    e = cut(wallet_edges(spark, d).select("src", "dst"), "wallet-edges")
    x = graph.node_set(e).select("id", F.array(F.when(F.startswith("id", F.lit("c")), 1.0).otherwise(0.0), F.length("id").cast("double")).alias("x"))
    out = iterative.graph_convolution(e, x, 2)
    return out.select("id", r6(F.col("x")[0]).alias("x0"), r6(F.col("x")[1]).alias("x1"))
