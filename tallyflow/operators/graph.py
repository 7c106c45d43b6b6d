"""Edge layers, node sets, mixing detection and subgraphs, on any frame that has the named columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.aggregates import within_one_percent
from tallyflow.functions.scalars import decay_weight, default_weight
from tallyflow.functions.scan import previous
from tallyflow.functions.tables import cut, dealt

EDGE = ["src", "dst", "type", "amount", "ts", "weight"]


def p2p_edges(records: DataFrame, src: str = "src_ip", dst: str = "dst_ip", ts: str = "timestamp") -> DataFrame:
    """One edge a record, with amount 0 and weight 1."""
    return records.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit("p2p").alias("type"), F.lit(0.0).alias("amount"), F.col(ts).alias("ts"), F.lit(1.0).alias("weight"))


def utxo_edges(records: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Wallet to transaction for each input and transaction to wallet for each output; weight is amount over the largest.

    Address i goes with amount i; a missing amount is 0.
    """

    def side(addresses: str, amounts: str, incoming: bool) -> DataFrame:
        one = records.select("txid", F.col(ts).alias("ts"), F.posexplode(addresses).alias("i", "wallet"), F.col(amounts).alias("a"))
        amount = F.coalesce(F.get("a", F.col("i")), F.lit(0.0))
        ends = (F.col("wallet"), F.col("txid")) if incoming else (F.col("txid"), F.col("wallet"))
        return one.select(ends[0].alias("src"), ends[1].alias("dst"), F.lit("utxo").alias("type"), amount.alias("amount"), "ts")

    edges = side("input_addresses", "input_amounts", True).unionByName(side("output_addresses", "output_amounts", False))
    # The largest amount comes from the lists as they are: nothing is exploded for it.
    used = lambda amounts, addresses: F.array_max(F.slice(F.coalesce(amounts, F.array().cast("array<double>")), 1, F.greatest(F.size(addresses), F.lit(0))))
    most = F.greatest(F.max(used(F.col("input_amounts"), F.col("input_addresses"))), F.max(used(F.col("output_amounts"), F.col("output_addresses"))))
    return scaled_by_largest(edges, records.agg(most.alias("top")))


def scaled_by_largest(edges: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """Adds weight = amount / the largest amount of all edges (0 counts as 1), which ``top`` may give as one row."""
    top = edges.agg(F.max("amount").alias("top")) if top is None else top  # one row
    return edges.crossJoin(F.broadcast(top)).withColumn("weight", F.col("amount") / F.when(F.coalesce("top", F.lit(0.0)) == 0, 1.0).otherwise(F.col("top"))).drop("top")


def temporal_edges(records: DataFrame, wallet: str, ts: str, node: str, max_gap: int = 3600, scale: float = 300.0) -> DataFrame:
    """Edges between a wallet's consecutive records at most ``max_gap`` seconds apart, decaying with the gap."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = previous(records.select(wallet, ts, node), [wallet], [F.asc(ts), F.asc(node)], {"src": F.col(node), "then": micros}).withColumn("gap", (micros - F.col("then")) / 1e6)
    near = rows.where((F.col("gap") >= 0) & (F.col("gap") <= max_gap))
    return near.select("src", F.col(node).alias("dst"), F.lit("temporal").alias("type"), F.lit(0.0).alias("amount"), F.col(ts).alias("ts"), F.col("gap"), decay_weight(F.col("gap"), scale).alias("weight"))


def with_default_weight(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", F.coalesce("weight", default_weight(F.col("type"))))


def coinjoin_columns(n_in: Column, n_out: Column, outputs: Column, fee: Column, ratio: Column | None = None) -> tuple[Column, Column]:
    """(is_coinjoin, reason). Many equal outputs; a ratio in 0.4-0.7 with equal outputs; or over 5 in and 5 or more equal out.

    An explicit ratio in the band decides alone; else outputs over inputs, and, where that is outside the band, fee over
    the first output.
    """
    equal = within_one_percent(outputs)
    first = F.get(outputs, F.lit(0))
    by_count = F.when((n_in > 0) & (n_out > 0), n_out / n_in)
    candidate = F.when(by_count.between(0.4, 0.7), by_count).when((n_in > 0) & (first != 0), fee / first)
    joinmarket = F.coalesce(candidate.between(0.4, 0.7), F.lit(False)) & equal
    reason = F.when((n_in >= 20) & (n_out >= 20) & equal, "wasabi")
    if ratio is not None:
        reason = reason.when(ratio.between(0.4, 0.7), F.when(equal, F.lit("joinmarket")).otherwise(F.lit("")))
    reason = reason.when(joinmarket, "joinmarket").when((n_in > 5) & (n_out >= 5) & equal, "kappos").otherwise("")
    return reason != "", reason


def node_set(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends among ``keep``.id."""
    ids = keep.select("id").distinct()
    some = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return some.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def ordered_in_time(edges: DataFrame, times: DataFrame) -> DataFrame:
    """Edges whose source isn't later than their destination; ``times`` has id and step."""
    a = times.select(F.col("id").alias("src"), F.col("step").alias("src_step"))
    b = times.select(F.col("id").alias("dst"), F.col("step").alias("dst_step"))
    return edges.join(a, "src").join(b, "dst").where("src_step <= dst_step")


def simple_edges(edges: DataFrame) -> DataFrame:
    """Parallel edges merged, loops dropped."""
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))


def graph_page(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` nodes by id and the edges among them."""
    some = nodes.select("id").orderBy("id").limit(limit)
    return some, induced(edges, some)


def cospend_pairs(inputs: DataFrame, tx: str, wallet: str, rows: int | None = None) -> DataFrame:
    """Pairs of wallets that are inputs of one transaction, with the number of such transactions.

    A transaction gives all its pairs, as the measure is defined; see cospend_links for what components need. With the
    number of ``rows`` of the inputs, tasks are as many as these ask for.
    """
    n = rows or 0
    each = dealt(inputs.select(F.col(tx).alias("_t"), F.col(wallet).alias("_w")), n, "_t").distinct()
    a, b = each.withColumnRenamed("_w", "a"), each.withColumnRenamed("_w", "b")
    pairs = a.join(b, "_t").where("a < b").select("a", "b")
    return dealt(pairs, 3 * n, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_tx"))


def cospend_links(inputs: DataFrame, tx: str, wallet: str, rows: int | None = None) -> DataFrame:
    """Each transaction's inputs tied to its least one: as connected as all pairs, and linear in the inputs (``rows``)."""
    n = rows or 0
    each = dealt(inputs.select(F.col(tx).alias("_t"), F.col(wallet).alias("w")), n, "_t")
    least = each.groupBy("_t").agg(F.min("w").alias("first"))
    links = each.join(least, "_t").where("w <> first").select(F.col("w").alias("src"), F.col("first").alias("dst"))
    return dealt(links, n, "src", "dst").distinct()


def cospend_edges(inputs: DataFrame, mixing: DataFrame, tx: str, wallet: str, rows: int | None = None) -> DataFrame:
    """(src, dst, weight): wallets that are inputs of the same transactions, weighted by their number.

    The transactions in ``mixing`` (tx) are left out: that many wallets pay into one of them says nothing of their owners.
    """
    kept = inputs.join(mixing.select(F.col(tx)).distinct(), tx, "left_anti")
    return cospend_pairs(kept, tx, wallet, rows).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n_tx").cast("double").alias("weight"))


def supercluster_ratio(sizes: DataFrame, size: str = "n") -> DataFrame:
    return sizes.agg((F.max(size) / F.nullif(F.sum(size), F.lit(0))).alias("ratio"))


def guarded_communities(members: DataFrame, node: str = "id", community: str = "community", limit: float = 0.05) -> DataFrame:
    """The communities, or every node alone where the largest holds ``limit`` of all nodes or more."""
    sizes = members.groupBy(community).agg(F.count(F.lit(1)).alias("n"))
    ratio = supercluster_ratio(sizes)
    return members.crossJoin(F.broadcast(ratio)).select(node, F.when(F.col("ratio") >= limit, F.col(node)).otherwise(F.col(community)).alias(community))


def triangles(und: DataFrame, deg: DataFrame) -> DataFrame:
    """(a, b, c): each triangle of the undirected edges (a, b) once.

    Edges point from the end of lower degree to that of higher, so a hub has few edges out and makes few wedges.
    """
    d = deg.select("id", "degree")
    ends = und.join(d.withColumnsRenamed({"id": "a", "degree": "da"}), "a").join(d.withColumnsRenamed({"id": "b", "degree": "db"}), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    out = ends.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("t"))
    one, two = out.withColumnRenamed("t", "x"), out.withColumnRenamed("t", "y")
    wedges = one.join(two, "s").where("x < y")
    return wedges.join(und.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"]).select(F.col("s").alias("a"), F.col("x").alias("b"), F.col("y").alias("c"))


def summary(edges: DataFrame) -> DataFrame:
    """One row of the simple undirected graph: n, m, density, average degree, triangles, transitivity, the mean of the
    nodes' clustering, and the correlation of degrees along edges (0 where it isn't defined)."""
    und = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "undirected")
    deg = cut(degree(und.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "degrees")
    counts = deg.agg(F.count(F.lit(1)).alias("n"), (F.sum("degree") / 2).alias("m"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("wedges"))
    found = cut(triangles(und, deg), "triangles")
    at = found.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    local = deg.join(at, "id", "left").agg(
        (F.coalesce(F.sum("t"), F.lit(0)) / 3).cast("bigint").alias("triangles"),
        F.avg(F.when(F.col("degree") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)).alias("clustering"),
    )
    k = deg.select("id", F.col("degree").cast("double").alias("k"))
    along = und.join(k.withColumnsRenamed({"id": "a", "k": "x"}), "a").join(k.withColumnsRenamed({"id": "b", "k": "y"}), "b")
    both_ways = along.select("x", "y").unionByName(along.select(F.col("y").alias("x"), F.col("x").alias("y")))
    mixing = both_ways.agg(F.coalesce(F.nanvl(F.corr("x", "y"), F.lit(0.0)), F.lit(0.0)).alias("assortativity"))
    one = counts.crossJoin(local).crossJoin(mixing)  # a row each
    m, n = F.col("m"), F.col("n")
    return one.select(
        "n", m.cast("bigint").alias("m"), (2 * m / (n * (n - 1))).alias("density"), (2 * m / n).alias("average_degree"), "triangles",
        (3 * F.col("triangles") / F.col("wedges")).alias("transitivity"), "clustering", "assortativity",
    )


def summary_vector(one: DataFrame) -> DataFrame:
    """One row v0 to v6: a summary scaled for distances and held between 0 and 5. The divisors are fixed values."""
    parts = [
        F.col("n") / 1000, F.col("m") / 1000, F.col("density"), F.col("average_degree") / 10, F.col("clustering"),
        (F.col("assortativity") + 1) / 2, 3 * F.col("triangles") / F.col("n") / 10,
    ]
    return one.select(*[F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0)))).alias(f"v{i}") for i, c in enumerate(parts)])


def display_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with type, edges) of replayed records, as a viewer shows them: addresses, wallets and transactions."""
    lines, flows = p2p_edges(records), utxo_edges(records)
    ips = node_set(lines).withColumn("type", F.lit("ip"))
    txs = records.select(F.col("txid").alias("id")).distinct().withColumn("type", F.lit("txid"))
    wallets = node_set(flows).join(txs, "id", "left_anti").withColumn("type", F.lit("wallet"))
    return ips.unionByName(txs).unionByName(wallets), lines.unionByName(flows)


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The simple edges whose ends are both among ``nodes``.id."""
    return simple_edges(induced(edges, nodes))


def capped_edges(edges: DataFrame, limit: int) -> DataFrame:
    """The first edges by their ends, at most twice as many as a page has nodes."""
    return edges.orderBy("src", "dst").limit(2 * limit)


def with_fresh_communities(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(id, community) of all ``nodes``.id; one without a community gets a community of its own, named after it.

    A community is named after a member, so a node that is no member of any can't have the name of one.
    """
    return nodes.select("id").distinct().join(members, "id", "left").select("id", F.coalesce("community", "id").alias("community"))
