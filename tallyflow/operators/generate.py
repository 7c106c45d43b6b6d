"""Row sources: records with planted patterns, hash-seeded so that any partitioning gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.functions.scalars import hash_int, hash_normal, hash_unit
from tallyflow.functions.scan import previous
from tallyflow.operators.geo import COUNTRIES
from tallyflow.operators.iterative import longest_paths

#: Patterns with the mean and deviation of an input's logarithm (none for coinjoin), the bounds of an input
#: that is drawn evenly, the least and most inputs and outputs, and the bounds of the fee (of high_fee, shares of the inputs).
PATTERNS = {
    "normal": ((-0.8, 1.2), (0.001, 5.0), (1, 3), (1, 3), (0.00001, 0.001)),
    "peel": ((0.5, 0.6), (1.0, 5.0), (1, 1), (2, 2), (0.0001, 0.0001)),
    "mixer": ((0.2, 1.0), (0.1, 3.0), (5, 10), (1, 2), (0.0001, 0.002)),
    "coinjoin": (None, (0.0101, 0.0101), (22, 22), (22, 22), (0.0022, 0.0022)),
    "structuring": ((-1.0, 0.8), (0.5, 5.0), (1, 2), (5, 10), (0.00005, 0.0005)),
    "ransomware": ((1.1, 0.9), (2.0, 10.0), (1, 1), (10, 20), (0.0001, 0.001)),
    "bridge": ((0.7, 0.85), (0.5, 10.0), (1, 2), (1, 1), (0.0005, 0.005)),
    "high_fee": ((-0.3, 1.0), (0.1, 1.0), (1, 2), (1, 2), (0.05, 0.2)),
    "asn_hop": ((-0.6, 1.1), (0.01, 2.0), (1, 3), (1, 3), (0.00005, 0.001)),
}
#: The bounds of an amount by log-normal draw; a coinjoin's output, how far it varies, and its share of the fee.
LEAST, MOST = 0.001, 50.0
JOINED, JITTER, JOIN_FEE = 0.01, 0.0001, 0.0001
#: A peel's share of its input, the least high fee, the script types' shares.
PEEL, HIGH_FEE = (0.05, 0.15), 0.01
SCRIPT_SHARES = {"P2PKH": 0.25, "P2SH": 0.2, "P2WPKH": 0.4, "P2WSH": 0.1, "unknown": 0.05}
ILLICIT_SHARE = 0.04
FEE_SHARE, FEE_LEAST = 0.2, 1e-5


def injection_plan(df: DataFrame, key: str, share: float = ILLICIT_SHARE, seed: int = 42) -> DataFrame:
    """Adds ``label``: rows whose hash falls below the share get one of the eight patterns, in equal parts."""
    names = [k for k in PATTERNS if k != "normal"]
    u = hash_unit(F.lit(seed), F.col(key))
    at = F.floor(u / share * len(names)).cast("int")
    return df.withColumn("label", F.when(u < share, F.get(F.array(*[F.lit(n) for n in names]), at)).otherwise(F.lit("normal")))


def _of(label: Column, part: int, which: int) -> Column:
    """A number of PATTERNS by label."""
    return F.create_map(*[F.lit(x) for name, v in PATTERNS.items() for x in (name, (v[part] or PATTERNS["normal"][part])[which])])[label]


def pattern_sizes(label: Column, *seed: Column) -> tuple[Column, Column]:
    """(inputs, outputs): how many a record of a pattern has. A mixer has many of one side and few of the other, by a coin."""
    drawn = lambda part, name: (_of(label, part, 0) + hash_int(*seed, F.lit(name), digits=8) % (_of(label, part, 1) - _of(label, part, 0) + 1)).cast("int")
    n_in, n_out = drawn(2, "n_in"), drawn(3, "n_out")
    turned = (label == "mixer") & (hash_unit(*seed, F.lit("side")) >= 0.5)
    return F.when(turned, n_out).otherwise(n_in), F.when(turned, n_in).otherwise(n_out)


def _total(amounts: Column) -> Column:
    return F.round(F.aggregate(amounts, F.lit(0.0), lambda s, x: s + x), 8)


def with_amounts(df: DataFrame, label: str, *seed: Column, even: bool = False) -> DataFrame:
    """Adds input_amounts, output_amounts and fee by each row's label; inputs are outputs and fee, to 8 places.

    Inputs are log-normal between LEAST and MOST, or ``even`` between the pattern's bounds. The outputs share what the
    fee leaves: two of very unlike size in a peel, equal ones in a coinjoin, else at random.
    """
    k = F.col(label)
    n_in, n_out = pattern_sizes(k, *seed)
    normal = lambda i: F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.exp(_of(k, 0, 0) + _of(k, 0, 1) * hash_normal(*seed, F.lit("in"), i))))
    between = lambda low, high, *part: low + (high - low) * hash_unit(*seed, *part)
    draw = (lambda i: between(_of(k, 1, 0), _of(k, 1, 1), F.lit("in"), i)) if even else normal
    rows = df.withColumn("_n_in", n_in).withColumn("_n_out", n_out)
    joined = lambda i: F.round(F.lit(JOINED) + (0.0 if even else JITTER * (2 * hash_unit(*seed, F.lit("out"), i) - 1)), 8)
    rows = rows.withColumn("_joined", F.when(k == "coinjoin", F.transform(F.sequence(F.lit(1), "_n_out"), joined)))
    rows = rows.withColumn("input_amounts", F.when(k == "coinjoin", F.transform("_joined", lambda x: F.round(x + JOIN_FEE, 8))).otherwise(F.transform(F.sequence(F.lit(1), "_n_in"), lambda i: F.round(draw(i), 8))))
    rows = rows.withColumn("_total", _total(F.col("input_amounts")))
    drawn = between(_of(k, 4, 0), _of(k, 4, 1), F.lit("fee"))
    fee = capped_fee(F.col("_total"), F.when(k == "high_fee", F.greatest(F.lit(HIGH_FEE), F.col("_total") * drawn)).otherwise(drawn))
    rows = rows.withColumn("fee", F.when(k == "coinjoin", F.round(F.col("_total") - _total(F.col("_joined")), 8)).otherwise(fee))
    paid = F.round(F.col("_total") - F.col("fee"), 8)
    rows = rows.withColumn("_paid", paid)
    peel = F.round(F.col("_total") * between(F.lit(PEEL[0]), F.lit(PEEL[1]), F.lit("peel")), 8)
    outputs = F.when(k == "coinjoin", F.col("_joined")).when(k == "peel", F.array(peel, F.round(F.col("_paid") - peel, 8))).otherwise(split_amount(F.col("_paid"), F.col("_n_out"), *seed, F.lit("out")))
    return rows.withColumn("output_amounts", outputs).drop("_n_in", "_n_out", "_joined", "_total", "_paid")


def split_amount(total: Column, n: Column, *seed: Column) -> Column:
    """``n`` positive parts, rounded to 8 places, of which the last takes up the remainder."""
    weights = F.transform(F.sequence(F.lit(1), n), lambda i: 0.1 + hash_unit(*seed, i))
    whole = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    parts = F.transform(weights, lambda x: F.greatest(F.lit(1e-8), F.round(total * x / whole, 8)))
    head = F.slice(parts, 1, F.greatest(n - 1, F.lit(0)))
    rest = F.round(total - F.aggregate(head, F.lit(0.0), lambda s, x: s + x), 8)
    return F.concat(head, F.array(rest))


def capped_fee(total: Column, fee: Column) -> Column:
    return F.round(F.least(F.greatest(fee, F.lit(FEE_LEAST)), F.round(total * FEE_SHARE, 8)), 8)


def jittered(ts: Column, sigma: float, *seed: Column) -> Column:
    """An instant moved by N(0, sigma) seconds."""
    return F.timestamp_micros((F.unix_micros(ts) + hash_normal(*seed) * sigma * 1e6).cast("bigint"))


def records(spark: SparkSession, n: int, seed: int = 42, sigma: float = 30.0) -> DataFrame:
    """``n`` records of the contract plus ``label``; see records_for()."""
    return records_for(spark.range(n), "id", seed, sigma)


def records_for(rows: DataFrame, key: str, seed: int = 42, sigma: float = 30.0, even: bool = True) -> DataFrame:
    """A record of the contract, plus ``label``, for each of ``rows`` by its ``key``, a whole number. Amounts are conserved."""
    s, i = F.lit(seed), F.col("_i")
    base = injection_plan(rows.select(F.col(key).alias("_i")), "_i", seed=seed)
    base = with_amounts(base, "label", s, i, even=even)
    country = F.get(F.array(*[F.lit(c) for c in COUNTRIES]), (hash_int(s, F.lit("country"), i, digits=8) % len(COUNTRIES)).cast("int"))
    address = lambda side, k: F.concat(F.lit("bc1q"), F.substring(F.sha2(F.concat_ws("|", s, F.lit(side), F.floor(i / 3), k), 256), 1, 38))
    ip = lambda side: F.concat_ws(".", *[((hash_int(s, F.lit(f"{side}{k}"), i, digits=4) % 223) + 1).cast("string") for k in range(4)])
    moment = F.timestamp_micros((F.lit(1_704_067_200_000_000) + i * 60_000_000).cast("bigint"))
    port = lambda side: (8333 + hash_int(s, F.lit(f"{side}_port"), i, digits=8) % 10_001).cast("int")
    script, below = F.lit(None).cast("string"), 0.0
    for name, share in SCRIPT_SHARES.items():
        below += share
        script = F.coalesce(script, F.when(hash_unit(s, F.lit("script"), i) < below, name))
    addresses = lambda side, amounts: F.transform(amounts, lambda _, k: address(side, k + 1)).alias(f"{side}put_addresses")
    return base.select(
        jittered(moment, sigma, s, F.lit("time"), i).alias("timestamp"), ip("src").alias("src_ip"), ip("dst").alias("dst_ip"), port("src").alias("src_port"), port("dst").alias("dst_port"),
        F.sha2(F.concat_ws("|", s, F.lit("tx"), i), 256).alias("txid"), addresses("in", F.col("input_amounts")), addresses("out", F.col("output_amounts")), "input_amounts", "output_amounts", "fee",
        F.coalesce(script, F.lit("unknown")).alias("script_type"), country.alias("geo_country"), (1000 + hash_int(s, F.lit("asn"), i, digits=8) % 499_001).alias("geo_asn"), "label",
    )


def chain_edges(nodes: DataFrame, skip: float = 0.12, seed: int = 42) -> DataFrame:
    """A chain through nodes by ``step``, each joined to the next, and some to the one after."""
    order = [F.asc("step"), F.asc("id")]
    one = previous(nodes.select("chain", "step", "id"), ["chain"], order, {"one": F.col("id")})
    both = previous(one, ["chain"], order, {"two": F.col("one")})
    ones = both.where("one IS NOT NULL").select(F.col("one").alias("src"), F.col("id").alias("dst"))
    twos = both.where((F.col("two").isNotNull()) & (hash_unit(F.lit(seed), F.col("two")) < skip)).select(F.col("two").alias("src"), F.col("id").alias("dst"))
    return ones.unionByName(twos)


def dag_times(edges: DataFrame, rate: float, sigma: float, start: Column, seed: int = 42) -> DataFrame:
    """(id, timestamp) of the nodes of a graph without cycles: each its own wait after its latest predecessor.

    Waits are exponential with ``rate`` and have normal jitter of ``sigma`` seconds, a millisecond at least; a node
    without predecessors waits from ``start``.
    """
    wait = lambda c: F.greatest(F.lit(0.001), -F.ln(F.greatest(hash_unit(F.lit(seed), c), F.lit(1e-12))) / rate + hash_normal(F.lit(seed), c) * sigma)
    sources = edges.select(F.col("src").alias("id")).distinct()
    far = longest_paths(edges.select("src", "dst", wait(F.col("dst")).alias("length")), sources.select("id", wait(F.col("id")).alias("length")))
    return far.select("id", F.timestamp_micros((F.unix_micros(start) + F.col("dist") * 1e6).cast("bigint")).alias("timestamp"))


def address_pools(communities: DataFrame, low: int = 20, high: int = 800, countries: int = 8, seed: int = 42) -> DataFrame:
    """(community, entry, country, asn): each community's pool of addresses, ``low`` to ``high`` by its size.

    ``communities`` has community and n. Countries are dealt in turn from a hashed start, so a pool names at least
    ``countries`` of them; network numbers come from a range of the country's own.
    """
    names = list(COUNTRIES)
    size = F.least(F.lit(high), F.greatest(F.lit(low), F.col("n").cast("int")))
    slots = communities.select("community", F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
    start = hash_int(F.lit(seed), F.col("community"), digits=8)
    at = ((start + F.col("i")) % max(countries, len(names)) % len(names)).cast("int")
    octet = lambda k: (1 + hash_int(F.lit(seed), F.col("community"), F.col("i"), F.lit(k), digits=4) % 223).cast("string")
    asn = 1000 + at * 8000 + hash_int(F.lit(seed), F.col("community"), F.col("i"), F.lit("asn"), digits=8) % 8000
    return slots.select("community", F.concat_ws(".", *[octet(k) for k in range(4)]).alias("entry"), F.get(F.array(*[F.lit(n) for n in names]), at).alias("country"), asn.alias("asn"))


def anchored_records(edges: DataFrame, members: DataFrame, rate: float = 1 / 600, sigma: float = 30.0, start: str = "2024-01-01", seed: int = 42) -> DataFrame:
    """A record for each node of a sampled graph without cycles: its time after its predecessors', its addresses from its community's
    pool, its flows along the graph's edges, amounts conserved.

    ``members`` is (id, community).
    """
    times = dag_times(edges, rate, sigma, F.lit(start).cast("timestamp"), seed)
    planned = injection_plan(times, "id", seed=seed)
    pools = address_pools(members.groupBy("community").agg(F.count(F.lit(1)).alias("n")), seed=seed)
    n = pools.groupBy("community").agg(F.count(F.lit(1)).alias("pool"))
    numbered = pools.withColumn("slot", F.row_number().over(Window.partitionBy("community").orderBy("entry", "asn")) - 1)  # at most 800 a community
    key = lambda end: F.pmod(F.xxhash64(F.lit(seed), F.lit(end), "id"), F.col("pool"))
    placed = planned.join(members, "id").join(n, "community").withColumn("slot", key("src"))
    home = numbered.select("community", "slot", F.col("entry").alias("src_ip"), F.col("country").alias("geo_country"), F.col("asn").alias("geo_asn"))
    away = numbered.select("community", "slot", F.col("entry").alias("dst_ip"))
    placed = placed.join(home, ["community", "slot"]).withColumn("slot", key("dst")).join(away, ["community", "slot"]).drop("slot", "pool")
    came = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    went = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_out"))
    sized = placed.join(came, "id", "left").join(went, "id", "left").withColumn("n_in", F.greatest(F.coalesce("n_in", F.lit(1)), F.lit(1)).cast("int")).withColumn("n_out", F.greatest(F.coalesce("n_out", F.lit(1)), F.lit(1)).cast("int"))
    k = F.col("label")
    s, i = F.lit(seed), F.col("id")
    total = F.round(F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.exp(_of(k, 0, 0) + _of(k, 0, 1) * hash_normal(s, F.lit("amount"), i)))) * F.greatest("n_in", "n_out"), 8)
    paid = sized.withColumn("total", total).withColumn("fee", capped_fee(F.col("total"), F.col("total") * 0.01 * hash_unit(s, F.lit("fee"), i)))
    wallet = lambda side, k: F.concat(F.lit("bc1q"), F.substring(F.sha2(F.concat_ws("|", s, F.lit(side), i, k), 256), 1, 38))
    return paid.select(
        "timestamp", "src_ip", "dst_ip", F.lit(8333).alias("src_port"), F.lit(8333).alias("dst_port"), F.sha2(F.concat_ws("|", s, F.lit("tx"), i), 256).alias("txid"),
        F.transform(F.sequence(F.lit(1), "n_in"), lambda k: wallet("in", k)).alias("input_addresses"), F.transform(F.sequence(F.lit(1), "n_out"), lambda k: wallet("out", k)).alias("output_addresses"),
        split_amount(F.col("total"), F.col("n_in"), s, F.lit("in"), i).alias("input_amounts"), split_amount(F.col("total") - F.col("fee"), F.col("n_out"), s, F.lit("out"), i).alias("output_amounts"),
        "fee", F.lit("P2WPKH").alias("script_type"), "geo_country", "geo_asn", "label", i.alias("node"),
    )
