"""Geography of addresses: cache, lookup, enrichment, ranges, hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.scalars import geo_inconsistent, hash_int, haversine_km, ip_to_long, radius_km
from tallyflow.functions.scan import previous

#: A central point of each country that a map has one for.
CENTROIDS = {
    "US": (39.8, -98.5), "CN": (35.8, 104.0), "RU": (61.5, 105.0), "GB": (55.3, -3.4), "IN": (20.5, 79.0), "DE": (51.1657, 10.4515),
    "JP": (36.2, 138.2), "BR": (-14.2, -51.9), "FR": (46.2, 2.2), "CA": (56.1, -106.3), "AU": (-25.27, 133.77), "KR": (35.9, 127.76),
}
#: The countries of made-up addresses.
COUNTRIES = ("US", "CN", "RU", "DE", "JP", "GB", "IN", "BR", "CA", "AU", "FR", "KR", "NL", "SG", "TR", "NG", "ZA", "IR", "UA", "SE")
FIRST_NETWORK, NETWORKS = 1000, 499_001
#: Six in ten made-up ports are the first, the others even and odd.
PORTS = (8333, 18333, 9735)
GEO = ["country", "city", "asn", "lat", "lng", "radius"]


def centroid(country: Column) -> tuple[Column, Column]:
    lat = F.create_map(*[F.lit(x) for k, v in CENTROIDS.items() for x in (k, v[0])])
    lng = F.create_map(*[F.lit(x) for k, v in CENTROIDS.items() for x in (k, v[1])])
    name = F.upper(F.trim(country))
    return F.coalesce(lat[name], F.lit(0.0)), F.coalesce(lng[name], F.lit(0.0))


def made_up_country(key: Column) -> Column:
    """One of COUNTRIES by the hash of a key."""
    return F.get(F.array(*[F.lit(c) for c in COUNTRIES]), (hash_int(key) % len(COUNTRIES)).cast("int"))


def made_up_network(community: Column, txid: Column) -> Column:
    return (FIRST_NETWORK + hash_int(F.concat_ws(":", community, txid)) % NETWORKS).cast("bigint")


def made_up_port(txid: Column, role: str) -> Column:
    h = hash_int(F.concat_ws(":", txid, F.lit(role)))
    return F.when(h % 10 < 6, PORTS[0]).when(h % 2 == 0, PORTS[1]).otherwise(PORTS[2])


def stub(ip: Column) -> list[Column]:
    """A made-up but repeatable place for an address that no database knows."""
    names = F.array(*[F.lit(c) for c in CENTROIDS])
    country = F.get(names, (hash_int(ip, F.lit("country"), digits=8) % len(CENTROIDS)).cast("int"))
    lat, lng = centroid(country)
    return [country.alias("country"), F.lit("stub").alias("city"), (1000 + hash_int(ip, F.lit("asn"), digits=8) % 64000).alias("asn"), lat.alias("lat"), lng.alias("lng"), radius_km(ip).cast("double").alias("radius")]


def latest(cache: DataFrame, key: str = "ip", at: str = "fetched_at") -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in cache.columns if c != key]
    best = cache.groupBy(key).agg(F.max(F.struct(F.col(at).alias("_at"), *rest)).alias("b"))
    return best.select(key, *[F.col("b").getField(c).alias(c) for c in rest])


def upsert(cache: DataFrame, new: DataFrame, key: str = "ip", at: str = "fetched_at") -> DataFrame:
    return latest(cache.unionByName(new), key, at)


def refresh(cache: DataFrame, ips: DataFrame, now: Column) -> DataFrame:
    """The cache with a stub row for each of ``ips``.ip that it lacks."""
    misses = ips.select("ip").distinct().join(cache, "ip", "left_anti")
    return cache.unionByName(misses.select("ip", *stub(F.col("ip")), now.alias("fetched_at")))


def enrich(df: DataFrame, cache: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Six geo_ columns for each row; rows and repeats are kept."""
    side = cache.select(F.col("ip").alias("_ip"), *[F.col(c).alias(f"geo_{c}") for c in GEO])
    return df.join(side, df[ip] == side["_ip"], "left").drop("_ip")


def in_networks(df: DataFrame, networks: DataFrame, ip: str = "ip", bits: int = 16) -> DataFrame:
    """Each address with the narrowest network (start, end as text, and more columns) that holds it.

    Networks are spread over blocks of 2**(32 - bits) addresses, so the range join is an equi-join on the block.
    """
    size = 1 << (32 - bits)
    n = networks.select(ip_to_long(F.col("start")).alias("_a"), ip_to_long(F.col("end")).alias("_b"), "network")
    n = n.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor(F.col("_b") / size))))
    a = df.withColumn("_ip", ip_to_long(F.col(ip))).withColumn("_block", F.floor(F.col("_ip") / size))
    hits = a.join(n, "_block").where("_ip between _a and _b")
    best = hits.groupBy(ip).agg(F.min(F.struct((F.col("_b") - F.col("_a")).alias("w"), "network")).alias("best"))
    return df.join(best.select(ip, F.col("best.network").alias("network")), ip, "left")


def hops(df: DataFrame, key: str, order: list[str], asn: str, lat: str | None = None, lng: str | None = None, limit: float = 1000.0) -> DataFrame:
    """(key, hop_rate, n): the share of a key's consecutive rows whose network changes or that lie over ``limit`` km apart."""
    place = [F.col(c).alias(n) for n, c in (("asn", asn), ("lat", lat), ("lng", lng)) if c]
    rows = previous(df.select(key, *order, *[c for c in (asn, lat, lng) if c and c not in (key, *order)]), [key], [F.asc(c) for c in order], {"_before": F.struct(F.lit(1).alias("some"), *place)})
    b = F.col("_before")
    km = haversine_km(b["lat"], b["lng"], F.col(lat), F.col(lng)) if lat else F.lit(0.0)
    hop = F.when(b.isNotNull(), geo_inconsistent(b["asn"], F.col(asn), km, limit).cast("double"))
    return rows.groupBy(key).agg(F.coalesce(F.avg(hop), F.lit(0.0)).alias("hop_rate"), F.count(F.lit(1)).alias("n"))


def marker_point(lat: Column, lng: Column, country: Column) -> tuple[Column, Column]:
    """A point's own place, or its country's where it has none or the zero point."""
    own = lat.isNotNull() & lng.isNotNull() & ~((lat == 0) & (lng == 0))
    c = centroid(country)
    return F.when(own, lat).otherwise(c[0]), F.when(own, lng).otherwise(c[1])
