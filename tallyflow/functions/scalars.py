"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lng2) - F.radians(lng1)) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def geo_inconsistent(asn1: Column, asn2: Column, km: Column, limit: float = 1000.0) -> Column:
    return F.coalesce(asn1 != asn2, F.lit(False)) | F.coalesce(km > limit, F.lit(False))


def hash_int(*parts: Column, digits: int = 16) -> Column:
    """The first hex digits of a SHA-256 over the joined parts, as an unsigned number (decimal where it is wide)."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    number = F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10)
    return number.cast("decimal(20,0)") if digits > 15 else number.cast("bigint")


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts: the same on every run and partitioning."""
    return hash_int(*parts, digits=13) / F.lit(float(16**13))


def hash_normal(*parts: Column) -> Column:
    """A standard normal draw from a hash, by Box and Muller."""
    u = F.greatest(hash_unit(*parts, F.lit("u")), F.lit(1e-12))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * 3.141592653589793 * hash_unit(*parts, F.lit("v")))


def radius_km(ip: Column) -> Column:
    """A display hint between 50 and 300; never a predicate."""
    return 50 + hash_int(ip, digits=8) % 251


def private_ip(ip: Column) -> Column:
    p = F.split(ip, r"\.")
    a, b = F.get(p, F.lit(0)).try_cast("int"), F.get(p, F.lit(1)).try_cast("int")
    return F.coalesce((a == 10) | (a == 127) | ((a == 192) & (b == 168)) | ((a == 172) & b.between(16, 31)), F.lit(False))


def valid_ipv4(ip: Column) -> Column:
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.trim(ip).rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$")


def ip_to_long(ip: Column) -> Column:
    p = F.split(F.trim(ip), r"\.")
    part = lambda i: F.get(p, F.lit(i)).try_cast("bigint")
    return part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3)


def parse_instant(text: Column) -> Column:
    """ISO instants with Z or an offset; naive ones are UTC (the session's zone); null where it can't be read."""
    return F.try_to_timestamp(F.trim(text))


def coerce_integer(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^[0-9]+$"), F.trim(text).try_cast("bigint"))


def coerce_float(text: Column) -> Column:
    """Only text with a point or an exponent is a float here; a bare integer is not."""
    return F.when(F.trim(text).rlike(r"[.eE]"), F.trim(text).try_cast("double"))


def decay_weight(seconds: Column, scale: float = 300.0) -> Column:
    return F.exp(-F.abs(seconds) / scale)


def default_weight(kind: Column) -> Column:
    return F.when(kind == "p2p", 1.0).when(kind == "utxo", 0.5).when(kind == "temporal", 0.3)


def anomaly_probability(raw: Column) -> Column:
    return 1 / (1 + F.exp(raw))


def softmax_second(first: Column, second: Column) -> Column:
    return 1 / (1 + F.exp(first - second))


def fuse(a: Column, b: Column, weight: float = 0.4) -> Column:
    return weight * a + (1 - weight) * b


def hedge(a: Column, b: Column, fused: Column, delta: Column, least: float = 0.05) -> Column:
    """Where a second score moves the result by less than ``least``, the first one stands."""
    return F.when(delta < least, a).otherwise(fused)


def tier(p: Column) -> Column:
    return F.when(p > 0.90, "critical").when(p > 0.75, "high").when(p > 0.50, "medium").otherwise("low")


def display_tier(p: Column) -> Column:
    """The viewer's bounds include .75 and .50."""
    return F.when(p > 0.90, "critical").when(p >= 0.75, "high").when(p >= 0.50, "medium").otherwise("low")


def geo_tier(p: Column) -> Column:
    """The three tiers of a map's markers."""
    return F.when(p >= 0.8, "tier1").when(p >= 0.5, "tier2").otherwise("tier3")


def place_tier(country: Column, asn: Column) -> Column:
    """A tier by the hash of country and network, for markers without a score; a missing network is 0."""
    third = string_hash31(F.concat_ws("-", country, F.coalesce(asn.cast("string"), F.lit("0")))) % 3
    return F.when(third == 0, "tier1").when(third == 1, "tier2").otherwise("tier3")


def stretched(value: Column, low: Column, high: Column, least: float = 0.05) -> Column:
    """Values of a spread below ``least`` drawn out to 0.2 to 0.8 (0.5 where all are equal); others as they are."""
    spread = high - low
    return F.when(spread >= least, value).when(spread > 0, 0.2 + 0.6 * (value - low) / spread).otherwise(F.lit(0.5))


def string_hash31(text: Column) -> Column:
    """The 31-polynomial hash of a string's characters modulo 2**32."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)))


def node_size(degree: Column, p: Column) -> Column:
    return F.least(F.lit(64.0), F.greatest(F.lit(16.0), 24 + 6 * F.log1p(degree) + 20 * p))


def edge_width(weight: Column, amount: Column, n_edges: Column) -> Column:
    return F.when(n_edges > 500, 1.0).otherwise(1 + 1.5 * F.log1p(weight) + amount / 5)


def shorten(text: Column, head: int = 8, tail: int = 6) -> Column:
    return F.when(F.length(text) <= head + tail + 1, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("…"), F.substring(text, -tail, tail)))


def burst_bucket(seconds: Column) -> Column:
    return F.when(seconds < 300, "0-5m").when(seconds < 600, "5-10m").when(seconds < 1800, "10-30m").when(seconds < 3600, "30-60m").otherwise("60m+")


#: Fixed values of the heuristic score: the base, then what each sign adds.
SCORE_BASE, SCORE_FAN, SCORE_WIDE_FAN, SCORE_FEE, SCORE_PEEL, SCORE_SMALL = 0.15, 0.35, 0.2, 0.25, 0.15, 0.1


def heuristic_score(fan_in: Column, fan_out: Column, fee: Column, outputs_max: Column) -> Column:
    """Points for fan-in or fan-out, a high fee, a one-to-two payment and many small outputs; 0.01 to 0.99."""
    points = lambda sign, n: F.when(sign, n).otherwise(0.0)
    s = F.lit(SCORE_BASE) + points((fan_out >= 5) | (fan_in >= 5), SCORE_FAN) + points(fan_out >= 10, SCORE_WIDE_FAN)
    s = s + points(fee > 0.01, SCORE_FEE) + points((fan_in == 1) & (fan_out == 2), SCORE_PEEL) + points((fan_out >= 5) & (outputs_max < 1.0), SCORE_SMALL)
    return F.least(F.lit(0.99), F.greatest(F.lit(0.01), s))


#: Fixed value: the sentence that explains an alert.
EXPLANATION = "Wallet %s flagged: %s outputs <1 BTC in %s min, peers %s ASN %s — conf %.2f (%s+%s+%s)"


def explanation_text(addr: Column, fan_out: Column, burst: Column, countries: Column, hops: Column, p: Column, top: list[Column]) -> Column:
    """The sentence that explains an alert."""
    return F.format_string(
        EXPLANATION, addr, fan_out.cast("string"), burst.cast("string"), countries.cast("string"), hops.cast("string"), p, *top,
    )
