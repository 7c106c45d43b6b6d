"""The sweep over time jitter, worked out again in plain Python."""

import hashlib
import math

import pytest

from tallyflow.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def unit(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 16**13


def normal(*parts):
    return math.sqrt(-2 * math.log(max(unit(*parts, "u"), 1e-12))) * math.cos(2 * math.pi * unit(*parts, "v"))


def average_precision(rows):
    """Equal scores together, from the highest down."""
    pos, tp, n, out = sum(y for _, y in rows), 0, 0, 0.0
    for p in sorted({p for p, _ in rows}, reverse=True):
        here = [y for q, y in rows if q == p]
        tp, n = tp + sum(here), n + len(here)
        out += sum(here) / pos * tp / n
    return out


def test_sigma_sweep(spark):
    import datetime

    lines = spark.read.parquet(f"{SF}/lineitem.parquet").collect()
    got = {r.sigma: r.average_precision for r in QUERIES["m12_sigma_sweep"](spark, SF).collect()}
    assert sorted(got) == [5.0, 30.0, 120.0]
    for sigma, found in got.items():
        rows = []
        for r in lines:
            key = r.l_orderkey * 100 + r.l_linenumber
            p = round(min(1.0, (float(r.l_quantity) / 50 + float(r.l_discount) * 5 + (0.3 if r.l_returnflag == "R" else 0.0)) / 2), 4)
            day = r.l_shipdate if isinstance(r.l_shipdate, datetime.datetime) else datetime.datetime.combine(r.l_shipdate, datetime.time())
            at = int((day.replace(tzinfo=datetime.UTC) - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)).total_seconds()) * 10**6
            rows.append((int(at + normal(key, sigma) * sigma * 86400 * 1e6), key, p, int(r.l_returnflag == "R")))
        rows.sort()
        late = [(p, y) for _, _, p, y in rows[math.floor(len(rows) * 0.7) :]]
        assert found == pytest.approx(average_precision(late), abs=2e-4)
