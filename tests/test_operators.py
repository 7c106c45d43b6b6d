"""Operators against truth tables, brute force and round trips."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyflow.functions import aggregates, scalars
from tallyflow.operators import alerts, features, generate, geo, graph, iterative, labelled, metrics, models, serving
from tallyflow.sources import files, records
from tallyflow.streaming import streams


def value(spark, column, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<double>").alias(k) for k, v in cols.items()])
    return row.select(column.alias("v")).first()[0]


COINJOINS = [
    (22, [0.01] * 22, 0.1, "wasabi"),
    (22, [0.01, 0.01005] * 11, 0.1, "wasabi"),
    (5, [0.01] * 5, 0.0, ""),
    (10, [0.01] * 10, 0.0, "kappos"),
    (10, [0.01 * (i + 1) for i in range(10)], 0.0, ""),
    (4, [0.5, 0.5], 0.0, "joinmarket"),
    (3, [1.0, 1.0, 1.0], 0.5, "joinmarket"),
]


@pytest.mark.parametrize(("n_in", "outs", "fee", "reason"), COINJOINS)
def test_coinjoin(spark, n_in, outs, fee, reason):
    flag, why = graph.coinjoin_columns(F.col("i"), F.size("o"), F.col("o"), F.col("f"))
    assert value(spark, why, i=n_in, o=outs, f=fee) == reason
    assert value(spark, flag, i=n_in, o=outs, f=fee) is (reason != "")


def test_explicit_ratio_decides(spark):
    _, why = graph.coinjoin_columns(F.col("i"), F.size("o"), F.col("o"), F.lit(0.0), F.col("r"))
    assert value(spark, why, i=10, o=[1.0] * 10, r=0.5) == "joinmarket"
    assert value(spark, why, i=10, o=[1.0, 2.0], r=0.5) == ""
    assert value(spark, why, i=10, o=[1.0] * 10, r=0.9) == "kappos"


def test_scalars(spark):
    assert value(spark, scalars.decay_weight(F.col("t")), t=600.0) == pytest.approx(math.exp(-2))
    assert value(spark, scalars.fuse(F.col("a"), F.col("b")), a=0.6, b=0.8) == pytest.approx(0.72)
    assert [value(spark, scalars.tier(F.col("p")), p=p) for p in (0.95, 0.90, 0.75, 0.50)] == ["critical", "high", "medium", "low"]
    assert [value(spark, scalars.display_tier(F.col("p")), p=p) for p in (0.75, 0.5)] == ["high", "medium"]
    assert [value(spark, scalars.private_ip(F.col("i")), i=i) for i in ("10.1.1.1", "172.31.0.1", "172.32.0.1", "8.8.8.8", "x")] == [True, True, False, False, False]
    assert [value(spark, scalars.valid_ipv4(F.col("i")), i=i) for i in (" 1.2.3.4 ", "01.2.3.4", "1.2.3", "256.1.1.1")] == [True, False, False, False]
    # The general formula; no pair of cities is special.
    assert value(spark, scalars.haversine_km(F.lit(37.77), F.lit(-122.42), F.lit(55.75), F.lit(37.62))) == pytest.approx(9450, rel=0.01)


@pytest.mark.parametrize("xs", [[], [3.0], [1.0, 1.0, 5.0], [0.2, 7.0, 3.0, 3.0]])
def test_array_aggregates(spark, xs):
    n = len(xs)
    mean = sum(xs) / n if n else 0
    assert value(spark, aggregates.array_var_pop(F.col("x")), x=xs) == pytest.approx(sum((x - mean) ** 2 for x in xs) / n if n > 1 else 0)
    s = sorted(xs)
    assert value(spark, aggregates.array_median(F.col("x")), x=xs) == pytest.approx((s[(n - 1) // 2] + s[n // 2]) / 2 if n else 0)
    gini = 2 * sum((i + 1) * x for i, x in enumerate(s)) / (n * sum(s)) - (n + 1) / n if n > 1 else 0
    assert value(spark, aggregates.array_gini(F.col("x")), x=xs) == pytest.approx(gini)


def raw_rows():
    good = {
        "timestamp": "2024-01-01T00:00:00Z", "src_ip": "192.168.1.10", "dst_ip": "10.0.0.5", "src_port": "8333", "dst_port": "8334", "txid": "a" * 64,
        "input_addresses": '["w1"]', "output_addresses": '["w2"]', "input_amounts": "[0.5, 1.2]", "output_amounts": "[1.6]", "fee": "0.1", "script_type": "P2PKH", "geo_country": "US", "geo_asn": "15169",
    }
    bad = {"src_port": "x", "dst_port": "70000", "txid": "short", "src_ip": "1.2.3", "script_type": "P2PK", "fee": "1", "geo_asn": "AS1", "timestamp": "never", "input_amounts": "[1,"}
    return good, [good | {k: v} for k, v in bad.items()], list(bad)


def test_validation_splits(spark):
    good, bad, names = raw_rows()
    df = spark.createDataFrame([good | {"extra": "dropped"}, *[b | {"extra": ""} for b in bad]])
    clean, out = records.split(df)
    assert clean.count() == 1 and clean.columns == records.COLUMNS
    assert dict(clean.dtypes) == {f.name: f.dataType.simpleString() for f in records.RECORD}
    errors = [r.error for r in out.collect()]
    assert out.columns == ["file", "row", "error", "raw"] and len(errors) == len(bad)
    assert all(any(e.startswith(n) for e in errors) for n in names)


@pytest.mark.parametrize("kind", ["csv", "json", "xml"])
def test_files_round_trip(spark, tmp_path, kind):
    made = generate.records(spark, 40).drop("label")
    files.write_records(made.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).coalesce(1), f"{tmp_path}/in", kind)
    done = files.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/clean", f"{tmp_path}/bad", kind)
    assert done == {"clean": 40, "quarantined": 0}
    back = files.read_parquet(spark, f"{tmp_path}/clean")
    assert sorted(r.txid for r in back.collect()) == sorted(r.txid for r in made.collect())
    assert back.select(F.sum(F.size("output_amounts"))).first()[0] == made.select(F.sum(F.size("output_amounts"))).first()[0]


@pytest.mark.parametrize(("text", "name", "kind"), [("a,b\n1,2\n", "x.csv", "csv"), ('[{"a":1}]', "x.dat", "json"), ("﻿<?xml version='1.0'?><records/>", "x.dat", "xml"), ("", "y.json", "json"), ("", "y.bin", "csv")])
def test_detect_format(spark, tmp_path, text, name, kind):
    p = tmp_path / name
    p.write_text(text)
    assert files.detect_format(spark, str(p)) == kind


def test_json_shapes(spark, tmp_path):
    row = '{"txid": "t", "fee": 0.5, "input_amounts": [1.0, 2.0]}'
    other = f'{{"total": 2, "items": [{row}, {row}], "more": []}}'
    shapes = [f"[{row}, {row}]", f'{{"records": [{row}]}}', f'{{"data": [{row}]}}', row, f"{row}\n{row}\n", other, f'{{"one": {row}}}', ""]
    counts = []
    for i, s in enumerate(shapes):
        (tmp_path / f"{i}.json").write_text(s)
        rows = files.read_json(spark, str(tmp_path / f"{i}.json")).collect()
        assert all(r.txid == "t" and r.fee == "0.5" for r in rows)
        counts.append(len(rows))
    assert counts == [2, 1, 1, 1, 2, 2, 1, 0]


def test_folder_and_quarantine(spark, tmp_path):
    good, bad, _ = raw_rows()
    spark.createDataFrame([good, bad[0]]).coalesce(1).write.csv(f"{tmp_path}/d", header=True, quote='"', escape='"')
    (tmp_path / "in").mkdir()
    part = next((tmp_path / "d").glob("part-*.csv"))
    (tmp_path / "in" / "a.csv").write_text(part.read_text())
    assert files.ingest_folder(spark, f"{tmp_path}/in", f"{tmp_path}/clean", f"{tmp_path}/q") == {"clean": 1, "quarantined": 1}
    q = files.read_quarantine(spark, f"{tmp_path}/q")
    assert serving.validation_report(q, "a.csv").count() == 1 and serving.validation_report(q, "b.csv").count() == 0
    with pytest.raises(ValueError, match="clean zone"):
        files.guard_output("/data/clean/x", "/data/clean")


def test_checksums(spark, tmp_path):
    import hashlib

    (tmp_path / "f.bin").write_bytes(b"abc")
    known = spark.createDataFrame([("f.bin", hashlib.sha256(b"abc").hexdigest())], "name string, sha256 string")
    assert files.verify_checksums(spark, str(tmp_path / "f.bin"), known).first().ok


def test_stream_ingest_reads_each_file_once(spark, tmp_path):
    good, bad, _ = raw_rows()
    for i in range(2):
        spark.createDataFrame([good, bad[1]]).select(*records.COLUMNS).coalesce(1).write.csv(f"{tmp_path}/d{i}", header=True, quote='"', escape='"')
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.csv").write_text(next((tmp_path / f"d{i}").glob("part-*.csv")).read_text())
        streams.ingest(streams.watch_csv(spark, f"{tmp_path}/in"), f"{tmp_path}/clean", f"{tmp_path}/bad", f"{tmp_path}/cp").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/clean").count() == i + 1
        assert {p.name for p in (tmp_path / "clean").glob("stream=*/batch=*")} == {f"batch={k}" for k in range(i + 1)}
        assert files.read_quarantine(spark, f"{tmp_path}/bad").count() == i + 1


def test_block_ticker(spark):
    q = streams.block_ticker(spark, 100, 50).writeStream.format("memory").queryName("ticks").start()
    try:
        for _ in range(40):
            q.processAllAvailable()
            rows = spark.sql("SELECT * FROM ticks ORDER BY height").collect()
            if len(rows) > 2:
                break
        assert [r.height for r in rows] == list(range(100, 100 + len(rows)))
        assert (rows[1].block_time - rows[0].block_time).total_seconds() == 600
    finally:
        q.stop()


def random_graph(seed, n, m):
    rng = random.Random(seed)
    return sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_levels(spark, seed):
    pairs = random_graph(seed, 60, 45)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    df = spark.createDataFrame(pairs, "src int, dst int")

    def reach(a):
        seen, todo = {a: 0}, [a]
        for x in todo:
            for y in near[x]:
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        return seen

    assert {r.id: r.component for r in iterative.connected_components(df).collect()} == {a: min(reach(a)) for a in near}
    s = pairs[0][0]
    assert {r.id: r.level for r in iterative.bfs_levels(df, spark.createDataFrame([(s,)], "id int")).collect()} == reach(s)


def test_long_chain_component(spark):
    df = spark.range(70).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert [r.component for r in iterative.connected_components(df).select("component").distinct().collect()] == [0]


def test_betweenness(spark):
    pairs = random_graph(3, 14, 24)
    nodes = sorted({x for p in pairs for x in p})
    near = {a: [y for p in pairs for x, y in (p, p[::-1]) if x == a] for a in nodes}
    want = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, paths, order = {s: 0}, {s: 1}, [s]
        for x in order:
            for y in near[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    paths[y] = 0
                    order.append(y)
                if dist[y] == dist[x] + 1:
                    paths[y] += paths[x]
        owed = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in near[y]:
                if dist[x] == dist[y] - 1:
                    owed[x] += paths[x] / paths[y] * (1 + owed[y])
            if y != s:
                want[y] += owed[y] / 2
    df = spark.createDataFrame(pairs, "src int, dst int")
    got = {r.id: r.betweenness for r in iterative.betweenness(df, graph.node_set(df)).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_searches_go_to_the_end_of_long_paths(spark):
    line = lambda n: spark.createDataFrame([(i, i + 1) for i in range(n)], "src int, dst int")
    first = spark.createDataFrame([(0,)], "id int")
    assert {r.id: r.level for r in iterative.bfs_levels(line(53), first).collect()} == {i: i for i in range(54)}
    got = {r.id: r.betweenness for r in iterative.betweenness(line(33), first).collect()}
    assert got == {0: 0.0, **{i: (33 - i) / 2 for i in range(1, 34)}}
    assert iterative.bfs_levels(line(9), first, 3).count() == 4
    assert {r.id: r.level for r in iterative.dag_levels(line(45)).collect()} == {i: i for i in range(46)}


def test_communities_of_two_cliques(spark):
    pairs = [(a, b) for g in (range(6), range(10, 16)) for a in g for b in g if a < b] + [(0, 10)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src int, dst int, weight double")
    c = iterative.modularity_communities(df)
    found = {r.id: r.community for r in c.collect()}
    assert len({found[i] for i in range(6)}) == 1 and len({found[i] for i in range(10, 16)}) == 1 and found[1] != found[11]
    assert iterative.modularity(df, c).first()[0] == pytest.approx(15 / 31 * 2 - 2 * (31 / 62) ** 2)


def test_dag_levels_find_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src int, dst int")
    levels = iterative.dag_levels(df)
    assert {r.id: r.level for r in levels.collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    with pytest.raises(ValueError, match="cycle"):
        iterative.dag_levels(df.unionByName(spark.createDataFrame([(4, 1)], "src int, dst int")))
    t = {r.id: r.timestamp for r in generate.dag_times(df, 1 / 600, 30.0, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert t[1] < t[2] < t[3] < t[4]


def test_cycles_are_broken_by_one_edge_each(spark):
    rng = random.Random(8)
    rings = [(i, (i + 1) % 5) for i in range(5)] + [(10 + i, 10 + (i + 1) % 3) for i in range(3)] + [(20, 20), (4, 10), (12, 30), (30, 31)]
    kept = {(r.src, r.dst) for r in iterative.without_cycles(spark.createDataFrame(rings, "src int, dst int")).collect()}
    assert len(kept) == len(rings) - 3 and {(4, 10), (12, 30), (30, 31)} <= kept
    mixed = sorted({(rng.randrange(25), rng.randrange(25)) for _ in range(60)})
    df = spark.createDataFrame(mixed, "src int, dst int")
    left = iterative.without_cycles(df)
    assert iterative.dag_levels(left).count() > 0  # raises where a cycle is left
    assert len(left.collect()) > 0.6 * len(mixed)


def test_samples_are_filled_and_repaired(spark):
    edges = [(i, i + 1) for i in range(6)] + [(10 + i, 11 + i) for i in range(3)] + [(20, 21), (30, 31), (40, 41)] + [(6, 50), (13, 51)]
    df = spark.createDataFrame(edges, "src int, dst int")
    seeds = spark.createDataFrame([(0,)], "id int")
    near = {r.id for r in iterative.bfs_sample(df, seeds, 5).collect()}
    assert near == {0, 1, 2, 3, 4} and iterative.bfs_sample(df, seeds, 12).count() == 12 and iterative.bfs_sample(df, seeds, 100).count() == 19
    sample = spark.createDataFrame([(i,) for i in (*range(7), *range(10, 14), 20, 21, 30, 40)], "id int")
    fixed = {r.id for r in iterative.repaired_sample(df, sample).collect()}
    assert len(fixed) == 15 and {*range(7), *range(10, 14), 20, 21, 50, 51} == fixed


def test_graph_network_forward_pass(spark):
    pairs = random_graph(5, 12, 20)
    nodes = sorted({x for p in pairs for x in p})
    rng = np.random.default_rng(2)
    x = rng.normal(size=(len(nodes), 5))
    layers = [(rng.normal(size=(a, b)), rng.normal(size=b)) for a, b in ((5, 7), (7, 4), (4, 2))]
    a = np.eye(len(nodes))
    for p, q in pairs:
        a[nodes.index(p), nodes.index(q)] = a[nodes.index(q), nodes.index(p)] = 1
    d = 1 / np.sqrt(a.sum(axis=1))
    want = x
    for i, (w, b) in enumerate(layers):
        want = (a * d[:, None] * d[None]) @ (want @ w) + b
        want = want if i == 2 else np.maximum(want, 0)
    df = spark.createDataFrame([(n, v.tolist()) for n, v in zip(nodes, x, strict=True)], "id int, x array<double>")
    got = {r.id: r.x for r in iterative.graph_network(spark.createDataFrame(pairs, "src int, dst int"), df, [(w.tolist(), b.tolist()) for w, b in layers]).collect()}
    assert np.allclose([got[n] for n in nodes], want)


def test_graph_is_stored_and_read_by_type(spark, tmp_path):
    made = generate.records(spark, 30)
    nodes, edges = graph.display_graph(made)
    serving.store_graph(nodes, edges, str(tmp_path))
    n, e = serving.read_graph(spark, str(tmp_path), ["p2p"])
    assert n.count() == nodes.count() and e.count() == 30 and {r.type for r in n.select("type").distinct().collect()} == {"ip", "wallet", "txid"}
    assert serving.read_graph(spark, str(tmp_path))[1].count() == edges.count()


def test_ranges_on_skewed_rows(spark):
    """All scores equal, one class, many ties at the cut: ranks and shares are exact."""
    from tallyflow.functions import ranges

    tied = spark.range(1000).select("id", F.lit(0.5).alias("p"), F.lit(1).alias("y")).repartition(5)
    assert [r["rank"] for r in serving.ranked(tied, "p", "id").orderBy("id").collect()] == list(range(1, 1001))
    assert {r.id for r in models.pseudo_labels(tied.drop("y"), "p", "id", 0.1).where("y = 1").collect()} == set(range(100))
    split = metrics.stratified_split(tied, "y", "id")
    assert split.where("part = 'train'").count() == 700 and metrics.random_split(tied, "id").where("part = 'train'").count() == 700
    assert sorted(r.id for r in metrics.temporal_split(tied, "p", "id").where("part = 'test'").collect()) == list(range(700, 1000))
    mixed = spark.range(500).select(F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") * 37) % 101).cast("double").alias("v"))
    values = sorted(r.v for r in mixed.collect() if r.v is not None)
    for level in (0.0, 0.3, 0.5, 0.95, 1.0):
        assert ranges.percentile(mixed, "v", level, "q").first()[0] == pytest.approx(np.quantile(values, level))
    assert ranges.percentile(mixed.where("v < 0"), "v", 0.5, "q").first()[0] is None
    assert serving.ranked(tied.where("id < 0"), "p", "id").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one partition
    parts = ranges.placed(tied, [F.asc("p"), F.asc("id")])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts.groupBy("_part").count().agg(F.max("count")).first()[0] < 800  # ties don't make one task


def test_series_across_days_is_that_of_all_rows(spark):
    rng = random.Random(4)
    rows = []
    for k in range(6):
        t = 0
        for _ in range(rng.randrange(1, 60)):
            t += rng.choice([0, 1, 60, 299, 300, 301, 3600, 3599, 40_000, 86_400, 300_000])
            rows.append((k, len(rows), t, rng.randrange(3), rng.choice([10.0, 10.1, 40.0]), 5.0))
    df = spark.createDataFrame(rows, "k int, i bigint, t bigint, asn bigint, lat double, lng double").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.k: r for r in features.series_features(df, "k", "ts", "i", "asn", "lat", "lng").collect()}
    near = {r.i: (r.a, r.b) for r in features.burst_counts(df.select("k", "i", "ts"), "k", "ts", {"a": 300, "b": 3600}).collect()}
    for k in range(6):
        mine = sorted((t, i, asn, lat) for kk, i, t, asn, lat, _ in rows if kk == k)
        gaps = [b[0] - a[0] for a, b in zip(mine, mine[1:], strict=False)]
        hops = [a[2] != b[2] or abs(a[3] - b[3]) > 9 for a, b in zip(mine, mine[1:], strict=False)]
        assert got[k].n == len(mine) and got[k].uptime_hours == pytest.approx((mine[-1][0] - mine[0][0]) / 3600)
        assert got[k].interval_std == pytest.approx(np.std(gaps) if len(gaps) > 1 else 0) and got[k].hop_rate == pytest.approx(np.mean(hops) if hops else 0)
        for t, i, *_ in mine:
            assert near[i] == tuple(sum(abs(u[0] - t) <= s for u in mine) for s in (300, 3600))


def test_union_sizes_and_output_ages(spark):
    rng = random.Random(9)
    a, b = ([(k, rng.randrange(2), f"v{rng.randrange(8)}") for k in range(5) for _ in range(rng.randrange(12))] for _ in range(2))
    pairs = [(x, y) for x in range(6) for y in range(6)]
    kind = "key int, kind int, value string"
    got = {(r.x, r.y, r.kind): r["size"] for r in features.union_sizes(spark.createDataFrame(pairs, "x int, y int"), spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)).collect()}
    assert got == {(x, y, k): len({v for key, kk, v in a if key == x and kk == k} | {v for key, kk, v in b if key == y and kk == k}) for x, y in pairs for k in range(2)}
    day = 86_400
    rows = [("t1", 0, "w1", ["w2"]), ("t2", 600, "w2", ["w1", "w3"]), ("t3", 600, "w1", ["w1"]), ("t4", 5 * day, "w1", []), ("t5", 5 * day + 60, "w2", ["w9"])]
    df = spark.createDataFrame(rows, "txid string, t bigint, wallet string, output_addresses array<string>").withColumn("ts", F.timestamp_seconds("t"))
    assert {r.txid: r.age for r in features.output_ages(df).collect()} == {"t2": 1.0, "t4": (5 * day - 600) / 600, "t5": (5 * day + 60) / 600}


def test_anchored_records_follow_the_graph(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], "src int, dst int")
    members = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "id int, community int")
    made = {r.node: r for r in generate.anchored_records(edges, members).collect()}
    assert len(made) == 5 and all(made[a].timestamp < made[b].timestamp for a, b in ((1, 2), (1, 3), (2, 4), (3, 4), (4, 5)))
    assert len(made[4].input_amounts) == 2 and len(made[1].output_amounts) == 2
    assert all(abs(sum(r.input_amounts) - sum(r.output_amounts) - r.fee) < 1e-7 for r in made.values())


def test_stream_of_all_kinds_is_not_doubled_by_a_retry(spark, tmp_path):
    made = generate.records(spark, 12).drop("label").withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    (tmp_path / "in").mkdir()
    for kind in files.EXTENSIONS:
        files.write_records(made.coalesce(1), f"{tmp_path}/{kind}", kind)
        part = next(p for p in (tmp_path / kind).iterdir() if p.name.startswith("part-"))
        (tmp_path / "in" / f"a.{kind}").write_text(part.read_text())
    run = lambda checkpoint: streams.ingest_files(streams.watch_files(spark, f"{tmp_path}/in"), f"{tmp_path}/clean", f"{tmp_path}/bad", f"{tmp_path}/{checkpoint}").awaitTermination()
    run("one")
    assert spark.read.parquet(f"{tmp_path}/clean").count() == 36
    for p in (tmp_path / "one" / "commits").glob("*0*"):
        p.unlink()  # as after a batch whose end was not recorded: the same batch again
    run("one")
    assert spark.read.parquet(f"{tmp_path}/clean").count() == 36 and spark.read.parquet(f"{tmp_path}/clean").select("txid").distinct().count() == 12


def test_streams_into_one_folder_keep_all_rows(spark, tmp_path):
    good, bad, _ = raw_rows()
    for name in "ab":
        spark.createDataFrame([good, bad[1]]).select(*records.COLUMNS).coalesce(1).write.csv(f"{tmp_path}/{name}", header=True, quote='"', escape='"')
    run = lambda folder, checkpoint: streams.ingest(streams.watch_csv(spark, f"{tmp_path}/{folder}"), f"{tmp_path}/clean", f"{tmp_path}/bad", f"{tmp_path}/{checkpoint}").awaitTermination()
    counts = []
    for folder, checkpoint in (("a", "one"), ("b", "two"), ("b", "two"), ("a", "renewed")):
        run(folder, checkpoint)
        counts.append((spark.read.parquet(f"{tmp_path}/clean").count(), files.read_quarantine(spark, f"{tmp_path}/bad").count()))
    assert counts == [(1, 1), (2, 2), (2, 2), (3, 3)]


def test_evidence_bundles(spark):
    made = generate.records(spark, 60)
    table = features.features(made)
    forest = models.fit_forest(table, list(features.FEATURES), "txid", trees=20)
    found = alerts.infer(made, forest, table=table)
    lines = made.select(F.get("input_addresses", F.lit(0)).alias("wallet"), "timestamp", F.aggregate("input_amounts", F.lit(0.0), lambda s, x: s + x).alias("amount"), F.col("geo_country").alias("country"), F.lit(120.0).alias("radius"))
    bundles = serving.evidence(found, forest.attribute(table, "txid", 38), lines, text=alerts.explain(found, table, forest)).cache()
    rows = bundles.collect()
    assert len(rows) == 60 and all(len(r["values"]) == 38 and len(r.top) == 3 and r.text and r.inaccurate for r in rows)
    assert all(len(r.amount_flow) == len(r.geo_timeline) == r.n_records and r.amount_flow == sorted(r.amount_flow) for r in rows)
    one = rows[0].txid
    assert serving.find_evidence(bundles, one).count() == 1 and serving.find_evidence(bundles, "0" * 64).count() == 0
    with pytest.raises(ValueError, match="no id"):
        serving.find_evidence(bundles, "xyz")
    assert serving.selected(found, one).first().txid == one and serving.selected(found, "ranked:2").first()["rank"] == 3
    short = serving.evidence(found, forest.attribute(table, "txid", 3), lines, kept=1).collect()
    assert all(len(r.amount_flow) == 1 and r.amount_flow[0].timestamp == r.last_seen for r in short)


def test_guarded_communities(spark):
    m = spark.createDataFrame([(i, i // 30) for i in range(100)], "id int, community int")
    assert graph.guarded_communities(m).select("community").distinct().count() == 100
    assert graph.guarded_communities(m, limit=0.5).select("community").distinct().count() == 4


def test_features_of_a_small_fixture(spark):
    made = generate.records(spark, 300)
    f = features.features(made.drop("label"), padded=False)
    assert f.columns == ["txid", *features.FEATURES] and len(features.FEATURES) == 38
    rows = {r.txid: r for r in f.collect()}
    by_wallet: dict = {}
    for r in made.collect():
        for a in r.input_addresses:
            by_wallet.setdefault(a, []).append(r)
    assert len(rows) == 300
    for r in made.collect():
        got = rows[r.txid]
        mine = by_wallet[r.input_addresses[0]]
        times = sorted(x.timestamp for x in mine)
        assert got.fan_in == len(r.input_addresses) and got.fan_out == len(r.output_addresses)
        assert got.country_diversity == len({x.geo_country for x in mine})
        if len(set(times)) > 1:
            assert got.uptime_hours == pytest.approx((times[-1] - times[0]).total_seconds() / 3600)
            assert got.burst_5m_count == sum(abs((x - r.timestamp).total_seconds()) <= 300 for x in times)
        assert got.coinjoin_prob == (1.0 if r.label == "coinjoin" else got.coinjoin_prob)
        assert got.rtt_proxy_ms == 0.0
    assert sum(r.rtt_proxy_ms for r in features.features(made, padded=True).collect()) > 0


def test_generated_rows_do_not_depend_on_partitions(spark):
    a = generate.records(spark, 500)
    b = generate.records(spark, 500).repartition(7)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    share = a.where("label <> 'normal'").count() / 500
    assert 0.02 < share < 0.07


def test_forest_finds_outliers(spark):
    df = spark.range(2000).select("id", ((F.col("id") * 37) % 101).cast("double").alias("a"), ((F.col("id") * 53) % 97).cast("double").alias("b"))
    df = df.unionByName(spark.createDataFrame([(5000 + i, 900.0 + i, -800.0) for i in range(5)], "id long, a double, b double"))
    scored = models.fit_forest(df, ["a", "b"], "id", trees=50).transform(df)
    top = [r.id for r in scored.orderBy(F.desc("anomaly")).limit(5).collect()]
    assert all(i >= 5000 for i in top)
    with pytest.raises(ValueError, match="no rows"):
        models.fit_forest(df.where("id < 0"), ["a", "b"], "id")


def test_calibrators(spark):
    df = spark.range(2000).select("id", (F.col("id") / 2000).alias("p"), (scalars.hash_unit(F.col("id")) < F.pow(F.col("id") / 2000, 2)).cast("int").alias("y"))
    for make in (models.platt, models.isotonic):
        out = make(df)(df)
        assert out.agg(F.min("calibrated"), F.max("calibrated")).first()[0] >= 0
        before = metrics.calibration_error(df).first()[0]
        assert metrics.calibration_error(out.select(F.col("calibrated").alias("p"), "y")).first()[0] < before


def test_metrics_on_empty_and_ties(spark):
    empty = spark.createDataFrame([], "p double, y int")
    assert metrics.average_precision(empty).first()[0] is None
    tied = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 0), (0.5, 1)], "p double, y int")
    assert metrics.average_precision(tied).first()[0] == pytest.approx(0.5)


def test_round_robin_and_chain(spark):
    m = spark.createDataFrame([(i, "g") for i in range(7)], "id int, g string")
    p = spark.createDataFrame([("g", f"e{i}") for i in range(3)], "g string, entry string")
    assert sorted(r["count"] for r in iterative.round_robin(m, p, "g").groupBy("entry").count().collect()) == [2, 2, 3]


def test_geo_refresh_is_repeatable(spark):
    cache = spark.createDataFrame([], "ip string, country string, city string, asn bigint, lat double, lng double, radius double, fetched_at timestamp")
    ips = spark.createDataFrame([("1.1.1.1",), ("1.1.1.1",), ("2.2.2.2",)], "ip string")
    a = geo.refresh(cache, ips, F.lit("2024-01-01").cast("timestamp"))
    assert a.count() == 2 and sorted(map(str, a.collect())) == sorted(map(str, geo.refresh(cache, ips, F.lit("2024-01-01").cast("timestamp")).collect()))
    assert geo.refresh(a, ips, F.lit("2025-01-01").cast("timestamp")).count() == 2


def test_labelled_graph_files(spark, tmp_path):
    head = "txId,time_step," + ",".join(f"feat_{i}" for i in range(166))
    rows = [f"t{i},{[0, 5, 99, ''][i % 4]}," + ",".join(str(i * 0.1 + j) for j in range(166 - (i % 3))) for i in range(10)]
    (tmp_path / "f.csv").write_text("\n".join([head, *rows]))
    (tmp_path / "g.csv").write_text("\n".join(rows))
    (tmp_path / "e.csv").write_text("txId1,txId2\n" + "\n".join(f"t{i},t{(i + 1) % 10}" for i in range(10)))
    (tmp_path / "c.csv").write_text("txId,class\nt0,1\nt1, 2\nt2,unknown\nt3,7\n")
    for f in ("f.csv", "g.csv"):
        nodes, edges = labelled.load(spark, *(f"{tmp_path}/{x}" for x in (f, "e.csv", "c.csv")))
        got = {r.id: r for r in nodes.collect()}
        assert len(got) == 10 and edges.count() == 10 and all(len(r.features) == 166 for r in got.values())
        assert [got[f"t{i}"].label for i in range(5)] == [1, 2, 0, 0, 0] and [got[f"t{i}"].step for i in range(4)] == [1, 5, 49, 1]
        assert min(r.amount for r in got.values()) == pytest.approx(0.01) and max(r.amount for r in got.values()) == pytest.approx(10)
    s = labelled.statistics(nodes).first()
    assert (s.n, s.illicit, s.licit, s.unknown) == (10, 1, 1, 8)
    same = nodes.withColumn("features", F.array_repeat(F.lit(1.0), 166)).drop("amount")
    assert labelled.with_amount(same).select("amount").distinct().collect()[0][0] == 1.0


def test_alerts_from_records(spark):
    made = generate.records(spark, 200)
    table = features.features(made).cache()
    forest = models.fit_forest(table, ["fan_in", "fan_out", "fee_sat_per_vb", "output_dispersion_gini"], "txid", trees=30)
    found = alerts.infer(made, forest).cache()
    rows = sorted(found.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, 201)) and all(a.p >= b.p for a, b in zip(rows, rows[1:], strict=False))
    top = found.where("rank <= 5")
    texts = alerts.explain(top, table, forest).collect()
    assert len(texts) == 5 and all(t.text.startswith("Wallet bc1q") and "flagged" in t.text and len(t.top) == 3 for t in texts)
    edges = graph.utxo_edges(made)
    nodes, near = alerts.neighbourhood(edges, top.select(F.col("txid").alias("id")), 2, 50)
    assert 5 <= nodes.count() <= 50 and near.count() > 0
    parts = iterative.connected_components(edges)
    assert alerts.weakly_connected_sample(edges, parts, 3).count() > 0


def test_cut_tables_can_be_dropped(spark):
    from pathlib import Path

    from tallyflow.functions import tables

    t = tables.cut(spark.range(5))
    folder = Path(tables._WRITTEN[-1].removeprefix("file:"))
    assert t.count() == 5 and folder.exists()
    tables.drop_cuts(spark)
    assert not folder.exists()


def test_radius_is_never_a_predicate():
    from pathlib import Path

    import tallyflow

    text = "".join(p.read_text() for p in Path(tallyflow.__file__).parent.rglob("*.py"))
    assert "where(\"radius" not in text and 'col("radius") <' not in text and 'col("radius") >' not in text


def test_outlier_factor_is_that_of_all_rows(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (1500, 2)), rng.normal(9, 0.01, (30, 2)), np.zeros((25, 2)), [[40.0, 40.0]]])
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id bigint, a double, b double")
    got = {r.id: r.lof for r in models.local_outlier_factor(rows, ["a", "b"], "id", **({"cell": 100} if "cell" in models.local_outlier_factor.__code__.co_varnames else {})).collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :20]
    at = np.take_along_axis(d, near, 1)
    density = 1 / (np.maximum(at, at[:, -1][near]).mean(axis=1) + 1e-10)
    want = density[near].mean(axis=1) / density
    assert np.allclose([got[i] for i in range(len(x))], want, rtol=1e-4)
    assert max(got[i] for i in range(1500, 1530)) < 3 < got[len(x) - 1]
