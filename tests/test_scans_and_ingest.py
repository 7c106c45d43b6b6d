"""Scans of hot keys against windows, percentiles of tied values, row numbers, ingest jobs that are whole or nothing."""

import json

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyflow.functions import ranges, scan
from tallyflow.operators import graph
from tallyflow.sources import files, records
from tests.test_operators import raw_rows


def keyed(spark, n=3000):
    k = F.when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") % 10 == 7, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    return spark.range(n).select(k.alias("k"), (F.xxhash64("id") % 1000).alias("t"), "id").repartition(5)


@pytest.mark.parametrize("hot", [0, 500, 10**6])
def test_previous_equals_lag(spark, hot):
    df, order = keyed(spark), [F.asc("t"), F.asc("id")]
    w = Window.partitionBy("k").orderBy(*order)
    want = df.select("k", "t", "id", F.lag("id").over(w).alias("before"), F.lag("t").over(w).alias("then"), F.row_number().over(w).cast("bigint").alias("n"))
    got = scan.previous(df, ["k"], order, {"before": F.col("id"), "then": F.col("t")}, hot)
    both = scan.numbered(got, ["k"], order, "n", hot)
    assert sorted(map(repr, both.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_one_key_is_dealt_evenly(spark):
    df = spark.range(20_000).select(F.lit("one").alias("k"), F.col("id").alias("t"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    try:
        sizes = [r["count"] for r in ranges.placed(df, [F.asc("k"), F.asc("t")]).groupBy("_part").count().collect()]
        assert len(sizes) == 8 and max(sizes) <= 2 * np.mean(sizes)
        assert scan.previous(df, ["k"], [F.asc("t")], {"before": F.col("id")}, 100).where("coalesce(before, -1) <> id - 1").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_temporal_edges_of_a_hot_wallet(spark, monkeypatch):
    df = spark.range(500).select(F.when(F.col("id") < 450, "w").otherwise("v").alias("w"), F.timestamp_seconds(F.col("id") * 100).alias("ts"), "id")
    want = sorted(map(repr, graph.temporal_edges(df, "w", "ts", "id").collect()))
    monkeypatch.setattr(scan.previous, "__defaults__", (10,))
    assert sorted(map(repr, graph.temporal_edges(df, "w", "ts", "id").collect())) == want and len(want) == 498


def test_percentile_of_tied_values(spark):
    rng = np.random.default_rng(3)
    for values in (np.repeat(7.0, 1000), rng.integers(0, 4, 1001).astype(float), rng.normal(size=997), np.array([5.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        for level in (0.0, 0.37, 0.5, 0.95, 1.0):
            assert ranges.percentile(df, "v", level, "p").first().p == pytest.approx(np.quantile(values, level), abs=1e-12)
    assert ranges.percentile(spark.createDataFrame([], "v double"), "v", 0.5, "p").first().p is None


def written(spark, path, n=10, bad=(3, 7)):
    good, faulty, _ = raw_rows()
    rows = [faulty[1] if i in bad else good for i in range(n)]
    spark.createDataFrame(rows).select(*records.COLUMNS).coalesce(1).write.csv(str(path), header=True, quote='"', escape='"')


def test_quarantine_has_row_numbers(spark, tmp_path):
    written(spark, tmp_path / "in")
    assert files.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/clean", f"{tmp_path}/bad", "csv") == {"clean": 8, "quarantined": 2}
    assert sorted(r.row for r in files.read_quarantine(spark, f"{tmp_path}/bad").collect()) == [4, 8]


def test_row_numbers_go_on_over_blocks_of_a_file(spark, tmp_path):
    bad = {5, 333, 700, 999}
    written(spark, tmp_path / "in", 1000, bad)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        assert files.read_csv(spark, f"{tmp_path}/in").rdd.getNumPartitions() > 5
        files.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/clean", f"{tmp_path}/bad", "csv")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.row for r in files.read_quarantine(spark, f"{tmp_path}/bad").collect()} == {i + 1 for i in bad}


def test_jobs_are_whole_or_nothing(spark, tmp_path, monkeypatch):
    written(spark, tmp_path / "in")
    run = lambda job: files.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/clean", f"{tmp_path}/bad", "csv", job)
    assert run("a") == run("a") == {"clean": 8, "quarantined": 2}  # the second adds nothing
    assert spark.read.parquet(f"{tmp_path}/clean").count() == 8
    with monkeypatch.context() as m:  # ended after it had written both sides
        m.setattr(files.RunLog, "named", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            run("b")
    assert spark.read.parquet(f"{tmp_path}/clean").count() == 8 and files.read_quarantine(spark, f"{tmp_path}/bad").count() == 2
    states = {r.job: r for r in files.jobs(spark, f"{tmp_path}/clean").collect()}
    assert states["a"].status == "done" and states["a"].clean == 8 and states["b"].status == "failed" and states["b"].error == "gone"
    with monkeypatch.context() as m:  # ended between giving names and the log's last line
        m.setattr(files.RunLog, "add", lambda self, job, source, status, add=files.RunLog.add, **more: status == "running" and add(self, job, source, status, **more))
        run("b")
    assert run("b") == {"clean": 8, "quarantined": 2} and spark.read.parquet(f"{tmp_path}/clean").count() == 16
    assert files.jobs(spark, f"{tmp_path}/clean").where("status = 'done'").count() == 2
    assert files.jobs(spark, f"{tmp_path}/none").count() == 0
    assert json.loads(next((tmp_path / "clean" / "_runs").glob("a-done.json")).read_text())["source"].endswith("/in")
