"""Stored models give the scores of those that were saved; what is missing or of another schema is an error."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyflow.operators import models, network, store


def test_models_come_back(spark, tmp_path):
    df = spark.range(800).select("id", *[(F.xxhash64(F.lit(c), "id") % 1000 / 1000).alias(c) for c in "ab"]).withColumn("p", F.pmod("a", F.lit(1.0))).withColumn("y", (F.col("p") + F.col("b") > 0.7).cast("int"))
    fresh = spark.newSession()
    forest = models.fit_forest(df, ["a", "b"], "id", trees=15)
    assert store.save(spark, forest, f"{tmp_path}/forest") == 1
    again = store.load(fresh, f"{tmp_path}/forest", models.IsolationForest)
    assert again.transform(df).select("id", "anomaly").exceptAll(forest.transform(df).select("id", "anomaly")).isEmpty()
    assert again.attribute(df, "id", 2).exceptAll(forest.attribute(df, "id", 2)).isEmpty()
    for name, model in (("platt", models.platt(df)), ("isotonic", models.isotonic(df))):
        store.save(spark, model, f"{tmp_path}/{name}")
        assert store.load(fresh, f"{tmp_path}/{name}")(df).exceptAll(model(df)).isEmpty()
        assert {type(store.load(fresh, f"{tmp_path}/{name}")).__name__.lower()} == {name}
    net = network.Network([(np.arange(6.0).reshape(2, 3), np.ones(3)), (np.eye(3)[:, :2], np.zeros(2))])
    store.save(spark, net, f"{tmp_path}/net")
    for (w, b), (w2, b2) in zip(net.layers, store.load(fresh, f"{tmp_path}/net").layers, strict=True):
        assert (w == w2).all() and (b == b2).all()


def test_isotonic_curves(spark):
    rows = spark.createDataFrame([(x / 10, int(x in (2, 5, 6, 8, 9))) for x in range(10)], "p double, y int")
    got = {r.p: r.calibrated for r in models.isotonic(rows)(rows.unionByName(spark.createDataFrame([(-1.0, 0), (2.0, 0), (None, 0)], "p double, y int"))).collect()}
    assert [got[x / 10] for x in range(10)] == pytest.approx([0, 0, 1 / 3, 1 / 3, 1 / 3, 2 / 3, 2 / 3, 2 / 3, 1, 1]) and got[-1.0] == 0 and got[2.0] == 1


def test_versions_and_errors(spark, tmp_path):
    path = f"{tmp_path}/m"
    with pytest.raises(FileNotFoundError, match="no model in"):
        store.load(spark, path)
    assert [store.save(spark, models.Platt(float(k), 0.0), path) for k in (1, 2)] == [1, 2]
    assert store.load(spark, path).slope == 2.0 and store.load(spark, path, version=1).slope == 1.0
    assert [r.version for r in store.latest(spark, path).orderBy("version").collect()] == [1, 2]
    (tmp_path / "m" / "version=2" / "about" / "_SUCCESS").unlink()  # never finished
    assert store.versions(spark, path) == [1] and store.load(spark, path).slope == 1.0
    with pytest.raises(FileNotFoundError, match="version 2"):
        store.load(spark, path, version=2)
    with pytest.raises(ValueError, match="kind Platt"):
        store.load(spark, path, models.IsolationForest)
    store.save(spark, models.Isotonic([0.0, 1.0], [0.0, 1.0]), f"{tmp_path}/c")
    spark.createDataFrame([(0, 0.5)], "at int, p double").write.mode("overwrite").parquet(f"{tmp_path}/c/version=1/curve")
    with pytest.raises(ValueError, match="has the columns"):
        store.load(spark, f"{tmp_path}/c")
    with pytest.raises(TypeError, match="can't be stored"):
        store.save(spark, object(), path)
