"""Fitted models as versioned Parquet tables: forests, calibrators and networks, without pickles.

A version is a folder version=<n> with the tables of the model's parameters and, written last, ``about``: the model's
kind and its few scalars. A version without ``about`` was never finished and isn't seen. Loading checks every table's
schema; a model that is missing, of another kind or of another schema is an error.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.operators.models import IsolationForest, Isotonic, Platt
from tallyflow.operators.network import Network

ABOUT = "kind string, facts string"
NODES = "tree int, node int, feature int, threshold double, left int, right int, rows bigint"
CURVE = "at int, p double, y double"
WEIGHTS = "layer int, rows int, columns int, matrix array<double>, bias array<double>"


def _parts(spark: SparkSession, model) -> tuple[dict, str, list, str]:
    """(facts, table's name, its rows, its schema) of a model."""
    if isinstance(model, IsolationForest):
        rows = [(t, i, int(f), float(x), int(lo), int(hi), int(n)) for t, tree in enumerate(model.trees) for i, (f, x, lo, hi, n) in enumerate(tree)]
        return {"columns": model.columns, "size": model.size, "trees": len(model.trees)}, "nodes", rows, NODES
    if isinstance(model, Platt):
        return {"slope": model.slope, "intercept": model.intercept}, "curve", [], CURVE
    if isinstance(model, Isotonic):
        return {}, "curve", [(i, float(p), float(y)) for i, (p, y) in enumerate(zip(model.p, model.y, strict=True))], CURVE
    if isinstance(model, Network):
        return {}, "weights", [(i, *w.shape, w.ravel().tolist(), b.tolist()) for i, (w, b) in enumerate(model.layers)], WEIGHTS
    raise TypeError(f"{type(model).__name__} can't be stored")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of a stored model, oldest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/about/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return sorted(int(s.getPath().getParent().getParent().getName().split("=")[1]) for s in found)


def save(spark: SparkSession, model, path: str) -> int:
    """Store a model as the next version; returns its number."""
    facts, name, rows, schema = _parts(spark, model)
    version = max(versions(spark, path), default=0) + 1
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}/{name}")
    spark.createDataFrame([(type(model).__name__, json.dumps(facts))], ABOUT).coalesce(1).write.parquet(f"{path}/version={version}/about")
    return version


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    found, want = spark.read.parquet(path), spark.createDataFrame([], schema)
    if found.dtypes != want.dtypes:
        raise ValueError(f"{path} has the columns {found.dtypes}, not {want.dtypes}")
    return found


def load(spark: SparkSession, path: str, kind: type | None = None, version: int | None = None):
    """A stored model, the newest version where none is named."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no model{'' if version is None else f' of version {version}'} in {path}")
    top = f"{path}/version={known[-1] if version is None else version}"
    about = _table(spark, f"{top}/about", ABOUT).first()
    if kind is not None and about.kind != kind.__name__:
        raise ValueError(f"{top} holds a model of kind {about.kind}, not {kind.__name__}")
    facts = json.loads(about.facts)
    if about.kind == "IsolationForest":  # as many rows as a forest has nodes
        trees: list[list[tuple]] = [[] for _ in range(facts["trees"])]
        for r in _table(spark, f"{top}/nodes", NODES).orderBy("tree", "node").collect():
            trees[r.tree].append((r.feature, r.threshold, r.left, r.right, r["rows"]))
        return IsolationForest(facts["columns"], trees, facts["size"])
    if about.kind == "Platt":
        return Platt(facts["slope"], facts["intercept"])
    if about.kind == "Isotonic":
        rows = _table(spark, f"{top}/curve", CURVE).orderBy("at").collect()
        return Isotonic([r.p for r in rows], [r.y for r in rows])
    if about.kind == "Network":
        rows = _table(spark, f"{top}/weights", WEIGHTS).orderBy("layer").collect()
        return Network([(np.array(r.matrix).reshape(r["rows"], r["columns"]), np.array(r.bias)) for r in rows])
    raise ValueError(f"{top} holds a model of unknown kind {about.kind}")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """(version, kind, facts) of a stored model's versions."""
    some = [spark.read.schema(ABOUT).parquet(f"{path}/version={v}/about").withColumn("version", F.lit(v)) for v in versions(spark, path)]
    out = spark.createDataFrame([], f"version int, {ABOUT}")
    for df in some:
        out = out.unionByName(df)
    return out
