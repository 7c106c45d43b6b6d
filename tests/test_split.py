"""A split by class deals a class's rows to many tasks."""

from tallyflow.operators import metrics


def test_classes_are_not_brought_together(spark):
    rows = spark.range(4000).selectExpr("id", "CAST(id % 2 AS INT) AS y")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = metrics.stratified_split(rows, "y", "id")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert {(r.y, r["count"]) for r in out.where("part = 'train'").groupBy("y").count().collect()} == {(0, 1400), (1, 1400)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
