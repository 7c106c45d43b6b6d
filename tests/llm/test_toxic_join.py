"""Texts meet their labels in one way at any size."""

from tallyflow.llm import toxicity


def test_labels_join_alike_small_or_large(spark, monkeypatch, capsys):
    docs = spark.createDataFrame([(i, "vile " * 9 if i % 2 else "fine words here") for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    plans, cut = [], toxicity.cut

    def keep(df, name="step"):
        if name == "toxic-known":
            df.explain()
            plans.append(capsys.readouterr().out)
        return cut(df, name)

    monkeypatch.setattr(toxicity, "cut", keep)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in ("-1", "10m"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            assert {r.doc_id % 2: r.predicted for r in toxicity.score(docs, labels).collect()} == {0: 0, 1: 1}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(plans) == 2 and all("ShuffledHashJoin" in p for p in plans)
