"""Burst counts on a stream against the batch result: early, late and repeated rows, keys that fall silent."""

import datetime
import random

from pyspark.sql import functions as F

from tallyflow.operators import features
from tallyflow.streaming import bursts

START = datetime.datetime(2024, 1, 1)


def test_stream_counts_are_the_batch_counts(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted((rng.choice("ab") if i % 9 else "quiet", START + datetime.timedelta(seconds=rng.randrange(6 * 3600)), f"e{i}") for i in range(160))
    rows.sort(key=lambda r: r[1] + datetime.timedelta(seconds=rng.uniform(-240, 240)))  # somewhat out of order
    far = ("end", START + datetime.timedelta(days=2), "end")
    late = ("a", START - datetime.timedelta(days=1), "late")
    batches = [rows[i : i + 40] + rows[max(0, i - 3) : i] for i in range(0, 160, 40)] + [[far], [late, ("end", far[1] + datetime.timedelta(days=1), "last")]]
    for i, part in enumerate(batches):
        spark.createDataFrame(part, "k string, ts timestamp, id string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        (tmp_path / "flat").mkdir(exist_ok=True)
        next((tmp_path / "in" / str(i)).glob("part-*.parquet")).rename(tmp_path / "flat" / f"{i}.parquet")
        stream = spark.readStream.schema("k string, ts timestamp, id string").parquet(f"{tmp_path}/flat")
        out = bursts.burst_stream(stream, "k", "ts", "id")
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    whole = spark.createDataFrame([*rows, far], "k string, ts timestamp, id string")
    want = features.burst_counts(whole, "k", "ts", bursts.SPANS).select("k", "ts", "id", *bursts.SPANS)
    got = spark.read.parquet(f"{tmp_path}/out").select("k", "ts", "id", *bursts.SPANS)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.where("id = 'late'").count() == 0
    assert got.agg(F.max("burst_5m")).first()[0] > 2
