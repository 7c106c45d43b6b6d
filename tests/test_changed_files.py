"""Files that are written again: read once more, their rows replaced on both sides."""

import os
import time

from pyspark.sql import functions as F

from tallyflow.sources import files, records
from tallyflow.streaming import changed
from tests.test_operators import raw_rows


def write(spark, tmp_path, name, rows):
    spark.createDataFrame(rows).select(*records.COLUMNS).coalesce(1).write.mode("overwrite").csv(f"{tmp_path}/made", header=True, quote='"', escape='"')
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / name).write_text(next((tmp_path / "made").glob("part-*.csv")).read_text())
    time.sleep(0.02)


def test_rows_of_a_changed_file_are_replaced(spark, tmp_path):
    good, bad, _ = raw_rows()
    run = lambda: changed.ingest_changed(changed.watch_changed(spark, f"{tmp_path}/in"), f"{tmp_path}/clean", f"{tmp_path}/bad", f"{tmp_path}/cp").awaitTermination()
    counts = lambda: (spark.read.parquet(f"{tmp_path}/clean").count(), spark.read.schema("row bigint, error string").option("recursiveFileLookup", True).json(f"{tmp_path}/bad").count())
    write(spark, tmp_path, "a b.csv", [good, good, bad[1]])
    write(spark, tmp_path, "c.csv", [good])
    run()
    assert counts() == (3, 1)
    run()  # nothing has changed
    assert counts() == (3, 1)
    write(spark, tmp_path, "a b.csv", [good, bad[1], bad[1]])
    run()
    assert counts() == (2, 2)
    write(spark, tmp_path, "a b.csv", [bad[1]])  # no clean row is left
    write(spark, tmp_path, "d.csv", [good, good])
    run()
    assert counts() == (3, 1)
    (tmp_path / "in" / "c.csv").rename(tmp_path / "in" / "c.txt")
    run()
    assert counts() == (3, 1)


def test_offsets_tell_files_of_one_moment_apart(tmp_path):
    reader = changed.ChangedReader(str(tmp_path), r"\.csv$")
    assert reader.partitions(reader.initialOffset(), reader.latestOffset()) == []
    for name in ("a.csv", "b.csv", "_c.csv", "d.txt"):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, ns=(10, 10))
    one = reader.latestOffset()
    got = [r for p in reader.partitions(reader.initialOffset(), one) for r in reader.read(p)]
    assert [os.path.basename(r[0]) for r in got] == ["a.csv", "b.csv"]
    (tmp_path / "e.csv").write_text("xy")
    os.utime(tmp_path / "e.csv", ns=(10, 10))  # as old as the others, seen later
    two = reader.latestOffset()
    assert [(os.path.basename(r[0]), r[2]) for p in reader.partitions(one, two) for r in reader.read(p)] == [("e.csv", 2)]
    os.utime(tmp_path / "a.csv", ns=(20, 20))
    assert [os.path.basename(r[0]) for p in reader.partitions(two, reader.latestOffset()) for r in reader.read(p)] == ["a.csv"]


def test_results_stay_out_of_the_clean_folder(spark, tmp_path):
    import pytest

    files.write_results(spark.range(3), f"{tmp_path}/results", f"{tmp_path}/clean")
    assert spark.read.parquet(f"{tmp_path}/results").agg(F.sum("id")).first()[0] == 3
    with pytest.raises(ValueError, match="clean zone"):
        files.write_results(spark.range(3), f"{tmp_path}/clean/results", f"{tmp_path}/clean")
