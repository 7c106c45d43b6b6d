"""JSON arrays that many tasks read, and checksums of files that fit in no row."""

import hashlib
import json
import random

import pytest

from tallyflow.sources import files
from tallyflow.sources.records import COLUMNS


def faulty_text(r):
    return "".join(r.choice(['"', "\\", "{", "}", "[", "]", ",", "é", "\n", " ", "ab", '\\"', "}{"]) for _ in range(r.randint(0, 40)))


def rows_of(df):
    return sorted(tuple(r[c] for c in [*COLUMNS, "_row"]) for r in df.collect())


def nulls_last(rows):
    return sorted(tuple((x is None, x) for x in r) for r in rows)


@pytest.mark.parametrize(("indent", "block"), [(None, 97), (2, 211), (None, 1 << 20), (1, 4096)])
def test_arrays_by_blocks_equal_whole_files(spark, tmp_path, indent, block):
    """Strings full of quotes, braces and escapes, nested objects, and blocks that end anywhere."""
    r = random.Random(block)
    for name in ("a b", "c[1]"):
        made = [{"txid": f"{i}", "script_type": faulty_text(r), "geo_country": faulty_text(r), "input_addresses": [faulty_text(r)], "more": {"x": {}, "y": faulty_text(r)}} for i in range(60)]
        (tmp_path / f"{name}.json").write_text(json.dumps(made, indent=indent, ensure_ascii=bool(block % 2)), newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        pieces = files._pieces(spark, str(tmp_path))
        assert block > 9999 or pieces.select("_file", "_block").distinct().count() > 4
        split = [tuple(x[c] for c in [*COLUMNS, "_row"]) for x in files.read_json(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = [tuple(x[c] for c in [*COLUMNS, "_row"]) for x in files.read_json_whole(spark, str(tmp_path)).collect()]
    assert len(split) == 120 and nulls_last(split) == nulls_last(whole)


def test_edges_of_arrays(spark, tmp_path):
    shapes = {"empty": "[]", "blank": " \n", "one": '﻿ [ {"txid": "t"} ]\n', "cut": '[{"txid": "t"}, {"txid": "u', "bad": '[{"txid": "t"}, {txid: u}]', "object": '{"records": [{"txid": "t"}]}'}
    got = {}
    for name, text in shapes.items():
        (tmp_path / f"{name}.json").write_text(text)
        got[name] = [(x["_row"], x["txid"]) for x in files.read_json(spark, str(tmp_path / f"{name}.json")).orderBy("_row").collect()]
    assert got == {"empty": [], "blank": [], "one": [(1, "t")], "cut": [(1, "t")], "bad": [(1, "t"), (2, None)], "object": [(1, "t")]}
    assert files.read_json(spark, str(tmp_path)).count() == 5


def test_arrays_are_written_and_read(spark, tmp_path):
    made = spark.range(500).selectExpr("cast(id AS string) AS txid", "concat('}\"', id) AS script_type").repartition(3)
    files.write_json_arrays(made, f"{tmp_path}/out")
    assert all(isinstance(json.loads(p.read_text()), list) for p in (tmp_path / "out").glob("part-*"))
    back = files.read_json(spark, f"{tmp_path}/out").select("txid", "script_type")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, made.collect()))


def test_checksums_of_streams(spark, tmp_path):
    texts = {"small": b"abc", "large": random.Random(1).randbytes(9 << 20), "empty": b""}
    for name, content in texts.items():
        (tmp_path / name).write_bytes(content)
    got = {x["path"].rpartition("/")[2]: x["sha256"] for x in files.checksums(spark, str(tmp_path), whole=1 << 20).collect()}
    assert got == {name: hashlib.sha256(content).hexdigest() for name, content in texts.items() if content}
