"""Importance resampling, WARC archives and ranked search: brute force, round trips and defined cases."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyflow.functions.tables import scratch
from tallyflow.llm import importance, lexical, warc
from tests.llm.test_llm import SF, empty, odd_documents

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---------------------------------------------------------------- importance resampling


def brute_resample(docs, target, longest, buckets=importance.BUCKETS):
    def features(text):
        ws = WORDS.findall(lower(text))
        return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]

    s, t = (Counter(b for x in texts for b in features(x)[1]) for texts in ([x for _, x in docs], target))
    s_all, t_all = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for i, x in docs:
        n, fs = features(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, fs))
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= 20])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(able) * 10 // 100
    out = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in rows if not r[4]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_against_brute_force(spark, longest):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3)
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = importance.resample(docs, target, longest=longest).select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = brute_resample([tuple(r) for r in docs.collect()], [r.text for r in target.collect()], longest)
    assert sorted(map(tuple, got), key=repr) == want and sum(r[4] is not None for r in want) > 10


def test_bucket_vectors_of_tasks_are_merged_whole(spark):
    texts = [f"alpha beta word{i}" for i in range(500)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(37)
    got = importance.bucket_counts(docs, 64, depth=3)
    assert got.tolist() == np.bincount([zlib.crc32(w.encode()) % 64 for t in texts for w in t.split()], minlength=64).tolist()


def test_resampling_odd_tables(spark):
    docs = odd_documents(spark)
    got = importance.resample(docs, spark.createDataFrame([("some more text",), (None,)], "text string"))
    want = brute_resample([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], ["some more text", None], 1)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert importance.resample(empty(spark), empty(spark)).count() == 0
    # equal scores: the smaller id first, repeated rows one after the other
    rows = spark.createDataFrame([(7, "same " * 20)] * 30, "doc_id bigint, text string")
    assert sorted(r["rank"] for r in importance.resample(rows, empty(spark)).collect() if r["rank"]) == [1, 2, 3]


# ---------------------------------------------------------------- ranked search


def brute_search(docs, items, top=10):
    tfs = [Counter(WORDS.findall(lower(t))) for _, t in docs]
    n_docs, length = sum(1 for c in tfs if c), sum(c.total() for c in tfs)
    df = Counter(t for c in tfs for t in c)
    out = []
    for item, text in items:
        found = []
        for k, ((doc, _), c) in enumerate(zip(docs, tfs, strict=True)):
            m = 10 + 90 * c.total() * n_docs // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(WORDS.findall(lower(text))) if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, k))
        out += [(item, r + 1, None if none else doc, -score) for r, (score, none, doc, _) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_search_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    want = brute_search([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert found(lexical.search(lexical.build_index(docs), items)) == want and len(want) > 50


def test_search_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(lexical, "MOST_TERMS", 0)
    monkeypatch.setattr(lexical, "MOST_PAIRS", 0)
    docs = [(i, f"common word{i % 7} word{i % 11} Ünïcode{i % 5} common") for i in range(200)]
    items = [(1, "common WORD3 ünïcode2"), (2, "word10 word10 absent"), (3, "!!! ---"), (4, None)]
    got = lexical.search(lexical.build_index(spark.createDataFrame(docs, "doc_id bigint, text string")), spark.createDataFrame(items, "item_id bigint, text string"))
    assert found(got) == brute_search(docs, items)


def test_search_odd_tables(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(1, "short word7 SAME words"), (1, "another dozen"), (None, "text"), (2, "")]
    table = spark.createDataFrame([(*x, "s", "s", "s") for x in items], "item_id bigint, text string, term string, bucket string, row string")
    assert found(lexical.search(lexical.build_index(docs), table)) == brute_search(rows, items)
    assert not found(lexical.search(lexical.build_index(empty(spark)), table))
    assert not found(lexical.search(lexical.build_index(docs), table.where("false")))


def test_index_parts_are_sorted_by_bucket(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(2)
    index = lexical.build_index(docs)
    for part in index.rdd.map(lambda r: r.bucket).glom().collect():
        assert part == sorted(part)
    one = index.where(F.col("bucket").isin([5]))
    assert "PushedFilters: [In(bucket, [5])" in one._jdf.queryExecution().toString() or "EqualTo(bucket,5)" in one._jdf.queryExecution().toString()


# ---------------------------------------------------------------- WARC archives


def test_inflated_is_one_stream_or_many_members():
    whole = random.Random(1).randbytes(5_000_000)
    many = b"".join(gzip.compress(whole[i : i + 700_000]) for i in range(0, len(whole), 700_000))
    for data in (gzip.compress(whole), many):
        for step in (1 << 16, 1 << 20, len(data)):
            assert b"".join(warc.inflated(data[i : i + step] for i in range(0, len(data), step))) == whole
    assert b"".join(warc.inflated(iter([]))) == b""
    for broken in (gzip.compress(whole)[:-9], many[: len(many) // 2]):
        with pytest.raises(ValueError, match="within a gzip member"):
            list(warc.inflated(iter([broken])))


def record(payload, spare=b""):
    return b"WARC/1.0\r\nWARC-Type: resource\r\nX-Long: a\r\n  b\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload + b"\r\n\r\n" + spare


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_records_are_split_wherever_the_stream_is_cut(step):
    payloads = [b"", b"x", b"\r\n\r\n" * 5, b"WARC/1.0\r\nContent-Length: 3\r\n\r\n", bytes(range(256)) * 3]
    data = b"\r\n" + b"".join(record(p, b"\r\n" * (i % 2)) for i, p in enumerate(payloads))
    got = list(warc.split_records(iter([data[i : i + step] for i in range(0, len(data), step)])))
    assert got == [record(p) for p in payloads]
    assert warc.header(got[0].split(warc.END)[0])[1][b"x-long"] == b"a b"
    for broken in (data[:-3], data[:20], b"HTTP/1.1 200 OK\r\n\r\n", data.replace(b"Content-Length: 1\r", b"Content-Length: 0\r")):
        with pytest.raises(ValueError, match="archive|record"):
            list(warc.split_records(iter([broken])))


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", *[F.lit(1).alias(c) for c in ("digest", "bytes", "record", "n", "largest", "name")])


LONG, EDGE = "ä" * 500, "y" * 999
ROWS = [
    (1, "http://a/?q=1 2\r\nX: y", LONG), (2, "http://b/", LONG), (9, None, LONG), (9, "http://again/", LONG), (None, "http://none/", LONG), (3, "http://c/", EDGE), (4, "http://d/", EDGE),
    (5, "http://e/", None), (6, "http://f/", ""), (7, "http://g/", "WARC/1.1\r\n\r\n\r\n\r\n\x00 <p>\U0001f600</p>\r\n\r\n"), (8, "http://h/", "z" * 3_000_000), (None, None, "w" * 2000), (None, None, "w" * 2000),
]


def normalised(spark, pages):
    top = scratch(spark, "warc-test")
    warc.write_archives(pages, f"{top}/whole")
    return top, warc.normalise(spark, f"{top}/whole", f"{top}/members")


def test_archives_round_trip(spark):
    pages = pages_of(spark, ROWS).repartition(3)
    top, manifest = normalised(spark, pages)
    rows = warc.read(manifest).collect()
    assert sorted((r.name or "", r.payload.decode() if r.payload is not None else None) for r in rows if r.record_type == "response") == sorted(
        [("9", LONG), ("9", LONG), ("3", EDGE), ("4", EDGE), ("5", ""), ("6", ""), ("7", ROWS[9][2]), ("8", ROWS[10][2]), ("", "w" * 2000), ("", "w" * 2000)]
    )
    revisits = sorted((r.name or "", r.refers, r.payload_bytes, r.payload_digest, r.payload) for r in rows if r.record_type == "revisit")
    assert revisits == [(i, "9", 1000, hashlib.sha1(LONG.encode()).hexdigest(), None) for i in ("", "1", "2")]
    assert {r.url for r in rows if r.name == "1"} == {"http://a/?q=1%202%0D%0AX:%20y"} and {r.url for r in rows if r.name == "9"} == {None, "http://again/"}


def test_members_stand_alone_and_the_source_is_one_stream(spark):
    top, manifest = normalised(spark, pages_of(spark, ROWS * 3).repartition(2))
    whole = defaultdict(list)
    for r in spark.read.format("binaryFile").load(f"{top}/whole/*.gz").collect():
        d = zlib.decompressobj(31)
        d.decompress(r.content)
        assert d.eof and not d.unused_data  # monolithic
        whole[r.path.rsplit("/", 1)[-1].removesuffix(".txt.gz")] = gzip.decompress(r.content)
    assert manifest.count() == len(whole) >= 2
    for m in manifest.collect():
        data = open(m.archive.removeprefix("file:"), "rb").read()
        entries = [tuple(map(int, x.split(","))) for x in open(m["index"].removeprefix("file:"))]
        assert len(entries) == m.n_records and sum(n for _, n in entries) == m.n_bytes == len(data)
        parts = [gzip.decompress(data[at : at + n]) for at, n in entries]
        assert all(p.startswith(b"WARC/1.1\r\n") and p.endswith(b"\r\n\r\n") for p in parts)
        stem = m.archive.rsplit("/", 1)[-1][: -len("-.warc.gz") - 32]
        assert b"".join(parts) == whole[stem]


def test_half_written_files_are_not_read(spark):
    top, manifest = normalised(spark, pages_of(spark, ROWS))
    folder = manifest.first()["index"].rsplit("/", 1)[0].removeprefix("file:")
    with open(f"{folder}/lost-attempt.cdx", "w") as f:
        f.write("0,10\n")
    assert warc.read(manifest, with_payload=False).count() == len(ROWS)


def test_other_writers_archives_and_wrong_digests(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\n\r\nhello"
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/\r\n%sContent-Length: %d\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    good, bad = head % (b"", len(page)) + page + warc.END, head % (b"WARC-Payload-Digest: sha1:00\r\n", len(page)) + page + warc.END
    for name, data in (("good", gzip.compress(info) + gzip.compress(good) * 2), ("bad", gzip.compress(bad))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc.gz").write_bytes(data)
    m = warc.normalise(spark, str(tmp_path / "good"), scratch(spark, "members"))
    assert m.first()["n_records"] == 3
    assert [(r.name, r.url, r.payload_bytes, bytes(r.payload)) for r in warc.read(m).collect()] == [(None, "http://x/", 5, b"hello")] * 2
    assert warc.read(m, kinds=("warcinfo",)).count() == 1
    with pytest.raises(Exception, match="isn't what its digest says"):
        warc.read(warc.normalise(spark, str(tmp_path / "bad"), scratch(spark, "members"))).collect()


def test_no_pages(spark):
    _, manifest = normalised(spark, pages_of(spark, ROWS).where("false"))
    assert warc.read(manifest).count() == 0


def test_large_archives_are_read_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 500)
    _, manifest = normalised(spark, pages_of(spark, ROWS * 5).coalesce(1))
    got = warc.read(manifest, with_payload=False)
    assert got.rdd.getNumPartitions() > 2 and got.count() == 5 * len(ROWS)
