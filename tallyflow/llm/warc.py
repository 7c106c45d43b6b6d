"""WARC archives: pages written as records, whole-file gzip archives normalised to a member a record, and read back.

``write_archives`` writes pages as WARC records through Spark's own text writer: each partition becomes one file that
is one gzip stream, as many archives come. ``normalise`` inflates each such file once, as a stream, and rewrites every
record as a gzip member of its own, with a sidecar of offsets and lengths; memory is bounded by a record. ``read``
takes the sidecars, deals the records by ranges of bytes to as many tasks as their bytes need, and inflates each
member alone. Archives of other writers are normalised and read the same way, with one gzip stream or many members.

Files get a new name in every attempt of a task, and the manifest, a written table, names those of the attempts that
counted: a lost executor's half-written files are never read. Folders are opened with pyarrow's file systems.

Defined cases: a null page is an empty payload; records of equal payloads of enough bytes refer to the one of the
largest page_id (by SHA-1 and length), rows that share that id are responses each, as are all where every id is null;
a null url has no target header, white space and control characters in a url are percent-encoded; long payloads are
whole; repeated rows are records of their own; no pages give no records; other columns may have any name. A payload
whose digest isn't the header's, a truncated file and a broken record are errors.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions.tables import scratch
from tallyflow.llm.common import cut, table

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
NAME = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK, LEVEL = 1 << 20, 1
#: Bytes of archives that one task reads back.
TASK_BYTES = 64 << 20
END = b"\r\n\r\n"
INDEX = "offset bigint, length bigint"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


# ---------------------------------------------------------------- writing


def with_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, bytes, digest, refers_to): the page that a revisit refers to, null for responses.

    Only digests are grouped; payloads that more than one page has meet their pages by a join that Spark can split.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    each = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("bigint").alias("bytes"), F.sha1(html.cast("binary")).alias("digest"))
    long = each.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("largest"))
    shared = cut(long.where("n > 1").select("digest", "bytes", "largest"), "shared-payloads")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return each.join(shared, ["digest", "bytes"], "left").select("page_id", "url", "html", "bytes", "digest", refers.alias("refers_to"))


def _name(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{NAME}"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("")), F.lit(">"))


def records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(record): the WARC record of each row of with_revisits(), without the line ends that close it."""
    visited = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(visited, F.lit(0)).otherwise(F.col("bytes"))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"\r", "%0D"), r"\n", "%0A"), r"[\x00-\x20\x7F]", "%20")
    head = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(visited, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), _name(F.col("page_id"))), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), F.when(visited, F.concat(F.lit("WARC-Refers-To: "), _name(F.col("refers_to")))),
        F.when(visited, F.lit(f"WARC-Profile: {PROFILE}")), F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return pages.select(F.concat(F.concat_ws("\r\n", *head), F.lit("\r\n\r\n"), http, F.when(visited, F.lit("")).otherwise(F.col("html"))).alias("record"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> None:
    """Pages (page_id, url, html) as WARC files in ``folder``, each one gzip stream."""
    rows = records(with_revisits(pages, least))
    rows.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", END.decode()).text(folder)


# ---------------------------------------------------------------- normalising


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What gzip data of one member or many holds, in pieces; data that ends within a member is an error."""
    d, started = zlib.decompressobj(31), False
    for data in chunks:
        while data:
            yield d.decompress(data, CHUNK)
            started = True
            while d.unconsumed_tail:
                yield d.decompress(d.unconsumed_tail, CHUNK)
            data = d.unused_data
            if d.eof:
                d, started = zlib.decompressobj(31), False
            else:
                break
    if started:
        raise ValueError("the archive ends within a gzip member")


def header(data: bytes) -> tuple[bytes, dict[bytes, bytes]]:
    """The first line and the fields by lower-case name; a folded line goes on with the one before."""
    first, _, rest = data.partition(b"\r\n")
    fields = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", rest).split(b"\r\n"):
        name, _, value = line.partition(b":")
        fields.setdefault(name.strip().lower(), value.strip())
    return first, fields


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole WARC records, with the line ends that close them, of a stream that is cut anywhere."""
    held = bytearray()

    def more() -> bool:
        got = next(pieces, None)
        held.extend(got or b"")
        return got is not None

    while True:
        while held[:1] in (b"\r", b"\n") or not held:  # spare line ends between records
            if not held and not more():
                return
            while held[:1] in (b"\r", b"\n"):
                del held[:1]
        at = 0
        while (end := held.find(END, max(0, at - 3))) < 0:
            at = len(held)
            if not more():
                raise ValueError("the archive ends within a record's header")
        first, fields = header(bytes(held[:end]))
        if not first.startswith(b"WARC/") or not fields.get(b"content-length", b"").isdigit():
            raise ValueError(f"no WARC record: {first[:60]!r}")
        size = end + 4 + int(fields[b"content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends within a record")
        if held[size - 4 : size] != END:
            raise ValueError("a record is longer than its header says")
        yield bytes(held[:size])
        del held[:size]


def normalise(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """Rewrite the archives in ``source`` with a gzip member a record; the manifest (archive, index, n_records, n_bytes).

    The manifest is a written table. An index is a text file of "offset,length" lines in the order of the members.
    """
    fs, at = opened(folder)
    fs.create_dir(at)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(source).select("path", "length")
    files = files.repartition(max(1, files.count()), "path")  # a file is a stream, and so a task's work

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            come, name = opened(path)
            stem = f"{folder}/{re.sub(r'(\.txt|\.warc)?\.gz$', '', name.rsplit('/', 1)[-1])}-{uuid.uuid4().hex}"
            go, base = opened(stem)
            offset = n = 0
            with come.open_input_stream(name, compression=None) as stream, go.open_output_stream(f"{base}.warc.gz", compression=None) as out, go.open_output_stream(f"{base}.cdx", compression=None) as index:
                for record in split_records(inflated(iter(lambda: stream.read(CHUNK), b""))):
                    c = zlib.compressobj(LEVEL, wbits=31)
                    member = c.compress(record) + c.flush()
                    out.write(member)
                    index.write(b"%d,%d\n" % (offset, len(member)))
                    offset, n = offset + len(member), n + 1
            yield pa.RecordBatch.from_pydict({"archive": [f"{stem}.warc.gz"], "index": [f"{stem}.cdx"], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([offset], pa.int64())})

    return cut(files.select("path").mapInArrow(run, "archive string, index string, n_records bigint, n_bytes bigint"), "warc-manifest")


# ---------------------------------------------------------------- reading back


def _of(fields: dict[bytes, bytes], name: bytes) -> str | None:
    """The id in a record's name; None where there is none."""
    value = fields.get(name, b"").decode()
    return unquote_plus(value[len(NAME) + 1 : -1]) or None if value.startswith(f"<{NAME}") else None


def parsed(record: bytes) -> dict:
    """What a response or revisit record says; a response's payload is held against its digest."""
    head, _, block = record[:-4].partition(END)
    _, fields = header(head)
    http, _, payload = block.partition(END)
    kind = fields.get(b"warc-type", b"").decode()
    digest = fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
    if kind == "response":
        found = hashlib.sha1(payload).hexdigest()
        if digest not in ("", found):
            raise ValueError(f"the payload of {fields.get(b'warc-record-id')!r} isn't what its digest says")
        digest, size = found, len(payload)
    else:
        size = int(header(http)[1].get(b"content-length", b"0"))  # of the full payload, which the record doesn't hold
        payload = None
    url = fields.get(b"warc-target-uri")
    return {"name": _of(fields, b"warc-record-id"), "url": None if url is None else url.decode(), "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers": _of(fields, b"warc-refers-to"), "payload": payload}


READ = pa.schema([("name", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers", pa.string()), ("payload", pa.binary())])


def read(manifest: DataFrame, with_payload: bool = True, kinds: tuple[str, ...] = ("response", "revisit")) -> DataFrame:
    """(name, url, record_type, payload_bytes, payload_digest, refers, payload): the records of normalised archives.

    ``name`` and ``refers`` are the ids of the record and of the one it refers to. The index is dealt by ranges of
    bytes, so that many tasks read one archive and each reads its range forward.
    """
    spark = manifest.sparkSession
    one = manifest.agg(F.max("index").alias("some"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes")).first()
    fields = READ if with_payload else pa.schema(list(READ)[:-1])
    if one["some"] is None:
        return spark.createDataFrame([], ", ".join(f"{f.name} {'bigint' if pa.types.is_integer(f.type) else f.type}" for f in fields))
    lines = spark.read.schema(INDEX).option("pathGlobFilter", "*.cdx").csv(one["some"].rsplit("/", 1)[0])
    stem = lambda path: F.regexp_extract(path, r"([^/]+)\.cdx$", 1)
    entries = lines.select("offset", "length", stem(F.col("_metadata.file_path")).alias("stem"))
    entries = entries.join(manifest.select("archive", stem(F.col("index")).alias("stem")), "stem")
    part = F.floor(F.col("offset") / TASK_BYTES).alias("part")
    n = max(spark.sparkContext.defaultParallelism, 2 * one["n_bytes"] // TASK_BYTES)
    dealt = entries.select("archive", "offset", "length", part).repartition(int(n), "archive", "part").sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stream, rows, held = None, None, [], 0
        for b in batches:
            for archive, offset, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != path:
                    if stream:
                        stream.close()
                    fs, name = opened(archive)
                    path, stream = archive, fs.open_input_file(name)
                record = zlib.decompress(stream.read_at(length, offset), 31)
                row = parsed(record)
                if row["record_type"] in kinds:
                    rows.append(row if with_payload else {k: v for k, v in row.items() if k != "payload"})
                    held += len(record)
                if held > 16 << 20 or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, fields)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, fields)
        if stream:
            stream.close()

    return dealt.mapInArrow(run, ", ".join(f"{f.name} {'bigint' if pa.types.is_integer(f.type) else f.type}" for f in fields))


def op12_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    top = scratch(spark, "warc")
    write_archives(pages, f"{top}/whole")
    found = read(normalise(spark, f"{top}/whole", f"{top}/members"), with_payload=False)
    kind = pages.schema["page_id"].dataType
    return found.select(F.col("name").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"))


SQL = f"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_BYTES} THEN max(page_id) OVER (PARTITION BY payload_bytes, payload_digest) END AS largest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to FROM m
"""
