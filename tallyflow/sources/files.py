"""Readers and writers: CSV, JSON, XML and Parquet records, format detection, quarantine, checksums."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.functions.tables import cut
from tallyflow.sources.records import COLUMNS, RECORD, bad_side, clean_side, contract_projection, judged, normalised

TEXT = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
EXTENSIONS = ("csv", "json", "xml")


def detect_format(spark: SparkSession, path: str) -> str:
    """csv, json or xml from the first characters of the content, else from the name, else csv."""
    head = spark.read.text(path, wholetext=False).limit(1).select(F.ltrim(F.regexp_replace(F.substring("value", 1, 200), "^﻿", ""))).first()
    start = head[0] if head else ""
    if start.startswith("<"):
        return "xml"
    if start[:1] in ("{", "["):
        return "json"
    end = path.rstrip("/").rpartition(".")[2].lower()
    return end if end in EXTENSIONS else "csv"


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text; lists are quoted JSON. The header names the columns."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=False).select("*", *_origin())


def _origin() -> list[Column]:
    """What records.numbered() finds a row's number in its file by."""
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")]


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text files cut at every closing brace, which Spark splits at any size: value (without the brace) and its place."""
    return spark.read.text(path, lineSep="}").select("value", *_origin())


def _starting_with(spark: SparkSession, path: str | list[str]) -> tuple[list[str], list[str]]:
    """The files whose first character opens a list, and the others that aren't empty, as patterns that match them alone."""
    first = F.min_by(F.ltrim(F.regexp_replace(F.substring("value", 1, 200), r"^\ufeff|\s+", "")), "_id").alias("start")
    found = _pieces(spark, path).where("_block = 0").groupBy("_file").agg(first).collect()  # a row a file, as in Spark's own list
    named = {r["_file"]: re.sub(r"([\[\]{}*?\\,])", r"\\\1", unquote(r["_file"])) for r in found}
    lists = [named[r["_file"]] for r in found if r["start"].startswith("[")]
    return lists, [n for n in named.values() if n not in set(lists)]


def read_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A top-level array; an object with a list of objects, of which records comes first, then data, then the first other;
    an object of one object; one object; or one object a line. Values come as text.

    Arrays are read by as many tasks as their size asks for (see read_json_array); other files are a row each.
    """
    lists, others = _starting_with(spark, path)
    sides = [f(spark, p) for f, p in ((read_json_array, lists), (read_json_whole, others)) if p]
    if not sides:
        kind = ", ".join(f"`{c}` string" for c in COLUMNS)
        return spark.createDataFrame([], f"{kind}, _file string, _row bigint")
    return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])


def read_json_array(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files of one top-level array of objects, of any size; columns as those of read_json().

    A file is cut at closing braces. Whether a piece begins within a string, and how deep, follows from the quotes and
    braces before it: those of its own block of the file are summed in order, and a row a block carries what the blocks
    before add up to. Pieces from depth 0 to the next depth 0 are a record. An object that isn't a record's JSON gives a
    row of nulls with its number. A file's last piece is what follows its last closing brace; of an array that breaks off,
    the objects before that piece come.
    """
    block, order = ["_file", "_block"], Window.partitionBy("_file", "_block").orderBy("_id")
    before, earlier = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    rows = _pieces(spark, path).withColumn("quotes", quotes.cast("bigint")).withColumn("quoted", F.coalesce(F.sum("quotes").over(before), F.lit(0)))

    def deeper(odd: int) -> Column:
        """Braces that a piece opens less the one that ends it, where its block began within a string (1) or not (0)."""
        inside = F.pmod(F.col("quoted") + odd, F.lit(2)) == 1
        outer = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), plain), r'(?s)"[^"]*("|$)', "")
        opened = F.length(outer) - F.length(F.replace(outer, F.lit("{"), F.lit("")))
        return opened - F.when(F.pmod(F.col("quoted") + F.col("quotes") + odd, F.lit(2)) == 0, 1).otherwise(0)

    rows = rows.withColumn("d0", deeper(0)).withColumn("d1", deeper(1))
    sums = rows.groupBy(*block).agg(F.sum("quotes").alias("q"), F.sum("d0").alias("s0"), F.sum("d1").alias("s1"), F.max("_id").alias("m"))
    odd = F.pmod(F.coalesce(F.sum("q").over(earlier), F.lit(0)), F.lit(2))
    last = F.when(F.col("_block") == F.max("_block").over(Window.partitionBy("_file")), F.col("m"))
    sums = sums.select(*block, last.alias("last"), odd.alias("odd"), F.when(odd == 1, F.col("s1")).otherwise(F.col("s0")).alias("s"))
    sums = sums.select(*block, "last", "odd", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("depth"))
    placed = rows.join(sums, block).withColumn("d", F.when(F.col("odd") == 1, F.col("d1")).otherwise(F.col("d0")))
    placed = placed.withColumn("at", F.col("depth") + F.coalesce(F.sum("d").over(before), F.lit(0)))
    placed = placed.withColumn("starts", (F.col("at") == 0).cast("int")).where("at >= 0 AND (last IS NULL OR _id <> last)")
    placed = cut(placed.select("value", *block, "_id", "at", "d", "starts", F.sum("starts").over(order).alias("nth")), "json-pieces")
    counts = placed.groupBy(*block).agg(F.sum("starts").alias("n"))
    counts = counts.select(*block, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("records"))
    numbered = placed.join(counts, block).withColumn("_row", (F.col("nth") + F.col("records")).cast("bigint"))
    body = F.when(F.col("starts") == 1, F.regexp_replace("value", r"(?s)^[^{]*", "")).otherwise(F.col("value"))
    numbered = numbered.select("_file", "_row", "_block", "_id", "starts", (F.col("at") + F.col("d")).alias("ends"), F.concat(body, F.lit("}")).alias("text"))
    # Most records are one piece; the pieces of the others are brought together, a record at a time.
    single = numbered.where("starts = 1 AND ends = 0").select("_file", "_row", "text")
    several = numbered.where("starts = 0 OR ends <> 0").groupBy("_file", "_row")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_id", "text"))), lambda x: x["text"]), "")
    several = several.agg(joined.alias("text"), F.max((F.col("ends") == 0).cast("int")).alias("whole")).where("whole = 1").drop("whole")
    record = ", ".join(f"`{c}` string" for c in COLUMNS)
    return single.unionByName(several).select(F.from_json("text", record).alias("r"), "_file", "_row").select("r.*", "_file", "_row")


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Rows as text files of one JSON array each, a file a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for b in batches:
            lines = []
            for line in b.column(0).to_pylist():
                lines.append(mark + line)
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"])], ["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(run, "value string").write.text(path)


def read_json_whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files of any of the shapes that read_json() names, a row each."""
    record = ", ".join(f"`{c}` string" for c in COLUMNS)
    kind = f"struct<{record.replace('` ', '`:')}>"
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_file"))
    text = F.trim(F.regexp_replace("value", "^﻿", ""))
    keyed = F.from_json(text, "map<string,string>")
    own = F.exists(F.map_keys(keyed), lambda k: k.isin(*COLUMNS))
    inner = F.coalesce(keyed["records"], keyed["data"], F.get(F.filter(F.map_values(keyed), lambda v: F.substring(v, 1, 1).isin("[", "{")), F.lit(0)))
    nested = F.when(F.startswith(inner, F.lit("[")), F.from_json(inner, f"array<{kind}>")).when(inner.isNotNull(), F.array(F.from_json(inner, record)))
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, record))
    one = F.array(F.from_json(text, record))
    several = F.regexp_like(text, F.lit(r"(?s)^\{.*\}[ \t\r]*\n\s*\{"))
    rows = F.when(text.startswith("["), F.from_json(text, f"array<{kind}>")).when(keyed.isNotNull() & ~F.coalesce(own, F.lit(False)) & nested.isNotNull(), nested)
    rows = rows.when(several, lines).otherwise(one)
    return whole.where(F.regexp_like(text, F.lit(r"\S"))).select("_file", F.posexplode(rows).alias("_at", "r")).select("r.*", "_file", (F.col("_at") + 1).cast("bigint").alias("_row"))


LISTS = [f.name for f in RECORD.fields if isinstance(f.dataType, T.ArrayType)]


def _listed(name: str, items: Column) -> Column:
    return F.to_json(F.transform(items, lambda x: x.cast("double")) if name.endswith("amounts") else items).alias(name)


def read_xml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """<record> elements; nested children become JSON lists."""
    rows = spark.read.format("xml").option("rowTag", "record").option("ignoreNamespace", True).option("inferSchema", False).load(path if isinstance(path, str) else ",".join(path))
    kinds = dict(rows.dtypes)
    out = []
    for c in COLUMNS:
        if c not in kinds:
            out.append(F.lit(None).cast("string").alias(c))
        elif kinds[c].startswith("struct"):
            inner = rows.schema[c].dataType.fieldNames()[0]
            inside = F.col(c)[inner]
            out.append(_listed(c, inside if isinstance(rows.schema[c].dataType[inner].dataType, T.ArrayType) else F.array(inside)))
        elif kinds[c].startswith("array"):
            out.append(_listed(c, F.col(c)))
        elif c in LISTS:  # one element, or JSON text
            text = F.col(c).cast("string")
            out.append(F.when(F.ltrim(text).startswith("["), text).when(text.isNotNull(), _listed(c, F.array(text))).alias(c))
        else:
            out.append(F.col(c).cast("string").alias(c))
    return rows.select(*out, *_origin())


READERS = {"csv": read_csv, "json": read_json, "xml": read_xml}


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Record files, whichever of them stores lists as JSON text, in one typed schema."""
    return normalised(spark.read.option("mergeSchema", True).parquet(*paths))


def ingest(spark: SparkSession, path: str, out: str, quarantine: str, kind: str | None = None, job: str | None = None) -> dict[str, int]:
    """Read, validate, and add clean rows as Parquet and the others as JSON lines. Returns the two counts.

    The source is read and judged once. A job writes both sides to hidden folders and then gives them their names,
    job=<id>, so that readers see all of a job's rows or none, and says so in the run log (see jobs()). A job that was
    done before adds nothing; one that broke off is done again from its start.
    """
    job = job or uuid.uuid4().hex
    log = RunLog(spark, out)
    if (done := log.done(job)) is not None:
        return done
    log.add(job, path, "running")
    try:
        seen = Observation(f"judged-{job}")
        clean, bad = (F.count(F.when(F.size("errors") == 0, 1)), F.count(F.when(F.size("errors") > 0, 1)))
        marked = judged(READERS[kind or detect_format(spark, path)](spark, path)).observe(seen, clean.alias("clean"), bad.alias("bad")).persist()
        try:
            contract_projection(normalised(clean_side(marked))).write.mode("overwrite").parquet(f"{out}/_staged-{job}")
            counts = {"clean": int(seen.get["clean"]), "quarantined": int(seen.get["bad"])}
            if counts["quarantined"]:
                bad_side(marked).write.mode("overwrite").json(f"{quarantine}/_staged-{job}")
        finally:
            marked.unpersist()
        for top in (quarantine,) * bool(counts["quarantined"]) + (out,):
            log.named(f"{top}/_staged-{job}", f"{top}/job={job}")
    except Exception as e:
        log.add(job, path, "failed", error=str(e).splitlines()[0][:500])
        raise
    log.add(job, path, "done", **counts)
    return counts


class RunLog:
    """The run log of an output folder: a small JSON file for each state that a job came to, in <out>/_runs."""

    def __init__(self, spark: SparkSession, out: str) -> None:
        hadoop = spark._jvm.org.apache.hadoop.fs
        self.spark, self.path, self.at = spark, hadoop.Path, f"{out}/_runs"
        self.fs = hadoop.Path(out).getFileSystem(spark._jsc.hadoopConfiguration())

    def add(self, job: str, source: str, status: str, **more: object) -> None:
        """A state's file has the job's name and the state in its own, so adding it again leaves one."""
        line = json.dumps({"job": job, "source": source, "status": status, "at": time.time(), **more}) + "\n"
        stream = self.fs.create(self.path(f"{self.at}/{job}-{status}.json"), True)
        stream.write(bytearray(line.encode()))
        stream.close()

    def done(self, job: str) -> dict[str, int] | None:
        """The counts of a job that is done."""
        if not self.fs.exists(self.path(f"{self.at}/{job}-done.json")):
            return None
        row = json.loads(self.spark.read.text(f"{self.at}/{job}-done.json").first()[0])
        return {"clean": row["clean"], "quarantined": row["quarantined"]}

    def named(self, staged: str, name: str) -> None:
        """Give a staged folder its name, in place of what a job that broke off had left there."""
        self.fs.delete(self.path(name), True)
        if not self.fs.rename(self.path(staged), self.path(name)):
            raise OSError(f"{staged} can't be renamed to {name}")


RUNS = "job string, source string, status string, at double, clean bigint, quarantined bigint, error string"


def jobs(spark: SparkSession, out: str) -> DataFrame:
    """(job, source, status, at, clean, quarantined, error): the last state of each ingest job of an output folder."""
    log = RunLog(spark, out)
    states = spark.read.schema(RUNS).json(log.at) if log.fs.exists(log.path(log.at)) else spark.createDataFrame([], RUNS)
    last = F.max_by(F.struct(*states.columns), "at").alias("s")
    return states.groupBy("job").agg(last).select("s.*")


def ingest_folder(spark: SparkSession, folder: str, out: str, quarantine: str) -> dict[str, int]:
    """All files of the three kinds in a folder."""
    total = {"clean": 0, "quarantined": 0}
    hadoop = spark._jvm.org.apache.hadoop.fs
    for kind in EXTENSIONS:
        pattern = hadoop.Path(f"{folder}/*.{kind}")
        if pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern):
            done = ingest(spark, f"{folder}/*.{kind}", out, quarantine, kind)
            total = {k: total[k] + done[k] for k in total}
    return total


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, row bigint, error string, raw string").option("recursiveFileLookup", True).json(path)


def write_records(df: DataFrame, path: str, kind: str) -> None:
    """Records as CSV (lists as JSON), JSON lines or XML."""
    if kind == "csv":
        df.select(*[F.to_json(c).alias(c) if c in LISTS else F.col(c) for c in df.columns]).write.csv(path, header=True, quote='"', escape='"')
    elif kind == "json":
        df.write.json(path)
    else:
        df.write.format("xml").option("rowTag", "record").option("rootTag", "records").save(path)


#: Larger files than this are hashed as streams: they fit in no row.
WHOLE = 256 << 20


def checksums(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """(path, sha256) of whole files. One of over ``whole`` bytes is read as a stream, in pieces, by one task.
    Empty files have no row: Spark's readers pass over them."""
    found = spark.read.format("binaryFile").load(path)
    small = found.where(F.col("length") <= whole).select("path", F.sha2("content", 256).alias("sha256"))
    return small.unionByName(found.where(F.col("length") > whole).select("path").mapInArrow(_hashed, "path string, sha256 string"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sums = []
        for path in b.column(0).to_pylist():
            local = path.startswith("file:")
            system, name = (pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if local else pafs.FileSystem.from_uri(path)
            done = hashlib.sha256()
            with system.open_input_stream(name) as stream:
                while piece := stream.read(4 << 20):
                    done.update(piece)
            sums.append(done.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.string())], ["path", "sha256"])


def verify_checksums(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """(path, ok) against ``known`` (name, sha256)."""
    found = checksums(spark, path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return found.join(known.withColumnRenamed("sha256", "expected"), "name").select("name", (F.col("sha256") == F.col("expected")).alias("ok"))


def write_results(df: DataFrame, path: str, clean: str) -> None:
    """Results as Parquet, never into the folder of clean records."""
    df.write.mode("overwrite").parquet(guard_output(path, clean))


def guard_output(path: str, clean: str) -> str:
    """Results never go into the folder of clean records."""
    if f"{path.rstrip('/')}/".startswith(f"{clean.rstrip('/')}/"):
        raise ValueError(f"{path} lies in the clean zone")
    return path
