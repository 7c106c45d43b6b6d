"""A streaming source of a folder's files, new ones and those that were written again, and an ingest that replaces their rows.

An offset is a time and the files changed at that very time that were seen, so it doesn't grow with the folder. A file
whose time of change is later than the offset is read again, once. Folders are listed with pyarrow's file systems.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from tallyflow.sources.files import EXTENSIONS, READERS
from tallyflow.sources.records import bad_side, clean_side, contract_projection, judged, normalised

SCHEMA = "path string, changed bigint, length bigint"


class ChangedFiles(DataSource):
    """(path, changed, length) of the files of a folder whose names end as ``pattern`` says; changed in nanoseconds."""

    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):  # noqa: N802
        return ChangedReader(self.options["path"], self.options.get("pattern", ".*"))


class Slice(InputPartition):
    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows


class ChangedReader(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str) -> None:
        self.folder, self.pattern = folder, re.compile(pattern)

    def _files(self) -> list[tuple[int, str, int]]:
        """(changed, path, length) in the order of change."""
        plain = "/" + self.folder[5:].lstrip("/") if self.folder.startswith("file:") else self.folder
        files, at = (pafs.LocalFileSystem(), plain) if "://" not in plain else pafs.FileSystem.from_uri(plain)
        found = files.get_file_info(pafs.FileSelector(at, recursive=True))
        return sorted((f.mtime_ns, f.path, f.size) for f in found if f.type == pafs.FileType.File and self.pattern.search(f.path) and not f.base_name.startswith(("_", ".")))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": -1, "seen": "[]"}

    def latestOffset(self) -> dict:  # noqa: N802
        files = self._files()
        if not files:
            return self.initialOffset()
        return {"at": files[-1][0], "seen": json.dumps([p for t, p, _ in files if t == files[-1][0]])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """The files changed after ``start`` up to ``end``."""
        before, within = json.loads(start["seen"]), json.loads(end["seen"])
        rows = [(p, t, n) for t, p, n in self._files() if (t > start["at"] or t == start["at"] and p not in before) and (t < end["at"] or t == end["at"] and p in within)]
        return [Slice(rows[i : i + 10_000]) for i in range(0, len(rows), 10_000)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        yield from partition.rows


def watch_changed(spark: SparkSession, folder: str) -> DataFrame:
    """The folder's record files as they arrive and as they are written again."""
    spark.dataSource.register(ChangedFiles)
    return spark.readStream.format("changed_files").option("pattern", rf"\.({'|'.join(EXTENSIONS)})$").load(folder)


def ingest_changed(files: DataFrame, out: str, quarantine: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Ingest of watch_changed(): a file's clean rows and quarantine are in folders of its own, file=<hash of its path>.

    When a file was written again, its new rows take the place of its old ones, on both sides. A batch that is tried again
    does the same again.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        paths = [r.path for r in rows.select("path").distinct().collect()]  # the names of one batch's files
        hadoop = spark._jvm.org.apache.hadoop.fs
        own = {r.p: r.f for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", _folder(F.col("p")).alias("f")).collect()}
        for top in (out, quarantine):
            for folder in own.values():
                at = hadoop.Path(f"{top}/file={folder}")
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        for kind in EXTENSIONS:
            mine = [p for p in paths if p.lower().endswith(f".{kind}")]
            if mine:
                marked = judged(READERS[kind](spark, mine)).withColumn("file", _folder(_plain(F.col("_file")))).persist()
                clean = clean_side(marked, keep=["file"])
                contract = contract_projection(normalised(clean))
                normalised_with = clean.select("file", *contract.columns)
                normalised_with.write.partitionBy("file").mode("append").parquet(out)
                bad = bad_side(marked)
                bad.withColumn("_f", _folder(_plain(F.col("file")))).withColumnsRenamed({"file": "source", "_f": "file"}).write.partitionBy("file").mode("append").json(quarantine)
                marked.unpersist()

    query = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="30 seconds")).start()


def _plain(path):
    """A path without its scheme, percent-encoding decoded, as the source names it."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^file:/+", "/")


def _folder(path):
    return F.substring(F.sha2(path, 256), 1, 32)
