"""Directory ingest, deduplication, windows and sessions over streams, and a block ticker."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyflow.sources.files import EXTENSIONS, READERS, TEXT
from tallyflow.sources.records import contract_projection, normalised, split


def watch_csv(spark: SparkSession, folder: str) -> DataFrame:
    """New CSV files of a folder as text rows. The checkpoint remembers paths: a changed file isn't read again."""
    return spark.readStream.schema(TEXT).option("header", True).option("escape", '"').csv(folder).withColumn("_file", F.col("_metadata.file_path"))


def watch_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, changed, length) of the folder's record files, of any of the three kinds, as they arrive; for ingest_files()."""
    pattern = "*.{" + ",".join(EXTENSIONS) + "}"
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).load(folder).select("path", F.col("modificationTime").alias("changed"), "length")


def _run(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream, which Spark keeps in the checkpoint: the same after a restart, another for another checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def _store(clean: DataFrame, bad: DataFrame, out: str, quarantine: str, part: str) -> None:
    contract_projection(normalised(clean)).write.mode("overwrite").parquet(f"{out}/{part}")
    bad.write.mode("overwrite").json(f"{quarantine}/{part}")


def ingest(raw: DataFrame, out: str, quarantine: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Clean rows to Parquet and the others to JSON, a batch at a time, each in its own folder stream=<id>/batch=<number>.

    What a batch wrote before it failed is written over when it is tried again, so no row is there twice; the batches of
    other streams, and those of this one under an older checkpoint, stay as they are.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.persist()
        _store(*split(rows), out, quarantine, f"stream={_run(rows.sparkSession, checkpoint)}/batch={batch}")
        rows.unpersist()

    return _started(raw, write, checkpoint, once)


def ingest_files(files: DataFrame, out: str, quarantine: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Ingest of watch_files(): each batch's files are read by the reader of their kind. The stream itself carries names
    only, so a batch is as large as Spark makes it."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        paths = [r.path for r in rows.select("path").collect()]  # the names of one batch's files
        parts = [split(READERS[k](spark, mine)) for k in EXTENSIONS if (mine := [p for p in paths if p.lower().endswith(f".{k}")])]
        if parts:
            clean, bad = (reduce(DataFrame.unionByName, side) for side in zip(*parts, strict=True))
            _store(clean, bad, out, quarantine, f"stream={_run(spark, checkpoint)}/batch={batch}")

    return _started(files, write, checkpoint, once)


def _started(stream: DataFrame, write, checkpoint: str, once: bool) -> StreamingQuery:
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="30 seconds")).start()


def table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """One Parquet table of a folder as a stream of its files."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")


def deduplicated(stream: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, ts: str, span: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Counts and sums of ``value`` in fixed windows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, span), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, ts: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """Counts in sessions that end after a gap."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "complete") -> None:
    """Run over what is there now and leave the result as a Parquet table at ``out``."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def block_ticker(spark: SparkSession, start: int = 800_000, per_second: int = 1) -> DataFrame:
    """(height, block_time) from the rate source: heights go up by one, block times by 600 seconds."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rate.select((F.lit(start) + F.col("value")).alias("height"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("value") * 600).alias("block_time"))
