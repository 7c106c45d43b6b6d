"""Shared storage for cut lineage, for operators that iterate."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables: ``spark.checkpoint.dir``.

    Where the setting is missing, a local master gets a temporary folder of its own; on a cluster that is an
    error, as executors would not see a folder of the driver.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if path is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyflow-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


_WRITTEN: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_cuts(spark: SparkSession) -> None:
    """Delete the tables that cut() wrote in this session; call it when what was built from them is stored."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def scratch(spark: SparkSession, name: str = "step") -> str:
    """A new path in the shared folder; drop_cuts() deletes what is written there."""
    _WRITTEN.append(path := f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return path


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write as Parquet to the shared folder and read back: a short lineage that survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


#: A bucket holds about so many rows.
ROWS_A_BUCKET = 250_000


def bucketed(df: DataFrame, by: str | list[str], name: str = "step", rows: int | None = None, buckets: int | None = None) -> DataFrame:
    """Like cut(), with equal values of ``by`` in one bucket: joins and groups by it read it without a shuffle.

    There are as many buckets as the session has shuffle partitions or, where the number of ``rows`` is given, as hold
    ROWS_A_BUCKET each: a small table that many steps read then costs each of them few tasks. Tables of equally many
    ``buckets`` are joined without a shuffle of either.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    n = buckets or (int(spark.conf.get("spark.sql.shuffle.partitions")) if rows is None else max(1, -(-rows // ROWS_A_BUCKET)))
    by = [by] if isinstance(by, str) else by
    df.repartition(n, *by).write.bucketBy(n, *by).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._cut, out._table = path, table
    return out


#: A task sorts or groups about so many rows at most where a step's rows are known.
ROWS_A_TASK = 2_000_000


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` by ``by`` in as many partitions as give each ROWS_A_TASK of its ``rows``, where the session has fewer of them.

    The session's number of shuffle partitions is fixed, so a task's memory would else grow with the table.
    """
    n = -(-rows // ROWS_A_TASK)
    return df.repartition(n, *by) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that cut() wrote and nothing reads any more, as a loop does with those of the step before."""
    for t in tables:
        if (path := getattr(t, "_cut", None)) in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(t.sparkSession, path)
            if name := getattr(t, "_table", None):
                t.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


class Growing:
    """A table that a loop appends to, each step in a folder of its own; one plan reads it all, however many steps."""

    def __init__(self, spark: SparkSession, name: str, step: str) -> None:
        self.spark, self.step, self.path, self.schema = spark, step, scratch(spark, name), None

    def add(self, df: DataFrame, at: int, by: list[str] | None = None) -> DataFrame:
        """Write the rows of step ``at`` and read them back; ``by`` names columns that they are further dealt to folders by."""
        path = f"{self.path}/{self.step}={at}"
        df.write.partitionBy(*(by or [])).parquet(path)
        self.schema = StructType([*df.schema.fields, StructField(self.step, IntegerType())])
        return self.spark.read.schema(df.schema).parquet(path)

    def spread(self, df: DataFrame) -> None:
        """Write all rows at once, dealt to folders by their own column of the step."""
        df.write.partitionBy(self.step).parquet(self.path)
        self.schema = df.schema

    def all(self, columns: str | None = None) -> DataFrame:
        """All rows, with the column of the step; ``columns`` names the others where nothing may have been added yet."""
        if self.schema is None:
            return self.spark.createDataFrame([], f"{columns}, {self.step} int")
        return self.spark.read.schema(self.schema).parquet(self.path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
