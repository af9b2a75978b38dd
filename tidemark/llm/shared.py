"""Places that the driver and all executors can read: files of a job that must outlive its tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (as in tests), a new local one is set."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held.rstrip("/")
    at = spark.sparkContext.getCheckpointDir()
    if at is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; reruns never meet each other's files."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, reread: its lineage ends here and lost executors cost nothing."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a written table that may go to every executor.
SMALL = 100_000


def narrow(table: DataFrame, name: str, limit: int = SMALL) -> DataFrame:
    """`table`, written; marked for broadcast where it has at most `limit` rows, else left to a shuffled join."""
    from pyspark.sql import functions as F

    table = written(table, name)
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table
