"""Places that the driver and all executors can read: files of a job that must outlive its tasks."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and executors are on this machine (as in tests), a new local one is set. Elsewhere executors could not see that one, so this fails."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held.rstrip("/")
    at = spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; reruns never meet each other's files."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


#: A task is dealt about this many rows where tables are large.
ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` dealt by `keys` over partitions that grow with `rows`, so that what a task holds doesn't; as it is where one task may hold all rows.

    The number is given even where the session's own is larger: Spark would merge its partitions again by their compressed bytes, and combine whole splits of the input before the shuffle.
    """
    n = math.ceil(rows / ROWS)
    if n <= 1:
        return df
    spark = df.sparkSession
    return df.repartition(max(n, min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))), *keys)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, reread: its lineage ends here and lost executors cost nothing."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(name: str):
    """A file of the shared folder for reading in a task, by its escaped URI (`_metadata.file_path`); the store must be one that pyarrow opens (local or shared folders, HDFS, S3, GCS)."""
    from pyarrow import fs

    if name.startswith("file:/"):
        return fs.LocalFileSystem().open_input_file(unquote(re.sub(r"^file:/*", "/", name)))
    store, at = fs.FileSystem.from_uri(quote(unquote(name), safe=":/@?=&"))
    return store.open_input_file(at)
