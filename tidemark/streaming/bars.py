"""Bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.common import place


def stream_bars(ticks: DataFrame, every: str, late: str) -> DataFrame:
    """Open windows of a tick stream; ticks later than `late` behind the newest are dropped by the watermark."""
    order = F.struct("ts", "seq")
    rows = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", every).alias("w"))
    sums = rows.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("n"))
    return sums.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "n")


def replayed(bars: DataFrame) -> DataFrame:
    """Run a bar stream over all that its source holds now and read the newest state of every window.

    Each micro-batch overwrites a folder of its own, so a batch that is run again changes nothing.
    """
    spark = bars.sparkSession
    out, state = place(spark, "bars"), place(spark, "state")

    def sink(batch: DataFrame, k: int) -> None:
        batch.withColumn("_batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/k={k}")

    bars.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    rows = spark.read.option("basePath", out).parquet(f"{out}/k=*").drop("k")
    last = F.row_number().over(Window.partitionBy("symbol", "start").orderBy(F.desc("_batch")))
    return rows.withColumn("_r", last).where("_r = 1").drop("_r", "_batch")
