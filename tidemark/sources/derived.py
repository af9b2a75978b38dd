"""Market tables derived from the driver's tables, and the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.common import dealt


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (symbol, date, open, high, low, close, volume) from `lineitem`."""
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    price = 100 * (1 + F.col("l_discount").cast("double") - F.col("l_tax").cast("double"))
    lines = read(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), seq.alias("seq"), price.alias("price"), F.col("l_quantity").cast("double").alias("qty"))
    return dealt(rows, lines.count(), "symbol", "date").groupBy("symbol", "date").agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("qty").alias("volume"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick tape (symbol, ts, seq, kind, venue, price, size) from `events`."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), (F.col("user_id") % 5).alias("venue"), (100 + F.col("value").cast("double")).alias("price"), (1 + k).cast("long").alias("size"))


BARS_SQL = """rows_ AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_orderkey * 10 + l_linenumber AS seq,
  100 * (1 + CAST(l_discount AS DOUBLE) - CAST(l_tax AS DOUBLE)) AS price, CAST(l_quantity AS DOUBLE) AS qty FROM lineitem),
bars AS (SELECT symbol, date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(qty) AS volume FROM rows_ GROUP BY symbol, date)"""

TICKS_SQL = """ticks AS (SELECT user_id % 20 AS symbol, ts, event_id AS seq, event_type AS kind, user_id % 5 AS venue,
  100 + CAST(value AS DOUBLE) AS price, 1 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS size FROM events)"""
