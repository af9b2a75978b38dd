"""Queries that write tables to the shared folder and read them back, and the SQL of what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.common import place
from tidemark.plans.market import _r
from tidemark.sources import versions as v
from tidemark.sources.derived import BARS_SQL, bars, read

CUTS = [("IS_TRAIN", "1996-01-01"), ("IS_VALID", "1997-07-01"), ("OOS_DEV", "1999-01-01"), ("OOS_LOCKED", "2000-06-01")]


def _stored(s, d):
    path = place(s, "bars")
    v.write_partitioned(bars(s, d).withColumn("exchange", (F.col("symbol") % 5).cast("int")), path, "date", ["exchange"])
    return path


def _rows(s, d):
    l = read(s, d, "lineitem")  # noqa: E741
    return l.select(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_orderkey") % 13 != 0, 100 * (1 + F.col("l_discount").cast("double"))).alias("close"))


def _library(s, d):
    lib, x = v.Library(s, place(s, "library")), bars(s, d).select("symbol", "date", "close")
    lib.put("closes", x.where("symbol % 2 = 0"))
    lib.put("closes", x.withColumn("close", F.col("close") + 1))
    lib.put("closes", x.where("symbol % 3 = 0"))
    lib.delete("closes", 3)
    lib.put("volumes", bars(s, d).select("symbol", "date", "volume"), locked=True)
    return lib, x.schema


def _time_travel(s, d):
    lib, schema = _library(s, d)
    new = lib.read("closes", schema, start="1996-01-01", verify=True).withColumn("version", F.lit(2))
    return _r(new.unionByName(lib.read("closes", schema, version=1, end="1995-12-31").withColumn("version", F.lit(1))), "version", "symbol", "date", close="close")


QUERIES = {
    "partitioned_scan": lambda s, d: _r(v.read_partitioned(s, _stored(s, d), year=[1996, 1997], exchange=[1, 4]), "symbol", "date", "year", "exchange", close="close"),
    "partition_list": lambda s, d: v.partitions(s.read.parquet(_stored(s, d)), ["year", "exchange"]),
    "normal_bars": lambda s, d: _r(v.normal_bars(bars(s, d).select("symbol", F.col("date").cast("string").alias("Date"), F.col("open").alias("OPEN"), F.col("high").alias("High"), "low", "close", F.when(F.col("symbol") % 7 == 0, "n/a").otherwise(F.col("volume").cast("string")).alias("Volume")), "Date"), "symbol", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "volume", open="open", high="high", low="low", close="close"),
    "clean_prices": lambda s, d: _r(v.clean_prices(_rows(s, d), "symbol", "date", "seq", "close", "1995-01-01", "1998-12-31"), "symbol", "date", close="close"),
    "price_tiers": lambda s, d: bars(s, d).groupBy(v.tier(F.col("date"), CUTS).alias("tier")).agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")),
    "upto_tier": lambda s, d: _r(v.upto_tier(bars(s, d), "date", CUTS, "OOS_DEV", ("OOS_LOCKED",)), "symbol", "date", close="close"),
    "time_travel": _time_travel,
    "version_list": lambda s, d: _library(s, d)[0].versions().select("name", "version", "n", "start", "end", "locked"),
    "versions_in_window": lambda s, d: _library(s, d)[0].overlapping("closes", "1996-01-01", "1996-02-01").select("version", "n"),
    "freshness": lambda s, d: v.freshness(read(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 17 == 0, "unknown").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("created")), F.to_date(F.lit("1998-08-02")), "created").select("o_orderkey", "age", "stale"),
    "sized_files": lambda s, d: v.write_sized(bars(s, d), place(s, "sized"), ["symbol", "date"], 5000).agg(F.sum("n").alias("n"), (F.max("n") <= 5000).alias("bounded")),
}

ORACLE = {
    "partitioned_scan": f"WITH {BARS_SQL} SELECT symbol, date, CAST(year(date) AS INT) AS year, CAST(symbol % 5 AS INT) AS exchange, round(close, 6) AS close FROM bars WHERE year(date) IN (1996, 1997) AND symbol % 5 IN (1, 4)",
    "partition_list": f"WITH {BARS_SQL} SELECT DISTINCT CAST(year(date) AS INT) AS year, CAST(symbol % 5 AS INT) AS exchange FROM bars",
    "normal_bars": f"WITH {BARS_SQL} SELECT symbol, CAST(date AS TIMESTAMP) AS timestamp, CASE WHEN symbol % 7 <> 0 THEN CAST(trunc(volume) AS BIGINT) END AS volume, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close FROM bars",
    "clean_prices": "WITH r AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_orderkey * 10 + l_linenumber AS seq, 100 * (1 + CAST(l_discount AS DOUBLE)) AS close FROM lineitem WHERE l_orderkey % 13 <> 0) SELECT symbol, date, round(close, 6) AS close FROM r WHERE date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY seq DESC, close DESC) = 1",
    "price_tiers": f"WITH {BARS_SQL} SELECT CASE WHEN date < DATE '1996-01-01' THEN 'IS_TRAIN' WHEN date < DATE '1997-07-01' THEN 'IS_VALID' WHEN date < DATE '1999-01-01' THEN 'OOS_DEV' WHEN date < DATE '2000-06-01' THEN 'OOS_LOCKED' ELSE 'FORWARD' END AS tier, count(*) AS n, min(date) AS first, max(date) AS last FROM bars GROUP BY 1",
    "upto_tier": f"WITH {BARS_SQL} SELECT symbol, date, round(close, 6) AS close FROM bars WHERE date < DATE '1999-01-01'",
    "time_travel": f"WITH {BARS_SQL} SELECT CAST(2 AS INT) AS version, symbol, date, round(close + 1, 6) AS close FROM bars WHERE date >= DATE '1996-01-01' UNION ALL SELECT CAST(1 AS INT), symbol, date, round(close, 6) FROM bars WHERE symbol % 2 = 0 AND date <= DATE '1995-12-31'",
    "version_list": f"""WITH {BARS_SQL} SELECT 'closes' AS name, CAST(1 AS INT) AS version, count(*) AS n, min(date) AS start, max(date) AS "end", false AS locked FROM bars WHERE symbol % 2 = 0 UNION ALL SELECT 'closes', 2, count(*), min(date), max(date), false FROM bars UNION ALL SELECT 'volumes', 1, count(*), min(date), max(date), true FROM bars""",
    "versions_in_window": f"WITH {BARS_SQL} SELECT CAST(1 AS INT) AS version, count(*) AS n FROM bars WHERE symbol % 2 = 0 UNION ALL SELECT 2, count(*) FROM bars",
    "freshness": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 17 <> 0 THEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') END AS INT) AS age, CASE WHEN o_orderkey % 17 = 0 THEN true ELSE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') > 90 END AS stale FROM orders",
    "sized_files": f"WITH {BARS_SQL} SELECT count(*) AS n, true AS bounded FROM bars",
}
