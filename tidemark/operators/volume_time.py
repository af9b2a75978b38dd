"""Volume as a clock: buckets of equal volume, over which one trade may be split, and the imbalance of their sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.recurrence import linear_scan

#: Share of a bucket by which its edges may be off, since running volumes are rounded.
SLACK = 1e-9


def tick_signed(trades: DataFrame) -> DataFrame:
    """`trades` (symbol, ts, seq, price, size) with `side`: the sign of the last change of price, 0 before the first."""
    x = linear_scan(trades, "symbol", ["ts", "seq"], "_p", F.lit(0.0), F.col("price"), F.col("price"))
    moved = F.signum(F.col("price") - F.col("_p_before"))
    moved = F.when(F.col("_p_before").isNull(), 0.0).when(moved != 0, moved)
    x = linear_scan(x.drop("_p"), "symbol", ["ts", "seq"], "side", F.lit(0.0), moved, moved)
    return x.withColumn("side", F.coalesce("side", F.lit(0.0))).drop("_p_before", "side_before")


def volume_buckets(trades: DataFrame, n: int) -> DataFrame:
    """(symbol, bucket, ts, seq, side, part, last): the part of each trade's volume in each of n buckets of its symbol's volume.

    A trade is an interval on the running volume, which is a scan in blocks, so a symbol's trades
    spread over tasks; it is in every bucket that its interval meets. `last`: the bucket ends in it. Trades without a positive size are
    left out. The rows are trades plus bucket edges. Volumes are counted in n-ths, so whole sizes are exact.
    """
    x = trades.where(F.col("size") > 0).withColumn("_v", F.col("size").cast("double") * n)
    x = linear_scan(x, "symbol", ["ts", "seq"], "_to", F.lit(1.0), F.col("_v"), F.col("_v"))
    total = x.groupBy("symbol").agg(F.sum("size").cast("double").alias("_w"))
    x = x.join(total, "symbol").withColumn("_from", F.coalesce("_to_before", F.lit(0.0)))
    first, last = F.floor(F.col("_from") / F.col("_w") + SLACK), F.ceil(F.col("_to") / F.col("_w") - SLACK) - 1
    x = x.withColumn("bucket", F.explode(F.sequence(F.least(first, F.lit(n - 1)), F.greatest(F.least(first, F.lit(n - 1)), F.least(last, F.lit(n - 1))))))
    part = F.least("_to", (F.col("bucket") + 1) * F.col("_w")) - F.greatest("_from", F.col("bucket") * F.col("_w"))
    ends = F.col("_to") / F.col("_w") >= F.col("bucket") + 1 - SLACK
    return x.select("symbol", "bucket", "ts", "seq", "side", (part / n).alias("part"), ends.alias("last"))


def vpin(trades: DataFrame, n: int = 50, window: int = 50) -> DataFrame:
    """`trades` (symbol, ts, seq, price, size) with `vpin`: the mean imbalance of the last `window` buckets, at the trade that ends one.

    Where several buckets end in one trade it has the greatest; a trade in which none ends has
    that of one up to `window` trades before. Null until `window` buckets have ended.
    """
    signed = tick_signed(trades)
    parts = volume_buckets(signed, n)
    # an imbalance is a partial sum, so a large trade's many buckets and a bucket's many trades are combined before the shuffle
    b = parts.groupBy("symbol", "bucket").agg(F.sum(F.col("side") * F.col("part")).alias("_s"), F.sum("part").alias("_v"), F.max(F.when(F.col("last"), F.struct("ts", "seq"))).alias("_end"))
    w = Window.partitionBy("symbol").orderBy("bucket").rowsBetween(1 - window, 0)  # n rows a symbol
    b = b.where("_end is not null").withColumn("_x", F.abs("_s") / F.col("_v"))
    rolled = b.select("symbol", "_end.ts", "_end.seq", F.when(F.count("*").over(w) == window, F.avg("_x").over(w)).alias("_r"))
    at = rolled.groupBy("symbol", "ts", "seq").agg(F.max("_r").alias("_r"))
    x = signed.drop("side").join(at, ["symbol", "ts", "seq"], "left")
    near = Window.partitionBy("symbol").orderBy("ts", "seq").rowsBetween(-window, 0)
    return x.withColumn("vpin", F.last("_r", ignorenulls=True).over(near)).drop("_r")
