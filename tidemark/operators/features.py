"""Window features over (key, date): null until a window is full, one shuffle by key for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def by(key: str, *order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*order)


def full(value: Column, w: WindowSpec, n: int, over: str) -> Column:
    """`value` over the last n rows where all n are there."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(over).over(frame) == n, value.over(frame))


def returns(df: DataFrame, key: str = "symbol", ts: str = "date", price: str = "close") -> DataFrame:
    """Simple return to the previous row; null on a key's first row or a zero base."""
    past = F.lag(price).over(by(key, ts))
    return df.withColumn("ret", F.col(price) / F.nullif(past, F.lit(0.0)) - 1)


def rolling_stats(df: DataFrame, n: int, col: str, key: str = "symbol", ts: str = "date") -> DataFrame:
    w = by(key, ts)
    return df.withColumns({f"{k}_{n}": full(f(col), w, n, col) for k, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))})


def bollinger(df: DataFrame, n: int, width: float, price: str = "close", key: str = "symbol", ts: str = "date") -> DataFrame:
    """Bands at `width` population deviations."""
    w = by(key, ts)
    mid, dev = full(F.avg(price), w, n, price), full(F.stddev_pop(price), w, n, price)
    return df.withColumns({"mid": mid, "upper": mid + width * dev, "lower": mid - width * dev})


def average_true_range(df: DataFrame, n: int, key: str = "symbol", ts: str = "date") -> DataFrame:
    past = F.lag("close").over(by(key, ts))
    spread = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - past), F.abs(F.col("low") - past))
    df = df.withColumn("tr", spread)
    return df.withColumn("atr", full(F.avg("tr"), by(key, ts), n, "tr"))


def momentum(df: DataFrame, n: int, skip: int = 0, price: str = "close", key: str = "symbol", ts: str = "date") -> DataFrame:
    w = by(key, ts)
    return df.withColumn("mom", F.lag(price, skip).over(w) / F.nullif(F.lag(price, n + skip).over(w), F.lit(0.0)) - 1)


def signed_streak(df: DataFrame, col: str = "ret", key: str = "symbol", ts: str = "date") -> DataFrame:
    """Length of the current run of one sign, with that sign; 0 for zero or null."""
    w = by(key, ts)
    sign = F.coalesce(F.signum(col), F.lit(0.0)).cast("int")
    df = df.withColumn("_sign", sign).withColumn("_new", (F.col("_sign") != F.coalesce(F.lag("_sign").over(w), F.lit(2))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return df.withColumn("streak", F.col("_sign") * F.row_number().over(Window.partitionBy(key, "_run").orderBy(ts))).drop("_sign", "_new", "_run")


def cross_signal(df: DataFrame, fast: int, slow: int, price: str = "close", key: str = "symbol", ts: str = "date") -> DataFrame:
    """Weight 1, 0 or -1: the sign of the fast average less the slow one, 0 until both are full."""
    w = by(key, ts)
    return df.withColumn("w", F.coalesce(F.signum(full(F.avg(price), w, fast, price) - full(F.avg(price), w, slow, price)), F.lit(0.0)))


def cross_section(df: DataFrame, col: str, ts: str = "date") -> DataFrame:
    """Per date: population z-score and average-rank percentile in hundredths."""
    w = Window.partitionBy(ts)
    n, ties = F.count(col).over(w), F.count("*").over(Window.partitionBy(ts, col))
    rank = F.rank().over(w.orderBy(col)) + (ties - 1) / 2
    df = df.where(F.col(col).isNotNull())
    return df.withColumns({"z": (F.col(col) - F.avg(col).over(w)) / F.nullif(F.stddev_pop(col).over(w), F.lit(0.0)), "pct": 100 * rank / n})
