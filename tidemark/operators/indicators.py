"""Indicators over (symbol, date): null until their window is full; all windows of one call share one shuffle by key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import by, full

YEAR = 252


def _over(x: Column, zero_null: Column) -> Column:
    return x / F.nullif(zero_null, F.lit(0.0))


def weighted_average(df: DataFrame, n: int, col: str = "close", key: str = "symbol", ts: str = "date") -> DataFrame:
    """Linear weights n..1, the newest row heaviest."""
    w = by(key, ts)
    total = sum(((n - k) * F.lag(col, k).over(w) for k in range(1, n)), n * F.col(col))
    return df.withColumn("wma", total / (n * (n + 1) / 2))


def simple_rsi(df: DataFrame, n: int, col: str = "close", key: str = "symbol", ts: str = "date") -> DataFrame:
    """100 where nothing was lost, 50 where nothing moved."""
    w = by(key, ts)
    df = df.withColumn("_d", F.col(col) - F.lag(col).over(w)).withColumns({"_g": F.greatest("_d", F.lit(0.0)), "_l": F.greatest(-F.col("_d"), F.lit(0.0))})
    df = df.withColumns({"_d": full(F.avg("_d"), w, n, "_d"), "_g": F.avg("_g").over(w.rowsBetween(1 - n, 0)), "_l": F.avg("_l").over(w.rowsBetween(1 - n, 0))})
    value = F.when(F.col("_l") > 0, 100 - 100 / (1 + F.col("_g") / F.col("_l"))).when(F.col("_g") > 0, 100.0).otherwise(50.0)
    return df.withColumn("rsi", F.when(F.col("_d").isNotNull(), value)).drop("_d", "_g", "_l")


def channels(df: DataFrame, n: int, key: str = "symbol", ts: str = "date") -> DataFrame:
    """Highest high, lowest low, stochastic and Williams position; null where the range is zero."""
    w = by(key, ts)
    df = df.withColumns({"upper": full(F.max("high"), w, n, "high"), "lower": full(F.min("low"), w, n, "low")})
    span = F.col("upper") - F.col("lower")
    return df.withColumns({"stochastic": _over(100 * (F.col("close") - F.col("lower")), span), "williams": _over(-100 * (F.col("upper") - F.col("close")), span)})


def rolling_zscore(df: DataFrame, n: int, col: str = "close", key: str = "symbol", ts: str = "date") -> DataFrame:
    w = by(key, ts)
    return df.withColumn("z", _over(F.col(col) - full(F.avg(col), w, n, col), F.stddev_samp(col).over(w.rowsBetween(1 - n, 0))))


def rolling_trend(df: DataFrame, n: int, col: str = "close", key: str = "symbol", ts: str = "date") -> DataFrame:
    """Slope and R² (null where the price is constant) of the log price on time, and net change over path length."""
    w = by(key, ts)
    frame = w.rowsBetween(1 - n, 0)
    df = df.withColumns({"_x": F.row_number().over(w).cast("double"), "_y": F.log(col)})
    df = df.withColumn("_step", F.abs(F.col("_y") - F.lag("_y").over(w)))
    net, path = F.abs(F.col("_y") - F.lag("_y", n - 1).over(w)), F.sum("_step").over(w.rowsBetween(2 - n, 0))
    df = df.withColumns({"slope": full(F.regr_slope("_y", "_x"), w, n, "_y"), "r2": F.when(F.count("_y").over(frame) == n, _over(F.pow(F.covar_pop("_y", "_x").over(frame), 2), F.var_pop("_y").over(frame) * F.var_pop("_x").over(frame))), "efficiency": _over(net, path)})
    return df.drop("_x", "_y", "_step")


def range_volatility(df: DataFrame, n: int, key: str = "symbol", ts: str = "date") -> DataFrame:
    """Parkinson, Garman-Klass and Rogers-Satchell, a year's worth."""
    w = by(key, ts)
    ln = lambda a, b: F.log(F.col(a) / F.col(b))
    df = df.withColumns({
        "_p": F.pow(ln("high", "low"), 2) / (4 * math.log(2)),
        "_g": 0.5 * F.pow(ln("high", "low"), 2) - (2 * math.log(2) - 1) * F.pow(ln("close", "open"), 2),
        "_r": ln("high", "close") * ln("high", "open") + ln("low", "close") * ln("low", "open"),
    })
    year = lambda c: F.sqrt(F.greatest(full(F.avg(c), w, n, c), F.lit(0.0)) * YEAR)
    had = lambda c: F.when(full(F.avg(c), w, n, c).isNotNull(), year(c))
    return df.withColumns({"parkinson": had("_p"), "garman_klass": had("_g"), "rogers_satchell": had("_r")}).drop("_p", "_g", "_r")


def signed_volume(df: DataFrame, key: str = "symbol", ts: str = "date") -> DataFrame:
    """Volume with the sign of the last price change that was not zero; 0 before the first."""
    w = by(key, ts)
    df = df.withColumn("_s", F.signum(F.col("close") - F.lag("close").over(w)))
    carried = F.last(F.when(F.col("_s") != 0, F.col("_s")), ignorenulls=True).over(w)
    return df.withColumn("signed_volume", F.coalesce(carried, F.lit(0.0)) * F.col("volume")).drop("_s")


def flow_imbalance(df: DataFrame, n: int, key: str = "symbol", ts: str = "date") -> DataFrame:
    w = by(key, ts)
    return signed_volume(df, key, ts).withColumn("imbalance", _over(full(F.sum("signed_volume"), w, n, "signed_volume"), F.sum("volume").over(w.rowsBetween(1 - n, 0))))


def price_impact(df: DataFrame, n: int, key: str = "symbol", ts: str = "date") -> DataFrame:
    """Kyle's lambda from population moments and Amihud's ratio, per million."""
    w = by(key, ts)
    frame = w.rowsBetween(1 - n, 0)
    df = signed_volume(df, key, ts).withColumn("_d", F.col("close") - F.lag("close").over(w))
    df = df.withColumn("_a", _over(F.abs(F.col("_d") / F.lag("close").over(w)), F.col("close") * F.col("volume")))
    slope = _over(F.covar_pop("_d", "signed_volume").over(frame), F.var_pop("signed_volume").over(frame))
    return df.withColumns({"kyle": F.when(F.count("_d").over(frame) == n, slope), "amihud": 1e6 * full(F.avg("_a"), w, n, "_a")}).drop("_d", "_a")


def spread_estimates(df: DataFrame, n: int, key: str = "symbol", ts: str = "date") -> DataFrame:
    """Two-row high-low spread, floored at zero and averaged, and the spread from the covariance of successive changes."""
    w = by(key, ts)
    frame = w.rowsBetween(1 - n, 0)
    c = 3 - 2 * math.sqrt(2)
    h1, l1 = F.lag("high").over(w), F.lag("low").over(w)
    df = df.withColumns({"_b": F.pow(F.log(F.col("high") / F.col("low")), 2) + F.pow(F.log(h1 / l1), 2), "_d": F.col("close") - F.lag("close").over(w)})
    wide = F.when(h1.isNotNull(), F.pow(F.log(F.greatest(F.col("high"), h1) / F.least(F.col("low"), l1)), 2))
    df = df.withColumns({"_a": (F.sqrt(2 * F.col("_b")) - F.sqrt("_b")) / c - F.sqrt(wide / c), "_e": F.lag("_d").over(w)})
    df = df.withColumn("_s", F.when(F.col("_a").isNotNull(), F.greatest(2 * (F.exp("_a") - 1) / (1 + F.exp("_a")), F.lit(0.0))))
    cov = F.when(F.count("_e").over(frame) == n, F.covar_samp("_d", "_e").over(frame))
    return df.withColumns({"high_low": full(F.avg("_s"), w, n, "_s"), "_c": cov}).withColumn("serial", F.when(F.col("_c").isNotNull(), 2 * F.sqrt(F.greatest(-F.col("_c"), F.lit(0.0))))).drop("_a", "_b", "_c", "_d", "_e", "_s")


def forward_return(df: DataFrame, k: int, col: str = "close", key: str = "symbol", ts: str = "date") -> DataFrame:
    return df.withColumn("forward", _over(F.lead(col, k).over(by(key, ts)), F.col(col)) - 1)


def confirmed(df: DataFrame, n: int, col: str = "ret", key: str = "symbol", ts: str = "date") -> DataFrame:
    """The sign last seen n rows in a row, 0 before the first such run; nulls count as sign 0."""
    w = by(key, ts)
    frame = w.rowsBetween(1 - n, 0)
    df = df.withColumn("_s", F.coalesce(F.signum(col), F.lit(0.0)).cast("int"))
    sure = (F.count("_s").over(frame) == n) & (F.min("_s").over(frame) == F.max("_s").over(frame))
    df = df.withColumn("_k", F.when(sure, F.col("_s")))
    return df.withColumn("state", F.coalesce(F.last("_k", ignorenulls=True).over(w), F.lit(0))).drop("_s", "_k")


def candles(df: DataFrame, doji: float = 0.1, key: str = "symbol", ts: str = "date") -> DataFrame:
    """Flags 0/1 against the previous row: gaps, inside bar, engulfing; and a body small against its range."""
    w = by(key, ts)
    o, h, l, c = (F.lag(x).over(w) for x in ("open", "high", "low", "close"))
    top, low = F.greatest("open", "close"), F.least("open", "close")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    return df.withColumns({
        "gap_up": flag(F.col("low") > h), "gap_down": flag(F.col("high") < l), "inside": flag((F.col("high") < h) & (F.col("low") > l)),
        "engulfing": flag((top > F.greatest(o, c)) & (low < F.least(o, c)) & (F.signum(F.col("close") - F.col("open")) == -F.signum(c - o))),
        "doji": flag(top - low <= doji * (F.col("high") - F.col("low"))),
    })


def calendar(df: DataFrame, head: int = 3, tail: int = 1, key: str = "symbol", ts: str = "date") -> DataFrame:
    """ISO weekday, rows left in the month, and whether a row is among a month's first `head` or last `tail`."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key, F.trunc(ts, "month"))
    df = df.withColumns({"_k": F.row_number().over(w.orderBy(ts)), "left": (F.count("*").over(w) - F.row_number().over(w.orderBy(ts))).cast("int")})
    return df.withColumns({"weekday": F.weekday(ts) + 1, "turn": ((F.col("_k") <= head) | (F.col("left") < tail)).cast("int")}).drop("_k")
