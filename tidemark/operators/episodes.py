"""Runs within a return series: drawdown episodes, streaks, round trips; and statistics by symbol."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.features import by, full
from tidemark.operators.panel import drawdown


def _runs(df: DataFrame, state: str, key: str, ts: str) -> DataFrame:
    """`df` with `run`, a number for each stretch of equal `state`."""
    w = by(key, ts)
    new = (~F.col(state).eqNullSafe(F.lag(state).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")


def drawdown_episodes(df: DataFrame, col: str = "ret", key: str = "symbol", ts: str = "date") -> DataFrame:
    """Stretches below the running maximum: start, end, depth, rows; `open` where the series ends below."""
    dd = drawdown(df, col, key, ts).withColumn("_under", F.col("dd") < -1e-12)
    dd = _runs(dd, "_under", key, ts).withColumn("_last", F.max(ts).over(Window.partitionBy(key)))
    found = dd.where("_under").groupBy(key, "run").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.min("dd").alias("depth"), F.count("*").alias("n"), F.max("_last").alias("_last"))
    return found.withColumn("open", (F.col("end") == F.col("_last")).cast("int")).drop("run", "_last")


def conditional_drawdown(df: DataFrame, alpha: float, key: str = "symbol") -> DataFrame:
    """Mean of the drawdowns at or below their alpha quantile (exact, linear)."""
    cut = df.groupBy(key).agg(F.percentile("dd", F.lit(alpha)).alias("cut"))
    return df.join(cut, key).where("dd <= cut").groupBy(key).agg(F.avg("dd").alias("cdar"), F.count("*").alias("n"))


def longest_streaks(df: DataFrame, col: str = "ret", key: str = "symbol", ts: str = "date") -> DataFrame:
    runs = _runs(df.withColumn("_s", F.coalesce(F.signum(col), F.lit(0.0)).cast("int")), "_s", key, ts).groupBy(key, "run", "_s").agg(F.count("*").alias("_n"))
    most = lambda s: F.coalesce(F.max(F.when(F.col("_s") == s, F.col("_n"))), F.lit(0))
    return runs.groupBy(key).agg(most(1).alias("wins"), most(-1).alias("losses"))


def shape(df: DataFrame, col: str = "ret", key: str = "symbol") -> DataFrame:
    """Population skewness and excess kurtosis, tail ratio (95 % to 5 %) and best and worst."""
    tails = F.abs(F.percentile(col, F.lit(0.95)) / F.nullif(F.percentile(col, F.lit(0.05)), F.lit(0.0)))
    return df.where(F.col(col).isNotNull()).groupBy(key).agg(F.skewness(col).alias("skew"), F.kurtosis(col).alias("kurtosis"), tails.alias("tail_ratio"), F.max(col).alias("best"), F.min(col).alias("worst"))


def rolling_risk(df: DataFrame, n: int, col: str = "ret", key: str = "symbol", ts: str = "date", periods: int = 252) -> DataFrame:
    w = by(key, ts)
    dev = full(F.stddev_samp(col), w, n, col)
    return df.withColumns({"vol": dev * math.sqrt(periods), "sharpe": full(F.avg(col), w, n, col) / F.nullif(dev, F.lit(0.0)) * math.sqrt(periods)})


def round_trips(df: DataFrame, key: str = "symbol", ts: str = "date", price: str = "close") -> DataFrame:
    """Stretches of one sign of `w` other than 0: entry, exit, return, best and worst excursion against the entry."""
    runs = _runs(df.withColumn("side", F.signum(F.coalesce("w", F.lit(0.0))).cast("int")), "side", key, ts).where("side != 0")
    found = runs.groupBy(key, "run", "side").agg(F.min(ts).alias("opened"), F.max(ts).alias("closed"), F.min_by(price, ts).alias("entry"), F.max_by(price, ts).alias("exit"), F.max(price).alias("_hi"), F.min(price).alias("_lo"), F.count("*").alias("bars"))
    move = lambda x: F.col("side") * (F.col(x) / F.col("entry") - 1)
    return found.withColumns({"pnl": move("exit"), "mfe": F.greatest(move("_hi"), move("_lo")), "mae": F.least(move("_hi"), move("_lo"))}).drop("run", "_hi", "_lo")


def trade_stats(trades: DataFrame, key: str = "symbol") -> DataFrame:
    """By key and holding bucket (rows 1, 2-5, 6-20, more): count, win rate, expectancy, mean holding."""
    bucket = F.when(F.col("bars") <= 1, "1").when(F.col("bars") <= 5, "2-5").when(F.col("bars") <= 20, "6-20").otherwise(">20")
    return trades.groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg("pnl").alias("expectancy"), F.avg("bars").alias("holding"))


def inverse_volatility(df: DataFrame, n: int, col: str = "ret", key: str = "symbol", ts: str = "date") -> DataFrame:
    """Weights per date, 1 / trailing deviation, summing to 1; null until a symbol's window is full."""
    df = df.withColumn("_i", 1 / F.nullif(full(F.stddev_samp(col), by(key, ts), n, col), F.lit(0.0)))
    return df.withColumn("weight", F.col("_i") / F.sum("_i").over(Window.partitionBy(ts))).drop("_i")


def rebalance_dates(df: DataFrame, every: str = "week", key: str = "symbol", ts: str = "date") -> DataFrame:
    """The first row of each ISO week, month or quarter."""
    return df.groupBy(key, F.date_trunc(every, ts).cast("date").alias("period")).agg(F.min(ts).alias("date"))


def walk_forward(df: DataFrame, n: int, share: float, key: str = "symbol", ts: str = "date") -> DataFrame:
    """n test windows that tile the last `share` of a key's rows, the last one longer; training is all that precedes (expanding)."""
    w = by(key, ts)
    df = df.select(key, ts, (F.row_number().over(w) - 1).alias("_k"), F.count("*").over(Window.partitionBy(key)).alias("_n"))
    df = df.withColumn("_first", F.col("_n") - F.floor(F.col("_n") * share))
    size = F.greatest(F.floor((F.col("_n") - F.col("_first")) / n), F.lit(1))
    rows = df.where("_k >= _first").withColumn("fold", F.least(F.floor((F.col("_k") - F.col("_first")) / size), F.lit(n - 1)))
    return rows.groupBy(key, "fold").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n_test"), F.min("_k").alias("n_train"))
