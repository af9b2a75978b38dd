"""Cross-sectional factor research over (date, symbol, factor, forward)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _corr(x: str, y: str) -> Column:
    """Null where either side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def information_coefficient(df: DataFrame, least: int = 3) -> DataFrame:
    """Correlation of factor and forward return per date, plain and of average ranks, where there are `least` rows."""
    rows = df.where("factor is not null and forward is not null")
    rank = lambda c: F.rank().over(Window.partitionBy("date").orderBy(c)) + (F.count("*").over(Window.partitionBy("date", c)) - 1) / 2
    ranked = rows.withColumns({"_f": rank("factor"), "_r": rank("forward")})
    return ranked.groupBy("date").agg(F.count("*").alias("n"), _corr("factor", "forward").alias("ic"), _corr("_f", "_r").alias("rank_ic")).where(F.col("n") >= least)


def factor_returns(df: DataFrame) -> DataFrame:
    """Return per date of demeaned weights whose sizes sum to 1; null where all factors are equal."""
    rows = df.where("factor is not null and forward is not null").withColumn("_w", F.col("factor") - F.avg("factor").over(Window.partitionBy("date")))
    return rows.groupBy("date").agg((F.sum(F.col("_w") * F.col("forward")) / F.nullif(F.sum(F.abs("_w")), F.lit(0.0))).alias("ret"), F.count("*").alias("n"))


def quantile_returns(df: DataFrame, n: int) -> DataFrame:
    """Mean forward return of each of n bins by factor, binned within each date; ties by symbol."""
    rows = df.where("factor is not null and forward is not null")
    return rows.withColumn("bin", F.ntile(n).over(Window.partitionBy("date").orderBy("factor", "symbol"))).groupBy("bin").agg(F.count("*").alias("n"), F.avg("forward").alias("forward"))


def factor_turnover(df: DataFrame) -> DataFrame:
    """Mean change of a symbol's percentile rank from one of its rows to the next."""
    ranked = df.where("factor is not null").withColumn("_p", F.percent_rank().over(Window.partitionBy("date").orderBy("factor")))
    moved = ranked.withColumn("_m", F.abs(F.col("_p") - F.lag("_p").over(Window.partitionBy("symbol").orderBy("date"))))
    return moved.groupBy("symbol").agg(F.avg("_m").alias("turnover"), F.count("_m").alias("n"))
