"""Return-panel analytics: grouped aggregates and windows over (id, ts, ret)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def drawdown(df: DataFrame, col: str = "ret", key: str = "symbol", ts: str = "date") -> DataFrame:
    """Equity of 1 + returns (all above -1) and its distance to the running maximum."""
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("equity", F.exp(F.sum(F.log1p(F.coalesce(col, F.lit(0.0)))).over(w)))
    return df.withColumn("dd", F.col("equity") / F.max("equity").over(w) - 1)


def tail_risk(df: DataFrame, alpha: float = 0.05, col: str = "ret", key: str = "symbol") -> DataFrame:
    """Value at risk (exact, linear) and the mean at or below it."""
    q = df.where(F.col(col).isNotNull()).groupBy(key).agg(F.percentile(col, F.lit(alpha)).alias("var"))
    return df.join(q, key).where(F.col(col) <= F.col("var")).groupBy(key).agg(F.first("var").alias("var"), F.avg(col).alias("es"))


def monthly(df: DataFrame, col: str = "ret", key: str = "symbol", ts: str = "date") -> DataFrame:
    month = F.trunc(ts, "month").alias("month")
    return df.where(F.col(col).isNotNull()).groupBy(key, month).agg((F.exp(F.sum(F.log1p(col))) - 1).alias("ret"), F.count("*").alias("n"))
