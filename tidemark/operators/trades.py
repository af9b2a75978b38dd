"""Trade tapes: sessions, blocks, venues and corporate actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.tables import asof, signed_trades


def session(ts: str = "ts", opens: int = 14, closes: int = 20) -> Column:
    """Session label by UTC hour."""
    h = F.hour(ts)
    return F.when(h < opens, "premarket").when(h >= closes, "afterhours").otherwise("regular")


def session_volume(ticks: DataFrame) -> DataFrame:
    """Volume of each symbol and session; one shuffle, the share is taken over the few session rows."""
    sums = ticks.groupBy("symbol", session().alias("session")).agg(F.sum("size").alias("volume"), F.count("*").alias("n"))
    return sums.withColumn("share", F.col("volume") / F.nullif(F.sum("volume").over(Window.partitionBy("symbol")).cast("double"), F.lit(0.0)))


def session_bars(ticks: DataFrame, every: str) -> DataFrame:
    """Bars outside regular hours; sizes below 1 weigh 1 in the average price."""
    order, weight = F.struct("ts", "seq"), F.greatest("size", F.lit(1))
    rows = ticks.withColumns({"session": session(), "start": F.window("ts", every)["start"]}).where("session != 'regular'")
    return rows.groupBy("symbol", "session", "start").agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), (F.sum(F.col("price") * weight) / F.sum(weight)).alias("vwap"))


def blocks(ticks: DataFrame, size: int, notional: float) -> DataFrame:
    """Trades of at least `size` or `notional`, why, and their share of the symbol's volume."""
    total = ticks.groupBy("symbol").agg(F.sum("size").alias("_total"))
    money = F.col("price") * F.col("size")
    big, rich = F.col("size") >= size, money >= notional
    flagged = ticks.withColumns({"notional": money, "reason": F.when(big & rich, "both").when(big, "size").when(rich, "notional")}).where("reason is not null")
    return flagged.join(total, "symbol").withColumn("share", F.col("size") / F.col("_total")).drop("_total")


def dark_share(ticks: DataFrame, dark: list[int]) -> DataFrame:
    inside = F.sum(F.when(F.col("venue").isin(dark), F.col("size")).otherwise(0))
    return ticks.groupBy("symbol").agg(inside.alias("dark"), F.sum("size").alias("volume"), (inside / F.nullif(F.sum("size").cast("double"), F.lit(0.0))).alias("share"))


def flow(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Bought, sold and net volume and money by symbol."""
    s = signed_trades(trades, quotes)
    side = lambda k: F.sum(F.when(F.col("sign") == k, F.col("size")).otherwise(0))
    return s.groupBy("symbol").agg(side(1).alias("bought"), side(-1).alias("sold"), F.sum(F.col("sign") * F.col("size")).alias("net"), F.sum(F.col("sign") * F.col("size") * F.col("price")).alias("net_money"))


def venue_quality(trades: DataFrame, quotes: DataFrame, dark: list[int]) -> DataFrame:
    """Size, price and effective spread (basis points of the midpoint) on lit and dark venues."""
    both = asof(trades, quotes.withColumn("mid", (F.col("bid") + F.col("ask")) / 2), "symbol", "ts", ["mid"])
    spread = 2e4 * F.abs(F.col("price") - F.col("mid")) / F.col("mid")
    kind = F.when(F.col("venue").isin(dark), "dark").otherwise("lit").alias("kind")
    return both.groupBy(kind).agg(F.count("*").alias("n"), F.sum("size").alias("volume"), F.avg("size").alias("mean_size"), (F.sum(F.col("price") * F.col("size")) / F.sum("size")).alias("vwap"), F.avg(spread).alias("spread_bps"))


def back_adjusted(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Prices times, and volume over, the factors of all later actions.

    `actions` (symbol, date, kind, factor) has at most a row for each bar: a split divides by its
    factor, a dividend takes its share of the close before, a spin-off leaves its factor.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    before = F.lag("close").over(w)
    both = bars.join(actions, ["symbol", "date"], "left").withColumn("_before", before)
    cut = F.when(F.col("kind") == "split", 1 / F.col("factor")).when(F.col("kind") == "dividend", F.greatest(1 - F.col("factor") / F.col("_before"), F.lit(0.0))).when(F.col("kind") == "spinoff", F.least(F.greatest("factor", F.lit(1e-6)), F.lit(1.0)))
    both = both.withColumn("_cut", F.coalesce(cut, F.lit(1.0)))
    later = w.rowsBetween(1, Window.unboundedFollowing)
    none = F.coalesce(F.min("_cut").over(later) == 0, F.lit(False))  # a factor of zero has no logarithm
    product = F.when(none, 0.0).otherwise(F.exp(F.coalesce(F.sum(F.log(F.when(F.col("_cut") > 0, F.col("_cut")))).over(later), F.lit(0.0))))
    both = both.withColumn("product", product).drop("_cut", "_before", "kind", "factor")
    return both.withColumns({"adj_close": F.col("close") * F.col("product"), "adj_volume": F.col("volume") / F.nullif(F.col("product"), F.lit(0.0))})
