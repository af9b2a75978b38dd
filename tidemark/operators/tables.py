"""Tables against tables: as-of joins, bars from ticks, contracts, diffs and text search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str]) -> DataFrame:
    """The latest right row at or before each left row; right rows come first among equal times. One shuffle by key, no range join."""
    cols = [c for c in left.columns if c not in (key, ts)]
    a = left.select(key, ts, F.lit(1).alias("_side"), *cols, *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values], F.lit(None).cast("boolean").alias("_is"))
    b = right.select(key, ts, F.lit(0).alias("_side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], *values, F.lit(True).alias("_is"))
    w = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last(F.when(F.col("_is"), F.struct(*values)), ignorenulls=True).over(w)
    return a.unionByName(b).withColumn("_hit", hit).where("_side = 1").select(key, ts, *cols, *[F.col(f"_hit.{v}").alias(v) for v in values])


def signed_trades(trades: DataFrame, quotes: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Lee-Ready: against the as-of midpoint, else against the previous price, else 0."""
    both = asof(trades, quotes.withColumn("mid", (F.col("bid") + F.col("ask")) / 2), "symbol", "ts", ["mid"])
    past = F.lag("price").over(Window.partitionBy("symbol").orderBy("ts", "seq"))
    tick = F.coalesce(F.signum(F.col("price") - past), F.lit(0.0))
    gap = F.col("price") - F.col("mid")
    return both.withColumn("sign", F.when(F.abs(gap) > tolerance, F.signum(gap)).otherwise(tick).cast("int"))


def _ohlc(df: DataFrame, *keys) -> DataFrame:
    order = F.struct("ts", "seq")
    vwap = F.coalesce(F.sum(F.col("price") * F.col("size")) / F.nullif(F.sum("size").cast("double"), F.lit(0.0)), F.avg("price"))
    return df.groupBy(*keys).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("n"), vwap.alias("vwap"))


def tick_bars(ticks: DataFrame, n: int) -> DataFrame:
    """A bar for every n ticks of a symbol; the last may be partial."""
    k = F.floor((F.row_number().over(Window.partitionBy("symbol").orderBy("ts", "seq")) - 1) / n).alias("bar")
    return _ohlc(ticks.select("*", k), "symbol", "bar")


def time_bars(ticks: DataFrame, every: str) -> DataFrame:
    return _ohlc(ticks.withColumn("start", F.window("ts", every)["start"]), "symbol", "start")


def contract_counts(df: DataFrame, jump: float = 0.5) -> DataFrame:
    """Rows that break a price contract, by symbol: impossible bars, no volume, extreme returns."""
    past = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    df = df.withColumn("_r", F.abs(F.col("close") / past - 1))
    bad = (F.col("high") < F.col("low")) | (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    return df.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(bad).alias("impossible"), F.count_if(F.col("volume") <= 0).alias("no_volume"), F.count_if(F.col("_r") > jump).alias("extreme"), F.datediff(F.max("date"), F.min("date")).alias("span_days"))


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """insert, delete or update for each key that differs, nulls equal."""
    a, b = old.alias("a"), new.alias("b")
    same: Column = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    op = F.when(F.col(f"a.{key}").isNull(), "insert").when(F.col(f"b.{key}").isNull(), "delete").when(~same, "update")
    sides = [F.col(f"{s}.{c}").alias(f"{n}_{c}") for c in columns for s, n in (("a", "old"), ("b", "new"))]
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), op.alias("op"), *sides).where("op is not null")


def members_as_of(dates: DataFrame, listings: DataFrame) -> DataFrame:
    """Symbols listed on each date; an open end never ends. `listings` has a row for each symbol."""
    return dates.join(listings, (F.col("start") <= F.col("date")) & (F.col("end").isNull() | (F.col("date") <= F.col("end")))).groupBy("date").agg(F.count("*").alias("members"))


def keyword_search(docs: DataFrame, query: list[str], top: int) -> DataFrame:
    """Documents by the sum of ln(1 + N / (1 + df)) over distinct query words they hold; ties by id. Rows of one id are one document for its words.

    A document's words are added in the order of their names, not in that of the text or of the shuffle, so equal sets of words tie exactly.
    """
    n = docs.agg(F.count("*").alias("n_docs"))
    words = F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word")
    hits = docs.select("doc_id", words).where(F.col("word").isin(query)).distinct()
    df = hits.groupBy("word").agg(F.count("*").alias("df")).join(F.broadcast(n), F.lit(True))  # at most a row for each query word
    each = F.struct("word", F.log1p(F.col("n_docs") / (1 + F.col("df"))).alias("s"))
    score = F.aggregate(F.array_sort(F.collect_list(each)), F.lit(0.0), lambda total, x: total + x["s"]).alias("score")
    return hits.join(F.broadcast(df), "word").groupBy("doc_id").agg(score).orderBy(F.desc("score"), "doc_id").limit(top)
