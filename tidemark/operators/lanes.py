"""More features, liquidity, cross-sections, execution reports and monitoring as windows and grouped passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def _by(n: int | None = None, key: str = "symbol", ts: str = "date"):
    w = Window.partitionBy(key).orderBy(ts)
    return w if n is None else w.rowsBetween(1 - n, 0)


def _full(c: Column, n: int, over: str = "close") -> Column:
    return F.when(F.count(over).over(_by(n)) == n, c)


def _safe(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def auto_threshold(ticks: DataFrame, per_day: int) -> DataFrame:
    """Ticks, volume and money in a bar so that a symbol has `per_day` bars on a day it trades."""
    g = ticks.groupBy("symbol").agg(F.count_distinct(F.to_date("ts")).alias("days"), F.count("*").alias("n"), F.sum("size").alias("v"), F.sum(F.col("price") * F.col("size")).alias("m"))
    k = F.col("days") * per_day
    return g.select("symbol", "days", F.greatest(F.lit(1), F.floor(F.col("n") / k)).alias("ticks"), (F.col("v") / k).alias("volume"), (F.col("m") / k).alias("money"))


def resampled(bars: DataFrame, unit: str) -> DataFrame:
    """Last close and compounded return of each calendar unit."""
    x = bars.groupBy("symbol", F.to_date(F.date_trunc(unit, "date")).alias("period")).agg(F.max_by("close", "date").alias("close"), F.count("*").alias("n"))
    return x.withColumn("ret", F.col("close") / F.lag("close").over(_by(ts="period")) - 1)


def session_ends(ticks: DataFrame) -> DataFrame:
    """Ticks with their session day and whether the position is flat after it: the last of the day."""
    w = Window.partitionBy("symbol").orderBy("ts", "seq")
    day = F.to_date("ts")
    return ticks.withColumn("session", day).withColumn("last", F.lead(day).over(w).isNull() | (F.lead(day).over(w) != F.col("session")))


def latest_by_feed(ticks: DataFrame, feed: str) -> DataFrame:
    """The last update of each feed and symbol and its premium over the symbol's mean price in bps."""
    mean = F.avg("price").over(Window.partitionBy("symbol"))
    x = ticks.withColumn("_m", mean).groupBy("symbol", feed).agg(F.max_by(F.struct("ts", "price", "_m"), F.struct("ts", "seq")).alias("m"))
    return x.select("symbol", feed, "m.ts", "m.price", ((F.col("m.price") / F.col("m._m") - 1) * 1e4).alias("premium_bps"))


def volume_profile(bars: DataFrame, bins: int, z: float) -> DataFrame:
    """Volume of `bins` equal price bins of each symbol, the bin with the most, and bins far above or below the mean."""
    w = Window.partitionBy("symbol")
    lo, hi = F.min("close").over(w), F.max("close").over(w)
    k = F.least(F.lit(bins - 1), F.floor((F.col("close") - lo) / _safe(hi - lo) * bins)).cast("int")
    x = bars.withColumn("bin", F.coalesce(k, F.lit(0))).groupBy("symbol", "bin").agg(F.sum("volume").alias("volume"))
    score = (F.col("volume") - F.avg("volume").over(w)) / _safe(F.stddev_pop("volume").over(w))
    best = F.row_number().over(w.orderBy(F.desc("volume"), "bin")) == 1
    return x.withColumns({"control": best, "node": F.when(score >= z, "high").when(score <= -z, "low").otherwise("mid")})


def funding(rows: DataFrame) -> DataFrame:
    """Profit after funding: a positive rate is paid by longs. (symbol, date, pnl, rate, position)."""
    return rows.withColumn("net", F.col("pnl") - F.col("position") * F.col("rate")).withColumn("yearly", F.col("rate") * 3 * 365)


def liquidity(bars: DataFrame, n: int = 20, cap: float = 0.05, low: float = 50.0) -> DataFrame:
    """Trailing mean volume and money, yearly deviation of log returns, variation of volume, a spread proxy, the capacity at a share of volume, and a flag for thin trading."""
    x = bars.withColumns({"_m": F.col("close") * F.col("volume"), "_r": F.log(F.col("close") / F.lag("close").over(_by()))})
    sd = F.stddev("_r").over(_by(n))
    x = x.withColumns({
        "adv": _full(F.avg("volume").over(_by(n)), n), "money": _full(F.sum("_m").over(_by(n)), n), "vol": _full(sd * math.sqrt(252), n), "turnover_cv": _full(F.stddev("volume").over(_by(n)) / _safe(F.avg("volume").over(_by(n))), n),
        "spread_bps": _full(F.least(2 * sd * 1e4, F.lit(50.0)), n),
    })
    return x.withColumns({"capacity": F.col("adv") * cap * F.col("close"), "thin": F.coalesce(F.col("adv") < low, F.lit(True))}).drop("_m", "_r")


def liquidity_class(bars: DataFrame, steps: tuple[float, float, float]) -> DataFrame:
    """Class, haircut and share of days above the least step, by mean daily money."""
    m = F.col("close") * F.col("volume")
    g = bars.groupBy("symbol").agg(F.avg(m).alias("adv"), F.avg((m >= steps[0]).cast("double")).alias("active"))
    k = F.when(F.col("adv") >= steps[2], "deep").when(F.col("adv") >= steps[1], "normal").when(F.col("adv") >= steps[0], "thin").otherwise("none")
    return g.withColumn("class", k).withColumn("haircut", F.when(k == "deep", 1.0).when(k == "normal", 0.7).when(k == "thin", 0.4).otherwise(0.0))


def dynamic_cap(bars: DataFrame, n: int, most: float) -> DataFrame:
    """A size cap that follows the day's money against its trailing mean, at most `most` times the mean."""
    m = F.col("close") * F.col("volume")
    mean = _full(F.avg(m).over(_by(n)), n)
    return bars.select("symbol", "date", F.least(m, most * mean).alias("cap"), (m > most * mean).alias("capped"))


def spread_block(bars: DataFrame, n: int, times: float) -> DataFrame:
    """Is the day's range over its trailing mean, the day left out, by more than `times`?"""
    r = F.col("high") - F.col("low")
    mean = F.avg(r).over(_by().rowsBetween(-n, -1))
    return bars.select("symbol", "date", F.coalesce(r > times * mean, F.lit(False)).alias("blocked"))


def log_and_lagged(bars: DataFrame, lags: list[int]) -> DataFrame:
    c = F.col("close")
    return bars.select("symbol", "date", F.log(c / F.lag(c).over(_by())).alias("log_ret"), *[(F.lag(c, k).over(_by()) / F.lag(c, k + 1).over(_by()) - 1).alias(f"lag_{k}") for k in lags])


def rolling_shape(df: DataFrame, n: int, col: str = "ret") -> DataFrame:
    """Trailing skew and excess kurtosis with the small-sample correction; null until the window is full."""
    g1, g2 = F.skewness(col).over(_by(n)), F.kurtosis(col).over(_by(n))
    full = F.count(col).over(_by(n)) == n
    return df.select("symbol", "date", F.when(full, g1 * math.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), F.when(full, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"))


def band_position(bars: DataFrame, n: int, k: float) -> DataFrame:
    """Place of the close in its bands, and their width over the mean."""
    m, sd = F.avg("close").over(_by(n)), F.stddev("close").over(_by(n))
    return bars.select("symbol", "date", _full((F.col("close") - (m - k * sd)) / _safe(2 * k * sd), n).alias("percent"), _full(2 * k * sd / _safe(m), n).alias("width"))


def commodity_channel(bars: DataFrame, n: int) -> DataFrame:
    """Typical price against its mean over 0.015 times the mean deviation, and Aroon up and down."""
    x = bars.withColumn("_t", (F.col("high") + F.col("low") + F.col("close")) / 3)
    x = x.withColumns({"_l": F.collect_list("_t").over(_by(n)), "_m": F.avg("_t").over(_by(n)), "_h": F.reverse(F.collect_list("high").over(_by(n + 1))), "_w": F.reverse(F.collect_list("low").over(_by(n + 1)))})
    mad = F.aggregate(F.transform("_l", lambda v: F.abs(v - F.col("_m"))), F.lit(0.0), lambda a, v: a + v) / n
    since = lambda c, f: (F.array_position(c, f(c)) - 1).cast("double")
    deep = F.size("_h") == n + 1
    return x.select("symbol", "date", F.when(F.size("_l") == n, (F.col("_t") - F.col("_m")) / _safe(0.015 * mad)).alias("cci"), F.when(deep, 100 * (n - since("_h", F.array_max)) / n).alias("up"), F.when(deep, 100 * (n - since("_w", F.array_min)) / n).alias("down"))


def mid_rank(df: DataFrame, n: int, col: str) -> DataFrame:
    """Share of the trailing window below a value plus half of its equals, less a half."""
    x = df.withColumn("_l", F.collect_list(col).over(_by(n)))
    below, same = F.size(F.filter("_l", lambda v: v < F.col(col))), F.size(F.filter("_l", lambda v: v == F.col(col)))
    return x.select("symbol", "date", F.when((F.size("_l") == n) & F.col(col).isNotNull(), (below + same / 2) / n - 0.5).alias("rank"))


def serial_structure(df: DataFrame, n: int, k: int) -> DataFrame:
    """Trailing first-lag correlation and the ratio of the variance of k-row sums to k times that of rows; null until all rows that both reach back over are there.

    A symbol's rows pass one task in order, and of the rows before a batch only those that its windows reach are kept, so a task holds one batch.
    """
    reach = max(n + k - 1, n + 1)
    view = np.lib.stride_tricks.sliding_window_view

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, ok, run_of, last = np.empty(0), np.empty(0, bool), np.empty(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            had, key = len(x), batch.column(0)
            codes = key.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            first = 0 if not had else run_of[-1] + int(key[0].as_py() != last)
            x, ok = np.r_[x, batch.column(2).fill_null(0.0).to_numpy()], np.r_[ok, batch.column(2).is_valid().to_numpy(zero_copy_only=False)]
            run_of, last = np.r_[run_of, first + np.r_[0, np.cumsum(codes[1:] != codes[:-1])]], key[-1].as_py()
            rho, ratio = np.full(len(x), np.nan), np.full(len(x), np.nan)
            no_rho, no_ratio = np.ones(len(x), bool), np.ones(len(x), bool)
            if len(x) >= reach:
                ends = np.flatnonzero(view(ok, reach).all(axis=1) & (run_of[reach - 1 :] == run_of[: len(x) - reach + 1])) + reach - 1
                ends = ends[ends >= had]
                sums = view(x, k).sum(axis=1)
                for at in np.array_split(ends, max(1, math.ceil(len(ends) / 4096))):
                    one, past, many = view(x, n)[at - n + 1], view(x, n)[at - n], view(sums, n)[at - n - k + 2]
                    one, past, many = (c - c[:, :1] for c in (one, past, many))  # so that equal values have no variance at all
                    one, past, many = (c - c.mean(axis=1, keepdims=True) for c in (one, past, many))
                    v, v_past, v_many = ((c * c).mean(axis=1) for c in (one, past, many))
                    down = np.sqrt(v) * np.sqrt(v_past)
                    no_rho[at], no_ratio[at] = down == 0, v == 0
                    with np.errstate(divide="ignore", invalid="ignore"):
                        rho[at], ratio[at] = (one * past).mean(axis=1) / down, v_many / (k * v)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rho[had:], mask=no_rho[had:]), pa.array(ratio[had:], mask=no_ratio[had:])], names=["symbol", "date", "rho", "ratio"])
            keep = max(0, len(x) - reach)
            x, ok, run_of = x[keep:], ok[keep:], run_of[keep:]

    rows = df.select("symbol", "date", F.col("ret").cast("double").alias("ret")).repartition("symbol").sortWithinPartitions("symbol", "date")
    kind = StructType([*rows.schema.fields[:2]]).add("rho", "double").add("ratio", "double")
    return rows.mapInArrow(run, kind)


def yang_zhang(bars: DataFrame, n: int) -> DataFrame:
    """Yearly volatility from overnight, open-to-close and Rogers-Satchell parts."""
    past = F.lag("close").over(_by())
    o, c = F.log(F.col("open") / past), F.log(F.col("close") / F.col("open"))
    u, d = F.log(F.col("high") / F.col("open")), F.log(F.col("low") / F.col("open"))
    x = bars.withColumns({"_o": o, "_c": c, "_rs": u * (u - c) + d * (d - c)})
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    total = F.var_samp("_o").over(_by(n)) + k * F.var_samp("_c").over(_by(n)) + (1 - k) * F.avg("_rs").over(_by(n))
    return x.select("symbol", "date", F.when(F.count("_o").over(_by(n)) == n, F.sqrt(F.greatest(total, F.lit(0.0)) * 252)).alias("vol"))


def dead_band(c: Column, threshold: float) -> Column:
    return F.signum(c) * F.greatest(F.abs(c) - threshold, F.lit(0.0))


def frac_weights(d: float, threshold: float, most: int = 10_000) -> list[float]:
    """Weights of fractional differences, newest first, up to the first below the threshold."""
    out = [1.0]
    while len(out) < most:
        k = len(out)
        w = -out[-1] * (d - k + 1) / k
        if abs(w) < threshold:
            break
        out.append(w)
    return out


def frac_diff(bars: DataFrame, d: float, threshold: float) -> DataFrame:
    """Fractional difference of the log close; null until all weights have a row."""
    w = frac_weights(d, threshold)
    x = bars.withColumn("_l", F.log("close")).withColumn("_f", F.collect_list("_l").over(_by(len(w))))
    dot = F.aggregate(F.zip_with(F.reverse("_f"), F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return x.select("symbol", "date", F.when(F.size("_f") == len(w), dot).alias("diff"))


def barriers(bars: DataFrame, times: float, n: int, horizon: int) -> DataFrame:
    """First touch within `horizon` rows of a barrier at +-`times` the trailing deviation: (symbol, date, label, touched). 0 at the last row; the upper barrier goes first in a tie."""
    x = bars.withColumn("_r", F.log(F.col("close") / F.lag("close").over(_by())))
    x = x.withColumns({"_s": F.when(F.count("_r").over(_by(n)) == n, F.stddev("_r").over(_by(n))), "_next": F.collect_list("close").over(_by().rowsBetween(1, horizon))})
    path = F.transform("_next", lambda p: p / F.col("close") - 1)
    first = lambda f: F.array_position(F.transform(path, lambda p: f(p).cast("int")), 1)
    up, down = F.nullif(first(lambda p: p >= times * F.col("_s")), F.lit(0)), F.nullif(first(lambda p: p <= -times * F.col("_s")), F.lit(0))
    hit = F.least(up, down)
    label = F.when(hit.isNull(), 0).when(up == hit, 1).otherwise(-1)
    return x.where("_s is not null").where(F.size("_next") == horizon).select("symbol", "date", label.alias("label"), F.coalesce(hit, F.lit(horizon)).cast("int").alias("touched"))


def meta_labels(signal: Column, ret: Column, threshold: float) -> Column:
    """1 where a signal had the sign of a return beyond the threshold; a missing return gives 0."""
    good = (signal != 0) & (F.signum(signal) == F.signum(ret)) & (F.abs(ret) > threshold)
    return F.coalesce(good, F.lit(False)).cast("int")


def sequences(df: DataFrame, columns: list[str], n: int, horizon: int) -> DataFrame:
    """Trailing sequences of n rows of several columns with the value `horizon` rows on as target."""
    lists = [F.collect_list(c).over(_by(n)).alias(f"seq_{c}") for c in columns]
    x = df.select("symbol", "date", *lists, F.lead(columns[0], horizon).over(_by()).alias("target"))
    return x.where((F.size(f"seq_{columns[0]}") == n) & F.col("target").isNotNull())


def pair_spread(bars: DataFrame, n: int) -> DataFrame:
    """z-score of the log price ratio of each symbol and the next over their common dates."""
    a = bars.select("symbol", "date", F.log("close").alias("_a"))
    b = bars.select((F.col("symbol") - 1).alias("symbol"), "date", F.log("close").alias("_b"))
    x = a.join(b, ["symbol", "date"]).withColumn("spread", F.col("_a") - F.col("_b"))
    return x.select("symbol", "date", "spread", F.when(F.count("spread").over(_by(n)) == n, (F.col("spread") - F.avg("spread").over(_by(n))) / _safe(F.stddev("spread").over(_by(n)))).alias("z"))


def vol_target(df: DataFrame, n: int, target: float, most: float) -> DataFrame:
    """Weights scaled to a yearly volatility, capped."""
    vol = F.when(F.count("ret").over(_by(n)) == n, F.stddev("ret").over(_by(n)) * math.sqrt(252))
    return df.withColumn("scaled", F.col("w") * F.least(F.lit(most), target / _safe(vol)))


def vote(signals: list[str], rule: str) -> Column:
    """majority, unanimity or median of signal columns in {-1, 0, 1}."""
    total = sum((F.signum(F.col(c)) for c in signals), F.lit(0.0))
    if rule == "majority":
        return F.when(F.abs(total) * 2 > len(signals), F.signum(total)).otherwise(0.0)
    if rule == "unanimity":
        return F.when(F.abs(total) == len(signals), F.signum(total)).otherwise(0.0)
    ordered = F.array_sort(F.array(*[F.col(c).cast("double") for c in signals]))
    k = len(signals)
    return (F.get(ordered, (k - 1) // 2) + F.get(ordered, k // 2)) / 2


def evaluated_rules(df: DataFrame, rules: list[tuple[str, str, str, float]]) -> DataFrame:
    """(symbol, rule, n) of rows on which each rule (name, column, comparator, value) holds; all rules in one pass."""
    ops = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
    sums = df.groupBy("symbol").agg(*[F.count_if(ops[o](F.col(c), F.lit(v))).alias(f"n{k}") for k, (_, c, o, v) in enumerate(rules)])
    return sums.select("symbol", F.inline(F.array(*[F.struct(F.lit(r[0]).alias("rule"), F.col(f"n{k}").alias("n")) for k, r in enumerate(rules)])))


def quantile_signal(df: DataFrame, col: str, q: float) -> DataFrame:
    """+1 at or above the upper quantile of a date, -1 at or below the lower."""
    cut = df.groupBy("date").agg(F.percentile(col, F.lit(1 - q)).alias("_hi"), F.percentile(col, F.lit(q)).alias("_lo"))
    return df.join(cut, "date").select("symbol", "date", F.when(F.col(col) >= F.col("_hi"), 1).when(F.col(col) <= F.col("_lo"), -1).otherwise(0).alias("signal"))


def reference_percentile(df: DataFrame, col: str, reference: Column) -> DataFrame:
    """Mid-point distribution of a value against the reference rows of its date."""
    w = Window.partitionBy("date").orderBy(col)
    r = reference.cast("int")
    upto = F.sum(r).over(w.rangeBetween(Window.unboundedPreceding, 0))
    same = F.sum(r).over(Window.partitionBy("date", col))
    return df.where(F.col(col).isNotNull()).select("symbol", "date", ((upto - same / 2) / _safe(F.sum(r).over(Window.partitionBy("date")).cast("double"))).alias("pct"))


def breadth(df: DataFrame) -> DataFrame:
    """By date: share of rising symbols, dispersion, its range between quartiles, and excess concentration of absolute returns."""
    x = df.where("ret is not null").withColumn("_a", F.abs("ret"))
    hhi = F.sum(F.col("_a") ** 2) / _safe(F.sum("_a") ** 2) - 1 / F.count("*")
    return x.groupBy("date").agg(F.count("*").alias("n"), F.avg((F.col("ret") > 0).cast("double")).alias("rising"), F.stddev_pop("ret").alias("dispersion"), (F.percentile("ret", F.lit(0.75)) - F.percentile("ret", F.lit(0.25))).alias("iqr"), hhi.alias("excess"))


def month_momentum(bars: DataFrame) -> DataFrame:
    """From month-end closes: last month's return, returns of months 2-6 and 2-12 back, and 13-18 back."""
    m = bars.groupBy("symbol", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("close"))
    c = lambda k: F.lag("close", k).over(_by(ts="month"))
    now = F.col("close")
    return m.select("symbol", "month", (now / c(1) - 1).alias("reversal"), (c(1) / c(6) - 1).alias("mom_6"), (c(1) / c(12) - 1).alias("mom_12"), (c(12) / c(18) - 1).alias("long_reversal"))


def screened_weights(df: DataFrame, keep: Column) -> DataFrame:
    """Weights of the rows that pass, of a date made to sum to one."""
    return df.where(keep).withColumn("w", F.col("w") / _safe(F.sum("w").over(Window.partitionBy("date"))))


def wash_sales(trades: DataFrame, days: int) -> DataFrame:
    """Buys within `days` after a losing sale of their symbol. Losing days are exploded to the days they reach, so the join is by equality."""
    losing = trades.where("quantity < 0 and pnl < 0").select("symbol", F.explode(F.sequence(F.date_add("date", 1), F.date_add("date", days))).alias("date")).distinct()
    return trades.where("quantity > 0").join(losing, ["symbol", "date"], "left_semi")


def size_buckets(orders: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Orders, fill rate and spreads for each size bucket; empty buckets stay."""
    lo = F.coalesce(*[F.when(F.col("size").between(a, b), F.lit(a)) for a, b in bounds])
    g = orders.withColumn("low", lo).groupBy("low").agg(F.count("*").alias("_n"), F.avg(F.col("filled").cast("double")).alias("fill_rate"), F.avg("spread_bps").alias("spread_bps"))
    every = orders.sparkSession.range(1).select(F.explode(F.array(*[F.lit(a) for a, _ in bounds])).alias("low"))
    return every.join(g, "low", "left").select("low", F.coalesce("_n", F.lit(0)).alias("n"), "fill_rate", "spread_bps")


def venue_report(orders: DataFrame) -> DataFrame:
    """Orders, size and payment by venue and by category, as grouping sets in one pass."""
    return orders.groupingSets([["venue"], ["category"]], "venue", "category").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("payment").alias("payment"))


def reconstructed(trades: DataFrame, market: DataFrame, tolerance: float) -> DataFrame:
    """By symbol: trades, those away from the market snapshot by more than the tolerance, and those without one."""
    x = trades.join(market.select("symbol", F.col("price").alias("_m")), "symbol", "left")
    return x.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("price") / F.col("_m") - 1) > tolerance).alias("outside"), F.count_if(F.col("_m").isNull()).alias("unmatched"))


def payoffs(legs: DataFrame, spots: list[float]) -> DataFrame:
    """Payoff of a strategy at each spot from its legs (strategy, kind, strike, quantity, premium)."""
    x = legs.select("*", F.explode(F.array(*map(F.lit, spots))).alias("spot"))
    value = F.when(F.col("kind") == "call", F.greatest(F.col("spot") - F.col("strike"), F.lit(0.0))).otherwise(F.greatest(F.col("strike") - F.col("spot"), F.lit(0.0)))
    return x.groupBy("strategy", "spot").agg(F.sum(F.col("quantity") * (value - F.col("premium"))).alias("payoff"))


def capital_tokens(docs: DataFrame, stop: list[str], by: str) -> DataFrame:
    """Documents of each group that hold a token of 2 to 5 capitals, counted once each, without stop words."""
    words = F.filter(F.array_distinct(F.split("text", "[^A-Za-z]+")), lambda w: w.rlike("^[A-Z]{2,5}$"))
    found = F.array_except(words, F.array(*map(F.lit, stop)))
    return docs.select(by, F.explode(found).alias("token")).groupBy(by, "token").agg(F.count("*").alias("n"))


def hash_embedding(docs: DataFrame, dim: int) -> DataFrame:
    """(doc_id, k, v): word counts in `dim` hashed places, of length one. Places come from MD5 and never change."""
    word = F.explode(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: F.length(w) > 0)).alias("w")
    place = F.pmod(F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
    x = docs.select("doc_id", word).groupBy("doc_id", place.alias("k")).agg(F.count("*").alias("n"))
    return x.select("doc_id", "k", (F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id")))).alias("v"))


def flattened(df: DataFrame, col: str, schema: str) -> DataFrame:
    """JSON text as columns; what does not parse is null."""
    return df.withColumn("_j", F.from_json(col, schema)).select(*[c for c in df.columns if c != col], "_j.*")


def stale_feeds(ticks: DataFrame, now: Column, most_seconds: int) -> DataFrame:
    """Last event of each symbol, seconds since, and whether they are too many."""
    g = ticks.groupBy("symbol").agg(F.max("ts").alias("last"))
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col("last").cast("timestamp"))
    return g.select("symbol", age.alias("age"), (age > most_seconds).alias("stale"))


def gap_sessions(ticks: DataFrame, seconds: int) -> DataFrame:
    """(symbol, session, n, volume): runs of ticks without a gap of more than `seconds`."""
    w = Window.partitionBy("symbol").orderBy("ts", "seq")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    new = F.coalesce(t - F.lag(t).over(w) > seconds * 1_000_000, F.lit(False)).cast("int")
    x = ticks.withColumn("_n", new).withColumn("session", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("symbol", "session").agg(F.count("*").alias("n"), F.sum("size").alias("volume"))


def frozen_prices(bars: DataFrame, least: int) -> DataFrame:
    """Runs of at least so many equal closes."""
    x = bars.withColumn("_c", F.coalesce((F.col("close") != F.lag("close").over(_by())).cast("int"), F.lit(0)))
    x = x.withColumn("_g", F.sum("_c").over(_by().rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("symbol", "_g").agg(F.min("date").alias("start"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_g")


def only_newer(ticks: DataFrame) -> DataFrame:
    """Rows in ingest order whose time is strictly newer than all before of their symbol."""
    past = F.max("ts").over(Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return ticks.withColumn("_p", past).where(F.col("_p").isNull() | (F.col("ts") > F.col("_p"))).drop("_p")


def last_rows(ticks: DataFrame, n: int) -> DataFrame:
    """The newest n rows of each symbol: a buffer as a feature, not a sample."""
    return ticks.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("seq")))).where(F.col("_r") <= n).drop("_r")


def missing_orders(intended: DataFrame, real: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one log that the other lacks, repeats counted, with the side that has them."""
    a, b = intended.select(*columns), real.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("intended")).unionByName(b.exceptAll(a).withColumn("side", F.lit("real")))


def factor_lags(df: DataFrame, lags: list[int]) -> DataFrame:
    """(lag, n, corr): correlation over all rows of a factor with its own value `lag` rows before."""
    out = None
    for k in lags:
        one = df.withColumn("_p", F.lag("factor", k).over(_by())).where("factor is not null and _p is not null").agg(F.lit(k).alias("lag"), F.count("*").alias("n"), F.corr("factor", "_p").alias("corr"))
        out = one if out is None else out.unionByName(one)
    return out
