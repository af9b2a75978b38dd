"""Resampling, stress, cost and lot studies in long form: keyed joins, grouped sums and windows; no Python works on single rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _w(*key: str, ts: str = "date"):
    return Window.partitionBy(*(key or ("symbol",))).orderBy(ts)


def _run(*key: str, ts: str = "date"):
    return _w(*key, ts=ts).rowsBetween(Window.unboundedPreceding, 0)


def _ratio(mean: Column, deviation: Column, periods: int = 252) -> Column:
    """Sharpe ratio a year; 0 without deviation."""
    return F.when(deviation > 1e-12, mean / deviation * math.sqrt(periods)).otherwise(0.0)


def draw(*parts: Column) -> Column:
    """A whole number below 2^32 that depends on the parts alone, so reruns and retried tasks draw the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 8), 16, 10).cast("long")


def block_bootstrap(df: DataFrame, paths: int, length: int, seed: int = 7) -> DataFrame:
    """(symbol, path, n, mean, sharpe) of circular block resamples of each symbol's returns; null returns count 0.

    A block is the difference of two running sums, so a path shuffles two rows for each block, not one for each day.
    """
    x = df.select("symbol", F.coalesce("ret", F.lit(0.0)).alias("r"), (F.row_number().over(_w()) - 1).cast("long").alias("i"))
    size = x.groupBy("symbol").agg(F.count("*").alias("n"))
    # The head again behind the end, so that blocks run on in a circle.
    head = x.where(F.col("i") < length).join(size, "symbol").select("symbol", "r", (F.col("i") + F.col("n")).alias("i"))
    before = _w(ts="i").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    sums = x.unionByName(head).select("symbol", "i", F.coalesce(F.sum("r").over(before), zero).alias("c1"), F.coalesce(F.sum(F.col("r") * F.col("r")).over(before), zero).alias("c2"))
    draws = size.withColumn("path", F.explode(F.sequence(F.lit(1), F.lit(paths)))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / length))))
    start = F.pmod(draw(F.lit(str(seed)), F.col("symbol").cast("string"), F.col("path").cast("string"), F.col("k").cast("string")), F.col("n"))
    draws = draws.withColumn("a", start).withColumn("b", F.col("a") + F.least(F.lit(length), F.col("n") - F.col("k") * length))
    ends = draws.select("symbol", "path", "n", F.explode(F.array(F.struct(F.col("a").alias("i"), F.lit(-1.0).alias("sign")), F.struct(F.col("b").alias("i"), F.lit(1.0).alias("sign")))).alias("e")).select("symbol", "path", "n", "e.*")
    g = ends.join(sums, ["symbol", "i"]).groupBy("symbol", "path").agg(F.first("n").alias("n"), F.sum(F.col("sign") * F.col("c1")).alias("s1"), F.sum(F.col("sign") * F.col("c2")).alias("s2"))
    mean = F.col("s1") / F.col("n")
    return g.select("symbol", "path", "n", mean.alias("mean"), _ratio(mean, F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, zero))).alias("sharpe"))


def bootstrap_interval(paths: DataFrame, level: float = 0.9) -> DataFrame:
    """Percentile interval and median of the paths' Sharpe ratios, and the share of paths that gain."""
    cut = (1 - level) / 2
    at = lambda q: F.percentile("sharpe", F.lit(q))
    return paths.groupBy("symbol").agg(F.count("*").alias("paths"), at(cut).alias("low"), at(0.5).alias("mid"), at(1 - cut).alias("high"), F.avg((F.col("mean") > 0).cast("double")).alias("gaining"))


def weight_shuffle(df: DataFrame, paths: int, seed: int = 7) -> DataFrame:
    """(symbol, paths, actual, p): share of shuffles of the weights over the dates whose summed weight times return reaches the actual one.

    Each row draws a key for every path where its symbol lies, and a path is one sort of the symbol's rows by it, so paths are never shuffled. A
    task holds one symbol, which has one row a date. Null weights and returns count 0.
    """
    x = df.select("symbol", F.coalesce("w", F.lit(0.0)).cast("double").alias("w"), F.coalesce("ret", F.lit(0.0)).cast("double").alias("r"), F.row_number().over(_w()).alias("i"))
    key = lambda path: draw(F.lit(str(seed)), F.col("symbol").cast("string"), path.cast("string"), F.col("i").cast("string"))
    x = x.sortWithinPartitions("symbol", "i").withColumn("h", F.transform(F.sequence(F.lit(1), F.lit(paths)), key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def mixed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            w, r = t.column("w").to_numpy(), t.column("r").to_numpy()
            h = t.column("h").combine_chunks().flatten().to_numpy().reshape(len(w), -1)
            v = (w[np.argsort(h, axis=0, kind="stable")] * r[:, None]).sum(axis=0)
            return pa.RecordBatch.from_arrays([t.column("symbol").chunk(0).slice(0, 1), pa.array([(w * r).sum()]), pa.array([v])], names=["symbol", "actual", "v"])

        for batch in batches:
            edge = np.r_[0, np.flatnonzero(batch.column("i").to_numpy() == 1), len(batch)]  # a symbol starts with its row 1
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if held and e > s and batch.column("i")[int(s)].as_py() == 1:
                    yield mixed()
                    held.clear()
                if e > s:
                    held.append(batch.slice(s, e - s))
        if held:
            yield mixed()

    found = x.mapInArrow(run, f"symbol {x.schema['symbol'].dataType.simpleString()}, actual double, v array<double>").withColumn("actual", F.round("actual", 9))
    reach = F.filter("v", lambda v: F.round(v, 9) >= F.col("actual"))
    return found.select("symbol", F.size("v").cast("long").alias("paths"), "actual", (F.size(reach) / F.size("v")).alias("p"))


def noisy(bars: DataFrame, samples: int, sigma: float, seed: int = 7, floor: float = 1e-9) -> DataFrame:
    """Bars `samples` times over with a close times 1 + N(0, sigma), at least `floor`; the normals come from drawn keys.

    Bars are dealt by symbol before they are repeated, so a symbol's samples lie in its task and windows and sums by symbol and sample shuffle nothing more.
    """
    x = bars.repartition("symbol").withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    part = [F.col("symbol").cast("string"), F.col("date").cast("string"), F.col("sample").cast("string")]
    u = [(draw(F.lit(f"{seed}{c}"), *part) + 0.5) / 4294967296.0 for c in "ab"]
    normal = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])
    return x.withColumn("close", F.greatest(F.lit(floor), F.col("close") * (1 + sigma * normal)))


def crossing_under_noise(bars: DataFrame, samples: int, sigma: float, fast: int, slow: int) -> DataFrame:
    """5th, 50th and 95th percentile over noisy samples of the Sharpe ratio of a moving-average crossing, signals taken anew on each sample."""
    x, w = noisy(bars, samples, sigma), _w("symbol", "sample")
    mean = lambda n: F.avg("close").over(w.rowsBetween(1 - n, 0))
    full = F.count("close").over(w.rowsBetween(1 - slow, 0)) == slow
    x = x.withColumn("w", F.when(full, F.signum(F.round(mean(fast) - mean(slow), 9))).otherwise(0.0)).withColumn("r", F.col("close") / F.lag("close").over(w) - 1)
    x = x.withColumn("g", F.coalesce(F.lag("w").over(w) * F.col("r"), F.lit(0.0)))
    s = x.groupBy("symbol", "sample").agg(_ratio(F.avg("g"), F.stddev_pop("g")).alias("sharpe"))
    at = lambda q: F.percentile("sharpe", F.lit(q))
    return s.groupBy("symbol").agg(F.count("*").alias("samples"), at(0.05).alias("low"), at(0.5).alias("mid"), at(0.95).alias("high"))


def scenario_replay(df: DataFrame, path: list[float], at: int) -> DataFrame:
    """Total return and deepest fall by symbol, as they were and with the returns from row `at` on replaced by the scenario's."""
    k = F.row_number().over(_w()) - 1 - at
    shock = F.when((k >= 0) & (k < len(path)), F.get(F.array(*[F.lit(float(v)) for v in path]), k.cast("int")))
    x = df.select("symbol", "date", F.coalesce("ret", F.lit(0.0)).alias("r0"), F.coalesce(shock, "ret", F.lit(0.0)).alias("r1"))
    for c in "01":
        x = x.withColumn(f"v{c}", F.exp(F.sum(F.log1p(f"r{c}")).over(_run()))).withColumn(f"d{c}", F.col(f"v{c}") / F.greatest(F.lit(1.0), F.max(f"v{c}").over(_run())) - 1)
    total = lambda c: F.exp(F.sum(F.log1p(f"r{c}"))) - 1
    return x.groupBy("symbol").agg(F.count("*").alias("n"), total(0).alias("total"), F.min("d0").alias("fall"), total(1).alias("stressed_total"), F.min("d1").alias("stressed_fall"))


def withdrawals(monthly: DataFrame, months: int) -> DataFrame:
    """(symbol, starts, worst, worst_month, median): the largest constant share of the first capital that can be taken at each month's end and lasts `months`.

    Capital lasts while the withdrawals, discounted by growth, stay below one, so a start month's rate is one over a forward window's sum.
    """
    growth = F.log1p("ret")
    x = monthly.withColumn("l", F.sum(growth).over(_run(ts="month")))
    ahead = _w(ts="month").rowsBetween(0, months - 1)
    rate = F.exp(growth - F.col("l")) / F.sum(F.exp(-F.col("l"))).over(ahead)
    x = x.select("symbol", "month", F.round(F.when(F.count("*").over(ahead) == months, rate), 9).alias("rate")).where("rate is not null")
    return x.groupBy("symbol").agg(F.count("*").alias("starts"), F.min("rate").alias("worst"), F.min_by("month", F.struct("rate", "month")).alias("worst_month"), F.percentile("rate", F.lit(0.5)).alias("median"))


def event_study(bars: DataFrame, thresholds: list[float], multiples: list[float], horizons: list[int], look: int = 20) -> DataFrame:
    """Forward returns after shocks: (threshold, multiple, horizon, events, mean, win_rate), where the return reaches the threshold and volume the multiple of its trailing mean."""
    w = _w()
    back = w.rowsBetween(1 - look, 0)
    fwd = F.array(*[F.struct(F.lit(h).alias("horizon"), (F.lead("close", h).over(w) / F.col("close") - 1).alias("fwd")) for h in horizons])
    x = bars.select("ret", F.when(F.count("volume").over(back) == look, F.col("volume") / F.avg("volume").over(back)).alias("busy"), fwd.alias("f")).where(F.col("ret") >= min(thresholds))
    x = x.select("ret", "busy", F.explode("f").alias("f")).select("ret", "busy", "f.*").where("fwd is not null")
    several = lambda v: F.explode(F.array(*[F.lit(float(c)) for c in v]))
    x = x.withColumn("threshold", several(thresholds)).where("ret >= threshold").withColumn("multiple", several(multiples)).where("busy >= multiple")
    return x.groupBy("threshold", "multiple", "horizon").agg(F.count("*").alias("events"), F.avg("fwd").alias("mean"), F.avg((F.col("fwd") > 0).cast("double")).alias("win_rate"))


def market_sweep(df: DataFrame, market: Column, least: float = 0.0) -> DataFrame:
    """Metrics of one rule's returns by market, each market's distance to the best one, and whether it passes."""
    g = df.where("net is not null").groupBy(market.alias("market")).agg(F.count("net").alias("n"), F.avg("net").alias("mean"), F.round(_ratio(F.avg("net"), F.stddev_pop("net")), 9).alias("sharpe"))
    return g.withColumn("spread", F.max("sharpe").over(Window.partitionBy(F.lit(1))) - F.col("sharpe")).withColumn("passed", F.col("sharpe") > least)


def trial_pressure(ledger: DataFrame) -> DataFrame:
    """By run: distinct strategies, trials, manual overrides, out-of-sample touches and trials for each bar of data."""
    return ledger.groupBy("run").agg(
        F.countDistinct("strategy").alias("strategies"), F.count("*").alias("trials"), F.count_if("manual").alias("manual"), F.count_if("touched").alias("touched"), (F.count("*") / F.max("bars")).alias("pressure")
    )


def signal_attribution(df: DataFrame, signals: list[str]) -> DataFrame:
    """(symbol, signal, total, contribution, rank): what the mean of the signals earns on the same row, less what it earns without one of them."""
    s = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in signals}
    whole, r, n = sum(s.values(), F.lit(0.0)), F.coalesce("ret", F.lit(0.0)), len(signals)
    g = df.groupBy("symbol").agg(F.sum(whole / n * r).alias("total"), *[F.sum((whole - s[c]) / max(1, n - 1) * r).alias(f"without_{c}") for c in signals])
    long = g.select("symbol", "total", F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.round(F.col("total") - F.col(f"without_{c}"), 9).alias("contribution")) for c in signals])).alias("s")).select("symbol", "total", "s.*")
    return long.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("contribution"), "signal")))


def benchmark_pack(df: DataFrame, cash: float, periods: int = 252) -> DataFrame:
    """A strategy's `net` against holding the asset, cash and the equal basket: return and deviation a year, Sharpe, excess and verdict by (symbol, baseline)."""
    basket = df.where("ret is not null").groupBy("date").agg(F.avg("ret").alias("basket"))
    x = df.where("ret is not null").join(basket, "date")
    series = {"strategy": F.col("net"), "hold": F.col("ret"), "cash": F.lit(cash / periods), "basket": F.col("basket")}
    x = x.select("symbol", F.explode(F.array(*[F.struct(F.lit(k).alias("baseline"), v.alias("r")) for k, v in series.items()])).alias("s")).select("symbol", "s.*")
    g = x.groupBy("symbol", "baseline").agg(F.count("r").alias("n"), (F.avg("r") * periods).alias("ret"), (F.stddev_pop("r") * math.sqrt(periods)).alias("vol"))
    g = g.withColumn("sharpe", F.round(F.when(F.col("vol") > 1e-9, F.col("ret") / F.col("vol")).otherwise(0.0), 9))
    own = lambda c: F.max(F.when(F.col("baseline") == "strategy", F.col(c))).over(Window.partitionBy("symbol"))
    g = g.withColumn("excess", own("ret") - F.col("ret")).withColumn("edge", own("sharpe") - F.col("sharpe")).where("baseline <> 'strategy'")
    return g.withColumn("verdict", F.when(F.col("edge") > 0, "beats").otherwise("trails"))


def cost_components(df: DataFrame, components: dict[str, float], periods: int = 252) -> DataFrame:
    """(symbol, component, drag): yearly cost of each component (basis points of turnover); the first weight is a trade too."""
    turn = df.withColumn("t", F.abs(F.col("w") - F.lag("w", 1, 0.0).over(_w()))).groupBy("symbol").agg((F.sum("t") / F.count("*") * periods).alias("turnover"))
    return turn.select("symbol", "turnover", F.explode(F.array(*[F.struct(F.lit(k).alias("component"), (F.col("turnover") * v / 1e4).alias("drag")) for k, v in components.items()])).alias("c")).select("symbol", "turnover", "c.*")


def capacity_curve(df: DataFrame, amounts: list[float], impact: float, look: int = 20) -> DataFrame:
    """(symbol, amount, sharpe, within): Sharpe with a cost in proportion to the share of daily turnover that a trade takes; `within` until the ratio first falls.

    Trades before `look` days of turnover are known cost nothing.
    """
    w = _w()
    trade = F.abs(F.col("w") - F.lag("w", 1, 0.0).over(w))
    day = F.avg(F.col("close") * F.col("volume")).over(w.rowsBetween(1 - look, 0))
    known = F.count("volume").over(w.rowsBetween(1 - look, 0)) == look
    x = df.select("symbol", (F.lag("w", 1, 0.0).over(w) * F.coalesce("ret", F.lit(0.0))).alias("g"), trade.alias("t"), F.when(known, day).alias("day"))
    x = x.withColumn("amount", F.explode(F.array(*[F.lit(float(a)) for a in amounts])))
    net = F.col("g") - F.col("t") * impact * F.coalesce(F.col("amount") * F.col("t") / F.col("day"), F.lit(0.0))
    g = x.withColumn("net", net).groupBy("symbol", "amount").agg(F.round(_ratio(F.avg("net"), F.stddev_pop("net")), 9).alias("sharpe"))
    fell = (F.col("sharpe") < F.lag("sharpe").over(_w(ts="amount"))).cast("int")
    return g.withColumn("f", F.coalesce(fell, F.lit(0))).withColumn("within", F.sum("f").over(_run(ts="amount")) == 0).drop("f")


def execution_costs(fills: DataFrame) -> DataFrame:
    """By order: filled quantity, average price, effective and realised spread, slippage and opportunity cost, commissions and what stayed unfilled.

    `fills` has (order_id, side 1 or -1, qty, price, arrival, benchmark, requested, commission), the last but two being the order's. Orders without quantity have null prices.
    """
    g = fills.groupBy("order_id").agg(
        F.sum("qty").alias("filled"), F.sum(F.col("qty") * F.col("price")).alias("paid"), (F.sum(F.col("qty") * F.col("price")) / F.nullif(F.sum("qty"), F.lit(0.0))).alias("vwap"), F.sum("commission").alias("commission"), *[F.max(c).alias(c) for c in ("side", "arrival", "benchmark", "requested")]
    )
    left = F.greatest(F.lit(0.0), F.col("requested") - F.col("filled"))
    return g.select(
        "order_id", "filled", "vwap", (2 * F.abs(F.col("vwap") - F.col("arrival"))).alias("effective"), (2 * (F.col("vwap") - F.col("benchmark")) * F.col("side") + 0.0).alias("realised"),
        ((F.col("paid") - F.col("arrival") * F.col("filled")) * F.col("side") + 0.0).alias("slippage"), ((F.col("benchmark") - F.col("arrival")) * F.col("side") * left + 0.0).alias("opportunity"), "commission", left.alias("unfilled"),
    )


def fifo_gains(trades: DataFrame, long_days: int = 365) -> DataFrame:
    """(symbol, matched, excess, short_gain, long_gain): sells meet the oldest lots first; what is sold beyond the holding is excess and meets none.

    `trades` has (symbol, date, seq, side 1 or -1, qty, price). On the axis of cumulative quantity, buys and sells both lie end to end, so the lot
    and the sell in force between two cuts are the last that began: one sort for each symbol, no interval join.
    """
    in_order = Window.partitionBy("symbol").orderBy("date", "seq").rowsBetween(Window.unboundedPreceding, 0)
    x = trades.where("qty > 0").withColumn("net", F.sum(F.col("side") * F.col("qty")).over(in_order))
    x = x.withColumn("low", F.least(F.lit(0.0), F.min("net").over(in_order)))
    short = F.lag("low", 1, 0.0).over(Window.partitionBy("symbol").orderBy("date", "seq")) - F.col("low")
    x = x.withColumn("excess", F.when(F.col("side") < 0, short).otherwise(0.0)).withColumn("qty", F.col("qty") - F.col("excess"))
    side = Window.partitionBy("symbol", "side").orderBy("date", "seq").rowsBetween(Window.unboundedPreceding, 0)
    lots = x.withColumn("hi", F.sum("qty").over(side)).withColumn("lo", F.col("hi") - F.col("qty")).where("qty > 0")
    own = F.struct("hi", "date", "price")
    cuts = lots.groupBy("symbol", "lo").agg(F.max(F.when(F.col("side") > 0, own)).alias("buy"), F.max(F.when(F.col("side") < 0, own)).alias("sell"))
    run = _run(ts="lo")
    cuts = cuts.select("symbol", "lo", F.last("buy", True).over(run).alias("buy"), F.last("sell", True).over(run).alias("sell"), F.lead("lo").over(_w(ts="lo")).alias("next"))
    n = F.least("next", "buy.hi", "sell.hi") - F.col("lo")
    cuts = cuts.where("buy is not null and sell is not null").withColumn("n", n).where("n > 0")
    gain, is_long = F.col("n") * (F.col("sell.price") - F.col("buy.price")), F.datediff("sell.date", "buy.date") > long_days
    zero = F.lit(0.0)
    g = cuts.groupBy("symbol").agg(F.sum("n").alias("matched"), F.sum(F.when(~is_long, gain).otherwise(zero)).alias("short_gain"), F.sum(F.when(is_long, gain).otherwise(zero)).alias("long_gain"))
    whole = x.groupBy("symbol").agg(F.sum("excess").alias("excess")).join(g, "symbol", "left")
    return whole.select("symbol", "excess", *[F.coalesce(c, zero).alias(c) for c in ("matched", "short_gain", "long_gain")])


def page_hinkley(df: DataFrame, col: str, delta: float, threshold: float) -> DataFrame:
    """(symbol, date, statistic, alarm) of the Page-Hinkley test with the plain running mean; the first row only starts the mean, and nulls are left out.

    max(0, s + d) step by step is the running sum less its own minimum, so two windows do.
    """
    x = df.where(F.col(col).isNotNull()).withColumn("i", F.row_number().over(_w()))
    step = F.when(F.col("i") == 1, 0.0).otherwise(F.col(col) - F.avg(col).over(_run()) - delta)
    x = x.withColumn("d", step).withColumn("s", F.sum("d").over(_run()))
    x = x.select("symbol", "date", (F.col("s") - F.least(F.lit(0.0), F.min("s").over(_run()))).alias("statistic"))
    return x.withColumn("alarm", F.col("statistic") > threshold)


def distribution_shift(df: DataFrame, col: str, recent: Column, bins: int = 10, smooth: float = 0.5) -> DataFrame:
    """(symbol, n_reference, n_recent, kl, outside): divergence of the recent histogram from the reference's equal bins, and the share of recent rows outside its range."""
    x = df.where(F.col(col).isNotNull()).select("symbol", F.col(col).alias("v"), recent.alias("recent"))
    edge = x.groupBy("symbol").agg(F.min(F.when(~F.col("recent"), F.col("v"))).alias("a"), F.max(F.when(~F.col("recent"), F.col("v"))).alias("b")).where("b > a")
    x = x.join(edge, "symbol").withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.round((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * bins, 9)))).cast("int"))
    c = x.groupBy("symbol", "bin").agg(F.count_if(~F.col("recent")).alias("q"), F.count_if("recent").alias("p"), F.count_if(F.col("recent") & ((F.col("v") < F.col("a")) | (F.col("v") > F.col("b")))).alias("out"))
    every = Window.partitionBy("symbol")
    n = lambda k: F.sum(k).over(every)
    c = c.withColumns({"n_q": n("q"), "n_p": n("p"), "held": F.count("*").over(every)})
    share = lambda k: (F.col(k) + smooth) / (F.col(f"n_{k}") + smooth * bins)
    c = c.withColumn("t", share("p") * F.log(share("p") / share("q")))
    g = c.groupBy("symbol").agg(F.max("n_q").alias("n_reference"), F.max("n_p").alias("n_recent"), F.max("held").alias("held"), F.sum("t").alias("kl"), F.sum("out").alias("out"))
    bare = lambda k: smooth / (F.col(k) + smooth * bins)
    rest = (bins - F.col("held")) * bare("n_recent") * F.log(bare("n_recent") / bare("n_reference"))  # bins that neither side has
    return g.select("symbol", "n_reference", "n_recent", (F.col("kl") + rest).alias("kl"), (F.col("out") / F.nullif(F.col("n_recent"), F.lit(0))).alias("outside"))


def surprises(quarterly: DataFrame, look: int = 8, longest: int = 8) -> DataFrame:
    """(key, quarter, value, change, surprise, streak): change on the year-ago quarter, its distance to the mean of the `look` changes before over their deviation, and the run of rises, at most `longest`.

    A quarter without rows is a missing quarter, not the one before: the year-ago value is that of four quarters back or null.
    """
    w = _w("key", ts="quarter")
    year_ago = F.max("value").over(w.rangeBetween(-4, -4))
    x = quarterly.withColumn("change", F.col("value") - year_ago)
    past = w.rowsBetween(-look, -1)
    full = F.count("change").over(past) == look
    x = x.withColumn("surprise", F.when(full, (F.col("change") - F.avg("change").over(past)) / F.nullif(F.stddev("change").over(past), F.lit(0.0))))
    x = x.withColumn("stop", F.sum((~F.coalesce(F.col("change") > 0, F.lit(False))).cast("int")).over(_run("key", ts="quarter")))
    streak = F.sum(F.when(F.col("change") > 0, 1).otherwise(0)).over(_run("key", "stop", ts="quarter"))
    return x.select("key", "quarter", "value", "change", "surprise", F.least(streak, F.lit(longest)).alias("streak"))


def signal_weights(df: DataFrame, signal: Callable[[], Column]) -> DataFrame:
    """`df` with the weight `w` that a signal (a function that gives a column) takes: null and not finite count 0, the rest is held to -1 to 1."""
    return df.withColumn("w", signal().cast("double")).withColumn("w", F.when(F.col("w").isNull() | F.isnan("w") | (F.abs("w") == float("inf")), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "w"))))


def causality(df: DataFrame, build: Callable[[DataFrame], DataFrame], cut: str, col: str = "w", tolerance: float = 1e-9) -> DataFrame:
    """(symbol, checked, changed): rows up to the cut whose value changes when later rows are not there; a signal that looks ahead has some."""
    part = build(df.where(F.col("date") <= F.lit(cut).cast("date"))).select("symbol", "date", F.col(col).alias("short"))
    both = part.join(build(df).select("symbol", "date", F.col(col).alias("whole")), ["symbol", "date"])
    return both.groupBy("symbol").agg(F.count("*").alias("checked"), F.count_if(~(F.col("short").eqNullSafe(F.col("whole")) | F.coalesce(F.abs(F.col("short") - F.col("whole")) <= tolerance, F.lit(False)))).alias("changed"))
