"""Risk, attribution and validation over return panels (symbol, date, ret), in long form."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _w(key: str = "symbol", ts: str = "date"):
    return Window.partitionBy(key).orderBy(ts)


def _run(key: str = "symbol", ts: str = "date"):
    return _w(key, ts).rowsBetween(Window.unboundedPreceding, 0)


def _safe(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def costed_returns(df: DataFrame, bps: float, borrow: float = 0.0) -> DataFrame:
    """Carried weight times return, less turnover cost (the first weight is a trade too) and a year's borrow rate on the carried short side."""
    held = F.lag("w", 1, 0.0).over(_w())
    gross = held * F.coalesce("ret", F.lit(0.0))
    return df.withColumn("net", gross - F.abs(F.col("w") - held) * bps / 1e4 - F.abs(F.least(held, F.lit(0.0))) * borrow / 252)


def metric_suite(df: DataFrame, col: str = "net", periods: int = 252) -> DataFrame:
    """By symbol: growth a year over all rows, deepest fall, Calmar, Sharpe (population deviation), Sortino (deviation of the losses), skew, Pearson kurtosis, win rate, profit factor, final value. Zero deviations give 0; Calmar is null without a fall."""
    r = F.col(col)
    df = df.withColumn("_v", F.exp(F.sum(F.log1p(F.coalesce(r, F.lit(0.0)))).over(_run()))).withColumn("_dd", F.col("_v") / F.max("_v").over(_run()) - 1)
    x = df.groupBy("symbol").agg(
        F.count("*").alias("n_raw"), F.count(r).alias("n"), F.exp(F.sum(F.log1p(r))).alias("final"), F.min("_dd").alias("mdd"), F.avg(r).alias("_m"), F.stddev_pop(r).alias("_s"), F.count_if(r < 0).alias("_l"),
        F.stddev_pop(F.when(r < 0, r)).alias("_d"), F.skewness(r).alias("_k3"), F.kurtosis(r).alias("_k4"), F.avg((r > 0).cast("double")).alias("win_rate"), F.sum(F.greatest(r, F.lit(0.0))).alias("_g"), F.sum(F.least(r, F.lit(0.0))).alias("_b"),
    )
    down = F.when(F.col("_l") > 1, F.col("_d")).otherwise(F.col("_s"))
    root = math.sqrt(periods)
    x = x.withColumn("cagr", F.pow("final", periods / F.col("n_raw")) - 1)
    ratio = lambda d: F.when(d > 1e-12, F.col("_m") / d * root).otherwise(0.0)
    shape = lambda c: F.when(F.col("_s") > 1e-12, c).otherwise(0.0)
    return x.select("symbol", "n", "final", "cagr", "mdd", (F.col("cagr") / _safe(-F.col("mdd"))).alias("calmar"), ratio(F.col("_s")).alias("sharpe"), ratio(down).alias("sortino"), shape(F.col("_k3")).alias("skew"), shape(F.col("_k4") + 3).alias("kurtosis"), "win_rate", F.when(F.col("_b") < 0, F.col("_g") / -F.col("_b")).otherwise(0.0).alias("profit_factor"))


def return_metrics(df: DataFrame, periods: int = 252) -> DataFrame:
    """Compounded and expected returns, geometric mean, exposure and volatility by symbol."""
    r = F.col("ret")
    return df.groupBy("symbol").agg(F.count(r).alias("n"), (F.exp(F.sum(F.log1p(r))) - 1).alias("compounded"), F.avg(r).alias("mean"), (F.exp(F.avg(F.log1p(r))) - 1).alias("geometric"), F.avg((r != 0).cast("double")).alias("exposure"), (F.stddev(r) * math.sqrt(periods)).alias("volatility"))


def drawdown_risk(df: DataFrame, periods: int = 252) -> DataFrame:
    """Ulcer and pain index, their ratios to the yearly growth, and the recovery factor."""
    r = F.coalesce("ret", F.lit(0.0))
    df = df.withColumn("_v", F.exp(F.sum(F.log1p(r)).over(_run()))).withColumn("_dd", F.col("_v") / F.max("_v").over(_run()) - 1)
    x = df.groupBy("symbol").agg(F.sqrt(F.avg(F.col("_dd") ** 2)).alias("ulcer"), (-F.avg("_dd")).alias("pain"), F.min("_dd").alias("mdd"), F.exp(F.sum(F.log1p(r))).alias("_f"), F.count("*").alias("_n"))
    cagr = F.pow("_f", periods / F.col("_n")) - 1
    return x.select("symbol", "ulcer", "pain", (cagr / _safe(F.col("ulcer"))).alias("martin"), (cagr / _safe(F.col("pain"))).alias("pain_ratio"), ((F.col("_f") - 1) / _safe(-F.col("mdd"))).alias("recovery"))


def ratio_metrics(df: DataFrame, periods: int = 252, rf: float = 0.0) -> DataFrame:
    """Sharpe and Sortino over n - 1, omega, gain to pain, upside potential, and the Sharpe with a penalty for first-lag correlation."""
    e = F.col("ret") - rf / periods
    x = df.withColumn("_e", e).withColumn("_p", F.lag("_e").over(_w())).where("ret is not null")
    n, up, down = F.count("_e"), F.sum(F.greatest("_e", F.lit(0.0))), F.sum(F.least("_e", F.lit(0.0)))
    root = math.sqrt(periods)
    semi = F.sqrt(F.sum(F.least("_e", F.lit(0.0)) ** 2) / (n - 1))
    rho = F.corr("_e", "_p")
    return x.groupBy("symbol").agg(
        (F.avg("_e") / _safe(F.stddev("_e")) * root).alias("sharpe"), (F.avg("_e") / _safe(semi) * root).alias("sortino"), (up / _safe(-down)).alias("omega"), (F.sum("_e") / _safe(-down)).alias("gain_pain"),
        (F.avg(F.greatest("_e", F.lit(0.0))) / _safe(F.sqrt(F.avg(F.least("_e", F.lit(0.0)) ** 2)))).alias("upside"), (F.avg("_e") / _safe(F.stddev("_e")) * root / F.sqrt(1 + 2 * F.abs(rho))).alias("smart_sharpe"), rho.alias("rho"),
    )


def concentration(df: DataFrame, units: int = 10) -> DataFrame:
    """Gini of absolute returns and the ruin proxy of the win rate."""
    a = df.where("ret is not null").withColumn("_a", F.abs("ret"))
    a = a.withColumn("_i", F.row_number().over(Window.partitionBy("symbol").orderBy("_a")))
    n, s, edge = F.count("*"), F.sum("_a"), 2 * F.avg((F.col("ret") > 0).cast("double")) - 1
    gini = (2 * F.sum(F.col("_i") * F.col("_a")) - (n + 1) * s) / (n * _safe(s))
    return a.groupBy("symbol").agg(gini.alias("gini"), F.when(edge <= 0, 1.0).otherwise(F.pow((1 - edge) / (1 + edge), units)).alias("ruin"))


def outlier_ratios(df: DataFrame, q: float = 0.95) -> DataFrame:
    """Mean of the best wins over the mean win, and of the worst losses over the mean loss; quantiles are interpolated."""
    wins, losses = F.when(F.col("ret") > 0, F.col("ret")), F.when(F.col("ret") < 0, F.col("ret"))
    cut = df.groupBy("symbol").agg(F.percentile(wins, F.lit(q)).alias("_hi"), F.percentile(losses, F.lit(1 - q)).alias("_lo"))
    x = df.join(cut, "symbol")
    return x.groupBy("symbol").agg((F.avg(F.when(wins >= F.col("_hi"), F.col("ret"))) / F.avg(wins)).alias("wins"), (F.avg(F.when(losses <= F.col("_lo"), F.col("ret"))) / F.avg(losses)).alias("losses"))


def yearly(df: DataFrame) -> DataFrame:
    """Compounded return, best and worst row and share of winning rows by year."""
    return df.where("ret is not null").groupBy("symbol", F.year("date").alias("year")).agg((F.exp(F.sum(F.log1p("ret"))) - 1).alias("ret"), F.max("ret").alias("best"), F.min("ret").alias("worst"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"))


def rolling_correlation(df: DataFrame, market: DataFrame, n: int) -> DataFrame:
    """Trailing correlation and beta to a market (date, market), one row a date; null until n pairs are there."""
    x = df.join(F.broadcast(market), "date").where("ret is not null and market is not null")
    w = _w().rowsBetween(1 - n, 0)
    full = F.count("*").over(w) == n
    cov = F.covar_pop("ret", "market").over(w)
    var = F.var_pop("market").over(w)
    sd = F.stddev_pop("ret").over(w) * F.sqrt(var)
    return x.select("symbol", "date", F.when(full, cov / _safe(sd)).alias("corr"), F.when(full, cov / _safe(var)).alias("beta"))


def market_of(df: DataFrame) -> DataFrame:
    """(date, market): the mean return of each date."""
    return df.where("ret is not null").groupBy("date").agg(F.avg("ret").alias("market"))


def regression(df: DataFrame, market: DataFrame, periods: int = 252, least: int = 20) -> DataFrame:
    """Alpha, beta, R squared, tracking error, information ratio and idiosyncratic volatility against a market, from moments alone."""
    x = df.join(market, "date").where("ret is not null and market is not null").withColumn("_d", F.col("ret") - F.col("market"))
    g = x.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("ret").alias("_y"), F.avg("market").alias("_x"), F.covar_samp("ret", "market").alias("_c"), F.var_samp("market").alias("_vx"), F.var_samp("ret").alias("_vy"), F.stddev("_d").alias("_te"), F.avg("_d").alias("_a")).where(F.col("n") >= least)
    beta = F.col("_c") / _safe(F.col("_vx"))
    return g.select("symbol", "n", beta.alias("beta"), ((F.col("_y") - beta * F.col("_x")) * periods).alias("alpha"), (F.col("_c") ** 2 / _safe(F.col("_vx") * F.col("_vy"))).alias("r2"), (F.col("_te") * math.sqrt(periods)).alias("tracking"), (F.col("_a") / _safe(F.col("_te"))).alias("information"), F.sqrt((F.col("_vy") - beta * F.col("_c")) * (F.col("n") - 1) / (F.col("n") - 2)).alias("idiosyncratic"))


def coskewness(df: DataFrame, market: DataFrame) -> DataFrame:
    """Centred cross moment of a return with the square of the market's, over their deviations."""
    x = df.join(market, "date").where("ret is not null and market is not null")
    w = Window.partitionBy("symbol")
    x = x.withColumns({"_a": F.col("ret") - F.avg("ret").over(w), "_b": F.col("market") - F.avg("market").over(w)})
    return x.groupBy("symbol").agg((F.avg(F.col("_a") * F.col("_b") ** 2) / _safe(F.sqrt(F.avg(F.col("_a") ** 2)) * F.avg(F.col("_b") ** 2))).alias("coskewness"))


def capped_weights(df: DataFrame, gross: float, net: float) -> DataFrame:
    """Weights of each date scaled so that neither their absolute sum nor their sum passes its cap."""
    w = Window.partitionBy("date")
    scale = F.least(F.lit(1.0), gross / _safe(F.sum(F.abs("w")).over(w)), net / _safe(F.abs(F.sum("w").over(w))))
    return df.withColumn("w", F.col("w") * F.coalesce(scale, F.lit(1.0)))


def portfolio_returns(df: DataFrame) -> DataFrame:
    """(date, ret, gross, turnover): the sum of carried weight times return over symbols, with the leverage and the traded weight."""
    held = F.lag("w", 1, 0.0).over(_w())
    x = df.withColumns({"_c": held * F.coalesce("ret", F.lit(0.0)), "_t": F.abs(F.col("w") - held)})
    return x.groupBy("date").agg(F.sum("_c").alias("ret"), F.sum(F.abs("w")).alias("gross"), F.sum("_t").alias("turnover"))


def contributions(df: DataFrame, group: Column) -> DataFrame:
    """Sum of carried weight times return by group and its share of the whole."""
    x = df.withColumn("_c", F.lag("w", 1, 0.0).over(_w()) * F.coalesce("ret", F.lit(0.0))).groupBy(group.alias("grp")).agg(F.sum("_c").alias("contribution"), F.count("*").alias("n"))
    return x.withColumn("share", F.col("contribution") / _safe(F.sum("contribution").over(Window.partitionBy())))  # a row for each group


def brinson(df: DataFrame) -> DataFrame:
    """(date, category): allocation, selection and interaction from (date, category, wp, wb, rp, rb)."""
    total = F.sum(F.col("wb") * F.col("rb")).over(Window.partitionBy("date"))
    x = df.withColumn("_t", total)
    return x.select("date", "category", ((F.col("wp") - F.col("wb")) * (F.col("rb") - F.col("_t"))).alias("allocation"), (F.col("wb") * (F.col("rp") - F.col("rb"))).alias("selection"), ((F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb"))).alias("interaction"))


def shrunk(cov: DataFrame, intensity: float, variances: DataFrame | None = None) -> DataFrame:
    """Covariances drawn to the constant-variance target: the mean variance on the diagonal, 0 beside it. `variances` (cov), where given, are those of the diagonal, so that pairs are not made twice."""
    mean = (cov.where("a = b") if variances is None else variances).agg(F.avg("cov").alias("_mu"))
    x = cov.join(F.broadcast(mean), F.lit(True))  # one row
    return x.select("a", "b", ((1 - intensity) * F.col("cov") + F.when(F.col("a") == F.col("b"), intensity * F.col("_mu")).otherwise(0.0)).alias("cov"))


def pair_similarity(cov: DataFrame, duplicate: float) -> DataFrame:
    """Pairs with their correlation and whether they count as duplicates."""
    return cov.where("a < b").select("a", "b", "n", "corr", (F.col("corr") >= duplicate).alias("duplicate"))


def expected_shortfall(df: DataFrame, levels: list[float]) -> DataFrame:
    """Loss at and beyond each level's quantile, as positive numbers."""
    out = None
    for q in levels:
        cut = df.groupBy("symbol").agg(F.percentile("ret", F.lit(q)).alias("_q"))
        one = df.join(cut, "symbol").where(F.col("ret") <= F.col("_q")).groupBy("symbol").agg(F.lit(q).alias("level"), (-F.max("_q")).alias("var"), (-F.avg("ret")).alias("es"))
        out = one if out is None else out.unionByName(one)
    return out


def stressed_quantile(df: DataFrame, start: str, end: str, q: float) -> DataFrame:
    """The quantile of returns inside a window of dates."""
    return df.where(F.col("date").between(start, end)).groupBy("symbol").agg(F.count("ret").alias("n"), F.percentile("ret", F.lit(q)).alias("quantile"))


def regime_metrics(df: DataFrame, state: Column, periods: int = 252) -> DataFrame:
    """Metrics of the rows in each state."""
    r = F.col("ret")
    return df.where(r.isNotNull()).groupBy("symbol", state.alias("state")).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev(r).alias("deviation"), (F.avg(r) / _safe(F.stddev(r)) * math.sqrt(periods)).alias("sharpe"))


def scenarios(df: DataFrame, table: list[tuple[str, float, float]], bps: float) -> DataFrame:
    """Mean and deviation of net returns under (name, cost multiplier, return multiplier); the table is explode, not a join."""
    held = F.lag("w", 1, 0.0).over(_w())
    x = df.withColumns({"_g": held * F.coalesce("ret", F.lit(0.0)), "_t": F.abs(F.col("w") - held)})
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(c).alias("c"), F.lit(m).alias("m")) for n, c, m in table]))
    x = x.select("symbol", "_g", "_t", each.alias("s")).withColumn("net", F.col("_g") * F.col("s.m") - F.col("_t") * F.col("s.c") * bps / 1e4)
    return x.groupBy("symbol", F.col("s.scenario").alias("scenario")).agg(F.sum("net").alias("total"), F.stddev("net").alias("deviation"))


def variant_screen(df: DataFrame, grid: list[tuple[int, int]], bps: float) -> DataFrame:
    """(fast, slow): mean and deviation of the equal-weight return over symbols for each crossing of the grid; all averages of a row come from one sort."""
    avg = lambda n: F.when(F.count("close").over(_w().rowsBetween(1 - n, 0)) == n, F.avg("close").over(_w().rowsBetween(1 - n, 0)))
    lengths = sorted({n for pair in grid for n in pair})
    x = df.withColumns({f"_m{n}": avg(n) for n in lengths})
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("fast"), F.lit(b).alias("slow"), F.coalesce(F.signum(F.col(f"_m{a}") - F.col(f"_m{b}")), F.lit(0.0)).alias("w")) for a, b in grid]))
    x = x.select("symbol", "date", "ret", each.alias("v")).select("symbol", "date", "ret", "v.*")
    w = Window.partitionBy("symbol", "fast", "slow").orderBy("date")
    held = F.lag("w").over(w)
    x = x.withColumn("_n", F.when(held.isNull(), 0.0).otherwise(held * F.coalesce("ret", F.lit(0.0)) - F.abs(F.col("w") - held) * bps / 1e4))
    daily = x.groupBy("fast", "slow", "date").agg(F.avg("_n").alias("r"))
    return daily.groupBy("fast", "slow").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("deviation"))


def purged_folds(df: DataFrame, splits: int, horizon: int, embargo: int) -> DataFrame:
    """(symbol, fold, n_test, n_train): contiguous folds, training rows whose label of `horizon` rows reaches into the test rows and rows within `embargo` of any fold's edge are left out.

    Rows are only counted: what is left out of a fold is a union of ranges of row numbers, which the number of rows fixes.
    """
    x = df.groupBy("symbol").agg(F.count("*").alias("n")).withColumn("size", F.expr(f"n div {splits}")).where("size > 0")
    n, one = F.col("n"), F.lit(1)
    edges = [(F.lit(k) * F.col("size"), (n if k == splits - 1 else F.lit(k + 1) * F.col("size")) - 1) for k in range(splits)]

    def left_out(k: int) -> Column:
        lo, hi = edges[k]
        ranges = [(lo, hi), (F.when(lo < n - 1, lo - horizon + 1).otherwise(lo), hi), (hi + 1, hi + embargo)]
        for other, (a, b) in enumerate(edges):
            if other != k:
                ranges += [(a - embargo, a - 1), (b + 1, b + embargo)]
        cut = F.array(*[F.struct(F.greatest(s, F.lit(0)).cast("long").alias("s"), F.least(e, n - 1).cast("long").alias("e")) for s, e in ranges])
        cut = F.array_sort(F.filter(cut, lambda r: r.e >= r.s))
        none = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("rows"))
        add = lambda acc, r: F.struct(F.greatest(acc.end, r.e).alias("end"), (acc.rows + F.greatest(r.e - F.greatest(r.s, acc.end + one) + one, F.lit(0))).alias("rows"))
        return F.aggregate(cut, none, add, lambda acc: acc.rows)

    folds = [F.struct(F.lit(k).alias("fold"), (hi - lo + 1).alias("n_test"), (n - left_out(k)).alias("n_train")) for k, (lo, hi) in enumerate(edges)]
    return x.select("symbol", F.inline(F.array(*folds)))


def split_combinations(df: DataFrame, blocks: int) -> DataFrame:
    """(combo, best, rank, n, logit): for every half of `blocks` spans of dates the strategy with the best in-sample Sharpe and its out-of-sample rank. Moments of a span are summed once; a combination is a sum of spans."""
    dates = df.select("date").distinct().withColumn("block", F.ntile(blocks).over(Window.orderBy("date")) - 1)  # a row for each date
    m = df.where("ret is not null").join(dates, "date").groupBy("symbol", "block").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") ** 2).alias("q"))
    combos = list(itertools.combinations(range(blocks), blocks // 2))
    inside = F.explode(F.array(*[F.struct(F.lit(k).alias("combo"), F.array(*map(F.lit, c)).alias("inside")) for k, c in enumerate(combos)]))
    x = m.select("*", inside.alias("c")).withColumn("is_", F.array_contains("c.inside", F.col("block")))
    pick = lambda c, side: F.sum(F.when(F.col("is_") == side, F.col(c)))
    sharpe = lambda side: (pick("s", side) / pick("n", side)) / _safe(F.sqrt(pick("q", side) / pick("n", side) - (pick("s", side) / pick("n", side)) ** 2))
    each = x.groupBy(F.col("c.combo").alias("combo"), "symbol").agg(F.round(sharpe(True), 9).alias("a"), F.round(sharpe(False), 9).alias("b")).where("a is not null and b is not null")
    w = Window.partitionBy("combo")
    each = each.withColumns({"first": F.row_number().over(w.orderBy(F.desc("a"), "symbol")), "rank": F.rank().over(w.orderBy("b")), "n": F.count("*").over(w)})
    share = F.col("rank") / (F.col("n") + 1)
    return each.where("first = 1").select("combo", F.col("symbol").alias("best"), "rank", "n", F.log(share / (1 - share)).alias("logit"))


def benjamini_hochberg(df: DataFrame, p: str, key: str) -> DataFrame:
    """Step-up adjusted p-values over all rows; nulls are left out. Ranks come from one ordered pass over a row for each test."""
    x = df.where(F.col(p).isNotNull())
    w = Window.orderBy(p, key)
    x = x.withColumns({"_r": F.row_number().over(w), "_m": F.count("*").over(Window.partitionBy())})
    down = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)  # from the end, so that it runs; a frame to the end is made anew for each row
    return x.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down))).drop("_r", "_m")


def tail_blocks(df: DataFrame, share: float, size: int) -> DataFrame:
    """Windows of `size` rows whose summed return is among the worst share, with their rank."""
    total = F.when(F.count("ret").over(_w().rowsBetween(1 - size, 0)) == size, F.sum("ret").over(_w().rowsBetween(1 - size, 0)))
    x = df.withColumn("total", F.round(total, 9)).where("total is not null")
    x = x.withColumns({"rank": F.row_number().over(Window.partitionBy("symbol").orderBy("total", "date")), "_n": F.count("*").over(Window.partitionBy("symbol"))})
    return x.where(F.col("rank") <= F.ceil(share * F.col("_n"))).select("symbol", "date", "rank", "total")


def chow(df: DataFrame, cut: str) -> DataFrame:
    """F statistic of a break of the mean at a date: residual sums of both parts against the whole."""
    x = df.where("ret is not null").withColumn("_late", F.col("date") >= cut)
    rss = lambda c: F.var_pop(c) * F.count(c)
    g = x.groupBy("symbol").agg(F.count("ret").alias("n"), rss("ret").alias("_all"), rss(F.when(F.col("_late"), F.col("ret"))).alias("_b"), rss(F.when(~F.col("_late"), F.col("ret"))).alias("_a"))
    return g.select("symbol", "n", ((F.col("_all") - F.col("_a") - F.col("_b")) / _safe((F.col("_a") + F.col("_b")) / (F.col("n") - 2))).alias("f"))


def welch(df: DataFrame, side: Column) -> DataFrame:
    """Welch's t and its degrees of freedom between the rows of both sides, by symbol."""
    r = F.col("ret")
    of = lambda f, s: f(F.when(F.col("_s") == s, r))
    g = df.where(r.isNotNull()).withColumn("_s", side).groupBy("symbol").agg(*[of(f, s).alias(f"{n}{int(s)}") for s in (True, False) for f, n in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))])
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    return g.select("symbol", "n1", "n0", ((F.col("m1") - F.col("m0")) / _safe(F.sqrt(a + b))).alias("t"), ((a + b) ** 2 / _safe(a**2 / (F.col("n1") - 1) + b**2 / (F.col("n0") - 1))).alias("freedom"))


def breaker(df: DataFrame, nav: float, day: float, week: float) -> DataFrame:
    """Trailing one-day and seven-day sums of profit over a starting value against limits, by event time."""
    w = lambda days: Window.partitionBy("symbol").orderBy(F.unix_date("date")).rangeBetween(-days, 0)
    x = df.withColumns({"day": F.sum("pnl").over(w(0)) / nav, "week": F.sum("pnl").over(w(6)) / nav})
    return x.withColumn("state", F.when(F.col("week") <= -week, "halted").when(F.col("day") <= -day, "paused").otherwise("open"))


def ks_windows(df: DataFrame, size: int, reference: Column) -> DataFrame:
    """(symbol, window, d): the largest gap between the distribution of each full window of `size` rows and that of the reference rows."""
    x = df.where("ret is not null").select("symbol", "date", F.round("ret", 9).alias("x"), reference.alias("_ref"))
    live = x.where("not _ref").withColumn("win", F.expr(f"(row_number() OVER (PARTITION BY symbol ORDER BY date) - 1) div {size}").cast("int"))
    live = live.withColumn("_n", F.count("*").over(Window.partitionBy("symbol", "win"))).where(F.col("_n") == size).select("symbol", "win", "x", F.lit(1).alias("_w"), F.lit(0).alias("_r"))
    wins = live.select("symbol", "win").distinct()
    base = x.where("_ref").select("symbol", "x").join(wins, "symbol").select("symbol", "win", "x", F.lit(0).alias("_w"), F.lit(1).alias("_r"))
    both = live.unionByName(base).groupBy("symbol", "win", "x").agg(F.sum("_w").alias("_w"), F.sum("_r").alias("_r"))
    p = Window.partitionBy("symbol", "win")
    run = p.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.sum("_w").over(run) / F.sum("_w").over(p) - F.sum("_r").over(run) / F.sum("_r").over(p))
    return both.withColumn("_g", gap).groupBy("symbol", F.col("win").alias("window")).agg(F.max("_g").alias("d"))


def slippage_fit(df: DataFrame) -> DataFrame:
    """Least squares of realised bps on the share of volume by symbol, and the advice at the median share."""
    g = df.groupBy("symbol").agg(F.count("*").alias("n"), F.covar_pop("bps", "share").alias("_c"), F.var_pop("share").alias("_v"), F.avg("bps").alias("_y"), F.avg("share").alias("_x"), F.percentile("share", F.lit(0.5)).alias("_m"))
    slope = F.col("_c") / _safe(F.col("_v"))
    base = F.col("_y") - slope * F.col("_x")
    return g.select("symbol", "n", slope.alias("slope"), base.alias("intercept"), (base + slope * F.col("_m")).alias("advice"))


def bond_table(bonds: DataFrame, years: int) -> DataFrame:
    """Price, Macaulay duration and convexity of yearly coupons (bond, coupon, term, yield) on a face of 100; a bond's flows are at most `years`."""
    t = F.explode(F.sequence(F.lit(1), F.least(F.col("term"), F.lit(years)))).alias("t")
    x = bonds.select("*", t)
    flow = 100 * F.col("coupon") + F.when(F.col("t") == F.col("term"), 100.0).otherwise(0.0)
    pv = flow / F.pow(1 + F.col("yield"), F.col("t"))
    g = x.groupBy("bond").agg(F.sum(pv).alias("price"), F.sum(pv * F.col("t")).alias("_d"), F.sum(pv * F.col("t") * (F.col("t") + 1)).alias("_c"), F.first("yield").alias("_y"))
    return g.select("bond", "price", (F.col("_d") / F.col("price")).alias("duration"), (F.col("_c") / F.col("price") / (1 + F.col("_y")) ** 2).alias("convexity"))


def risk_measures(df: DataFrame, alpha: float = 0.05, threshold: float = 0.0, col: str = "ret") -> DataFrame:
    """By symbol, over its finite returns: variance, mean squared shortfall of the rows below `threshold`, expected loss of the worst `alpha` (positive), deepest and mean fall from the running peak.

    Nulls, NaN and infinities are left out; a symbol with none left has no row, one return a variance of 0. The peak starts at the first row's value, not at 1. One sort of a symbol serves all five.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    x = df.select("symbol", "date", F.col(col).cast("double").alias("_r")).where("_r is not null and not isnan(_r) and abs(_r) < double('infinity')")
    x = x.withColumn("_v", F.product(1 + F.col("_r")).over(_run()))
    x = x.withColumns({"_peak": F.max("_v").over(_run()), "_q": F.percentile("_r", F.lit(alpha)).over(Window.partitionBy("symbol"))})
    fall = (F.col("_peak") - F.col("_v")) / _safe(F.col("_peak"))
    short = F.when(F.col("_r") < threshold, (F.col("_r") - threshold) ** 2)
    return x.groupBy("symbol").agg(F.count("*").alias("n"), F.coalesce(F.var_samp("_r"), F.lit(0.0)).alias("variance"), F.coalesce(F.avg(short), F.lit(0.0)).alias("semi_variance"), (-F.avg(F.when(F.col("_r") <= F.col("_q"), F.col("_r")))).alias("cvar"), F.max(fall).alias("max_drawdown"), F.avg(fall).alias("mean_drawdown"))


def net_of_turnover(df: DataFrame, bps: float, keys: tuple[str, ...] = ("portfolio",)) -> DataFrame:
    """By portfolio: compounded return before and after costs of weight changes, turnover and cost. `df` has (portfolio, date, symbol, w, ret); weights hold from the start of a date.

    A symbol without a row on one of the portfolio's dates has weight 0 there, so leaving and entering are trades too; the first date is bought from cash. Changes are found by the rows
    before and after of each symbol, without a grid of all dates. Null weights and returns count 0; a symbol has one row a date.
    """
    if bps < 0:
        raise ValueError("bps must not be negative")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    days = df.select(*keys, "date").distinct().withColumn("_t", F.row_number().over(Window.partitionBy(*keys).orderBy("date")))
    days = days.withColumn("_next", F.lead("date").over(Window.partitionBy(*keys).orderBy("date")))
    x = df.join(days, [*keys, "date"])
    w = Window.partitionBy(*keys, "symbol").orderBy("date")
    follows = F.lag("_t").over(w) == F.col("_t") - 1
    x = x.withColumns({"_in": F.abs(zero(F.col("w")) - F.when(follows, zero(F.lag("w").over(w))).otherwise(0.0)), "_left": F.coalesce(F.lead("_t").over(w) != F.col("_t") + 1, F.lit(True))})
    made = x.select(*keys, "date", "_t", (zero(F.col("w")) * zero(F.col("ret"))).alias("_g"), F.col("_in").alias("_x"))
    sold = x.where("_left and _next is not null").select(*keys, F.col("_next").alias("date"), (F.col("_t") + 1).alias("_t"), F.lit(0.0).alias("_g"), F.abs(zero(F.col("w"))).alias("_x"))
    daily = made.unionByName(sold).groupBy(*keys, "date").agg(F.sum("_g").alias("_g"), F.sum("_x").alias("_x"))
    total = daily.groupBy(*keys).agg(F.count("*").alias("n"), (F.product(1 + F.col("_g")) - 1).alias("gross_return"), (F.product(1 + F.col("_g") - F.col("_x") * bps / 1e4) - 1).alias("net_return"), F.sum("_x").alias("turnover"))
    return total.withColumn("cost", F.col("turnover") * bps / 1e4)


def walk_forward_metrics(df: DataFrame, windows: DataFrame, criterion: str = "calmar_positive", benchmark: float = 0.0, least_rows: int = 60, few: int = 20, periods: int = 252) -> DataFrame:
    """Metrics of net returns (symbol, date, net) inside each test window (symbol, fold, start, end), whether it passes, and how a symbol's folds rank by Calmar.

    Windows may overlap. They meet rows by the months they cover, an equality, and by date then. With fewer than `few` rows a window has the reason insufficient_data and no metrics; with
    fewer than `least_rows` it can't pass. Each window starts anew at 1. Null returns count as rows that earn nothing.
    """
    tests = {"calmar_positive": F.col("calmar") > 0, "calmar_above_benchmark": F.col("calmar") > benchmark, "sharpe_positive": F.col("sharpe") > 0}
    if criterion not in tests:
        raise ValueError(f"criterion must be one of {sorted(tests)}")
    month = lambda c: F.year(c) * 12 + F.month(c)
    spans = windows.select("symbol", "fold", "start", "end").withColumn("_m", F.explode(F.sequence(month("start"), month("end"))))
    x = df.select("symbol", "date", F.coalesce("net", F.lit(0.0)).alias("_r")).withColumn("_m", month("date")).join(spans, ["symbol", "_m"]).where("date between start and end")
    w = Window.partitionBy("symbol", "fold").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_v", F.product(1 + F.col("_r")).over(w)).withColumn("_fall", F.col("_v") / _safe(F.max("_v").over(w)) - 1)
    m = x.groupBy("symbol", "fold").agg(F.count("*").alias("n_rows"), F.max_by("_v", "date").alias("_f"), F.min("_fall").alias("mdd"), F.avg("_r").alias("_m"), F.stddev_pop("_r").alias("_s"))
    m = m.withColumn("cagr", F.pow(F.greatest("_f", F.lit(0.0)), periods / F.col("n_rows")) - 1)
    m = m.withColumns({"calmar": F.col("cagr") / _safe(-F.col("mdd")), "sharpe": F.when(F.col("_s") > 1e-12, F.col("_m") / F.col("_s") * math.sqrt(periods)).otherwise(0.0)})
    x = windows.select("symbol", "fold").join(m, ["symbol", "fold"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    enough = F.col("n_rows") >= few
    x = x.withColumns({c: F.when(enough, F.col(c)) for c in ("cagr", "mdd", "calmar", "sharpe")})
    x = x.withColumns({"passed": F.coalesce(tests[criterion] & (F.col("n_rows") >= least_rows), F.lit(False)), "reason": F.when(~enough, "insufficient_data")})
    part = Window.partitionBy("symbol")
    return x.select("symbol", "fold", "n_rows", "cagr", "mdd", "calmar", "sharpe", "passed", "reason", F.when(F.col("calmar").isNotNull(), F.rank().over(part.orderBy(F.desc_nulls_last("calmar")))).alias("place"), F.sum(F.col("passed").cast("int")).over(part).alias("n_passed"))
