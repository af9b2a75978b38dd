"""Corporate actions held against prices and positions, a ledger of total returns, and contracts spliced into one series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Kinds of actions that are known, and those that a price check applies to.
KNOWN = ("split", "reverse_split", "cash_dividend", "special_dividend", "merger", "spin_off", "symbol_change", "ticker_change", "delisting", "suspension", "adr_ratio_change")
SPLITS, DIVIDENDS = ("split", "reverse_split"), ("cash_dividend", "special_dividend")


def _safe(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def verified_actions(bars: DataFrame, actions: DataFrame, split_tolerance: float = 0.01, cash_tolerance: float = 0.05) -> DataFrame:
    """Each action (symbol, date, kind, factor, cash) with the last close before its date, the first from its date on, the error and a result.

    A split's first close should be the last over its factor, a dividend's drop its cash; errors are relative to the expected price and the last price. Results: consistent,
    inconsistent, bad_factor, bad_cash, no_price, non_positive_price, and unchecked for other kinds. Null closes are no prices; repeated actions each keep their row.
    Prices and actions meet in one sorted union, so no range of dates is joined.
    """
    both = actions.select("symbol", "date", "kind", F.col("factor").cast("double").alias("factor"), F.col("cash").cast("double").alias("cash"), F.lit(None).cast("double").alias("close"), F.lit(0).alias("_bar"))
    prices = bars.where("close is not null and not isnan(close)").select("symbol", "date", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("factor"), F.lit(None).cast("double").alias("cash"), F.col("close").cast("double"), F.lit(1).alias("_bar"))
    rows = Window.partitionBy("symbol")
    near = lambda w: F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = both.unionByName(prices).withColumn("before", near(rows.orderBy("date", "_bar"))).withColumn("after", near(rows.orderBy(F.desc("date"), F.desc("_bar")))).where("_bar = 0")
    split, cash = F.col("kind").isin(*SPLITS), F.col("kind").isin(*DIVIDENDS)
    expected = F.col("before") / _safe(F.col("factor"))
    error = F.when(split, F.abs(F.col("after") - expected) / F.greatest(expected, F.lit(1e-12))).when(cash, F.abs(F.col("before") - F.col("after") - F.col("cash")) / F.greatest("before", F.lit(1e-12)))
    good = lambda c: F.coalesce(F.col(c) > 0, F.lit(False)) & ~F.coalesce(F.isnan(c), F.lit(False))
    fault = F.when(~F.coalesce(split | cash, F.lit(False)), "unchecked").when(split & ~good("factor"), "bad_factor").when(cash & ~good("cash"), "bad_cash").when(F.col("before").isNull() | F.col("after").isNull(), "no_price").when((F.col("before") <= 0) | (F.col("after") <= 0), "non_positive_price")
    x = x.withColumns({"_fault": fault, "error": error})
    x = x.withColumns({"error": F.when(F.col("_fault").isNull(), F.col("error")), "result": F.coalesce("_fault", F.when(F.col("error") <= F.when(split, split_tolerance).otherwise(cash_tolerance), "consistent").otherwise("inconsistent"))})
    return x.select("symbol", "date", "kind", "factor", "cash", "before", "after", "error", "result")


def action_report(verified: DataFrame) -> DataFrame:
    """By kind: actions, symbols, checks made and passed, whether the kind is known, and whether all checks passed (null without a check)."""
    checked = F.col("result") != "unchecked"
    x = verified.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"), F.count_if(checked).alias("checked"), F.count_if(F.col("result") == "consistent").alias("passed"))
    return x.withColumns({"known": F.coalesce(F.col("kind").isin(*KNOWN), F.lit(False)), "plausible": F.when(F.col("checked") > 0, F.col("checked") == F.col("passed"))})


def audited_positions(held: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows (kind, factor, cash, pre_price, pre_position, post_price, post_position, cash_delta) with what was expected and whether price, position and cash agree.

    A split divides the price and multiplies the position; a dividend takes its cash from the price and pays it for each share held. Missing numbers agree with nothing; other kinds get nulls.
    """
    split, paid = F.col("kind").isin(*SPLITS), F.col("kind").isin(*DIVIDENDS)
    ratio = F.when(F.col("factor") > 0, F.col("factor"))
    x = held.withColumns(
        {
            "expected_price": F.when(split, F.col("pre_price") / ratio).when(paid, F.col("pre_price") - F.col("cash")),
            "expected_position": F.when(split, F.col("pre_position") * ratio).when(paid, F.col("pre_position")),
            "expected_cash": F.when(split, 0.0).when(paid, F.col("cash") * F.col("pre_position")),
        }
    )
    near = lambda got, want: F.when(split | paid, F.coalesce(F.abs(F.col(got) - F.col(want)) <= tolerance * F.greatest(F.lit(1.0), F.abs(want)), F.lit(False)))
    return x.withColumns({"price_ok": near("post_price", "expected_price"), "position_ok": near("post_position", "expected_position"), "cash_ok": near("cash_delta", "expected_cash")})


def ledger_faults(bars: DataFrame, distributions: DataFrame, splits: DataFrame) -> DataFrame:
    """(symbol, date, fault) of what a ledger can't be built on: repeated sessions, prices and ranges that can't be, ratios that aren't positive, events on days without a session."""
    lowest, highest = F.least("open", "high", "low", "close"), F.greatest("open", "close", "low")
    rows = bars.groupBy("symbol", "date").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("open", "high", "low", "close", "volume")], F.count_if(F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()).alias("_gaps"))
    tests = {"repeated_session": F.col("n") > 1, "missing_price": F.col("_gaps") > 0, "non_positive_price": lowest <= 0, "negative_volume": F.col("volume") < 0, "invalid_high": F.col("high") < highest, "invalid_low": F.col("low") > F.least("open", "close", "high")}
    found = rows.select("symbol", "date", F.explode(F.array_compact(F.array(*[F.when(c, name) for name, c in tests.items()]))).alias("fault"))
    sessions = rows.select("symbol", "date")
    for events, name in ((distributions, "distribution_without_session"), (splits, "split_without_session")):
        found = found.unionByName(events.select("symbol", "date").distinct().join(sessions, ["symbol", "date"], "left_anti").withColumn("fault", F.lit(name)))
    bad = splits.where("split_ratio is null or isnan(split_ratio) or split_ratio <= 0").select("symbol", "date").distinct().withColumn("fault", F.lit("invalid_split"))
    return found.unionByName(bad)


def total_return_ledger(bars: DataFrame, distributions: DataFrame, splits: DataFrame) -> DataFrame:
    """Split-adjusted opens and closes, the return from this open to the next with what goes ex on the next session, and the level it compounds to.

    Prices and distributions are divided by the product of later splits; a session's events add up (ratios too, as amounts do). The last session has no return. A symbol with any fault (see
    `ledger_faults`) is left out whole. Products run from the last session back and from the first on, in two sorted passes of a symbol.
    """
    faulty = ledger_faults(bars, distributions, splits).select("symbol").distinct()
    amounts = distributions.groupBy("symbol", "date").agg(F.sum("distribution").alias("distribution"))
    ratios = splits.groupBy("symbol", "date").agg(F.sum("split_ratio").alias("split_ratio"))
    x = bars.join(faulty, "symbol", "left_anti").join(amounts, ["symbol", "date"], "left").join(ratios, ["symbol", "date"], "left")
    w = Window.partitionBy("symbol").orderBy("date")
    back = Window.partitionBy("symbol").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_later", F.coalesce(F.product(F.coalesce("split_ratio", F.lit(1.0))).over(back), F.lit(1.0)))
    x = x.withColumns({"adj_open": F.col("open") / F.col("_later"), "adj_close": F.col("close") / F.col("_later"), "_paid": F.coalesce(F.col("distribution") / F.col("_later"), F.lit(0.0))})
    x = x.withColumn("long_return", (F.lead("adj_open").over(w) + F.lead("_paid").over(w) - F.col("adj_open")) / F.col("adj_open"))
    x = x.withColumn("tr_open", F.coalesce(F.product(1 + F.coalesce("long_return", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
    return x.select("symbol", "date", F.coalesce("distribution", F.lit(0.0)).alias("distribution"), F.coalesce("split_ratio", F.lit(1.0)).alias("split_ratio"), "adj_open", "adj_close", "long_return", (-F.col("long_return")).alias("short_return"), "tr_open", (F.col("tr_open") * F.col("adj_close") / F.col("adj_open")).alias("tr_close"))


def business_days_before(day: Column, n: int) -> Column:
    """The date n weekdays before; a weekend counts as the Monday after it."""
    weekday = F.weekday(day)
    start = F.date_add(day, F.when(weekday >= 5, 7 - weekday).otherwise(0))
    k = F.when(weekday >= 5, 0).otherwise(weekday)
    return F.date_sub(start, (n + 2 * F.floor((n + 4 - k) / 5)).cast("int"))


def continuous(chain: DataFrame, days: int = 5, method: str = "ratio") -> DataFrame:
    """One series a symbol from contracts (symbol, date, contract, close, expiry; one row a contract and date): the front one until `days` weekdays before it expires.

    The newest contract keeps its prices; earlier ones are scaled ("ratio"), shifted ("difference") or left ("none") by every gap after them. A gap is taken on the last day of a front contract
    on which the next one has a price too (the roll itself, if both trade on it); without such a day, or with a price of zero in a ratio, it is none. Contracts that expire together follow by name.
    """
    if method not in ("ratio", "difference", "none"):
        raise ValueError("method must be ratio, difference or none")
    by_expiry = Window.partitionBy("symbol").orderBy("expiry", "contract")
    c = chain.groupBy("symbol", "contract").agg(F.min("expiry").alias("expiry")).withColumn("roll", business_days_before(F.col("expiry"), days))
    c = c.withColumns({"_k": F.row_number().over(by_expiry), "_start": F.lag("roll").over(by_expiry)})
    x = chain.select("symbol", "date", "contract", F.col("close").cast("double").alias("close")).join(c, ["symbol", "contract"])
    together = Window.partitionBy("symbol", "date").orderBy("_k")
    x = x.withColumn("_next", F.when(F.lead("_k").over(together) == F.col("_k") + 1, F.lead("close").over(together)))
    x = x.where("(_start is null or date > _start) and date <= roll")
    gaps = x.where("close is not null and _next is not null").groupBy("symbol", "contract").agg(F.max_by(F.struct("close", "_next"), "date").alias("g"))
    later = Window.partitionBy("symbol").orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when((F.col("g.close") != 0) & (F.col("g._next") != 0), F.col("g._next") / _safe(F.col("g.close")))
    c = c.join(gaps, ["symbol", "contract"], "left").select("symbol", "contract", F.product(F.coalesce(step, F.lit(1.0))).over(later).alias("factor"), F.sum(F.coalesce(F.col("g._next") - F.col("g.close"), F.lit(0.0))).over(later).alias("offset"))
    moved = {"ratio": F.col("close") * F.col("factor"), "difference": F.col("close") + F.col("offset"), "none": F.col("close")}[method]
    return x.join(c, ["symbol", "contract"]).select("symbol", "date", "contract", "close", moved.alias("continuous"))
