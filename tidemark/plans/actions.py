"""Queries of corporate actions, total returns and continuous contracts, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import actions
from tidemark.plans.market import _r
from tidemark.sources.derived import BARS_SQL, bars


def _numbered(s, d):
    return bars(s, d).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("date")))


def _actions(s, d):
    """An action for every 20th bar, on its day or the next, in turn of seven kinds; some without what they need."""
    k = F.col("k")
    kind = F.element_at(F.array(*map(F.lit, ("split", "cash_dividend", "reverse_split", "special_dividend", "ticker_change", "split", "swap"))), (F.floor(k / 20) % 7 + 1).cast("int"))
    x = _numbered(s, d).where("k % 20 = 0").select("symbol", F.date_add("date", (F.col("symbol") % 2).cast("int")).alias("date"), "k", kind.alias("kind"))
    split = F.col("kind").isin("split", "reverse_split")
    return x.withColumns({"factor": F.when(split, F.when(k % 100 == 0, 0.0).when(k % 3 == 0, 2.0).otherwise(1.0)), "cash": F.when(F.col("kind").contains("dividend") & (k % 80 != 0), 1.0 + k % 3)})


def _verified(s, d):
    return actions.verified_actions(bars(s, d), _actions(s, d))


def _positions(s, d):
    x = _verified(s, d).where("before is not null and after is not null")
    held = 100.0 + F.col("symbol") % 5
    x = x.withColumnsRenamed({"before": "pre_price", "after": "post_price"}).withColumn("pre_position", held)
    odd = F.day("date") % 3
    x = x.withColumns({"post_position": F.when(odd == 0, held).otherwise(held * F.coalesce("factor", F.lit(1.0))), "cash_delta": F.when(odd == 1, 0.0).otherwise(F.coalesce("cash", F.lit(0.0)) * held)})
    return actions.audited_positions(x)


def _events(s, d):
    """Distributions and splits of the bars; symbols that end in 9 pay on a day without a session, those in 8 split by less than nothing."""
    x, k, last = _numbered(s, d), F.col("k"), F.col("symbol") % 10
    paid = x.where("k % 40 = 0").select("symbol", F.when((last == 9) & (k == 80), F.lit("1980-01-01").cast("date")).otherwise(F.col("date")).alias("date"), (0.5 + 0.25 * (k % 3)).alias("distribution"))
    cut = x.where("k % 60 = 0").select("symbol", "date", F.when((last == 8) & (k == 60), -1.0).when(F.col("symbol") % 2 == 1, 3.0).otherwise(0.3).alias("split_ratio"))
    return bars(s, d), paid, cut


def _chain(s, d):
    """Contracts that expire at the ends of quarters: a quarter's bars trade in its own contract and, a little above, in the next one."""
    x = bars(s, d)
    k = (F.year("date") * 4 + F.quarter("date")).cast("long")
    end = lambda ahead: F.last_day(F.add_months(F.trunc("date", "quarter"), 2 + 3 * ahead))
    both = F.array(*[F.struct((k + ahead).alias("contract"), (F.col("close") * (1 + 0.01 * ahead) + ahead * (k % 3)).alias("close"), end(ahead).alias("expiry")) for ahead in (0, 1)])
    return x.select("symbol", "date", F.explode(both).alias("c")).select("symbol", "date", "c.*")


def _continuous(s, d):
    one = lambda method: actions.continuous(_chain(s, d), 5, method).withColumn("method", F.lit(method))
    return one("ratio").unionByName(one("difference"))


#: Levels and adjusted prices are short decimals that tie at six places.
_LEDGER_COLUMNS = ("distribution", "split_ratio", "adj_open", "adj_close", "long_return", "short_return", "tr_open", "tr_close")

QUERIES = {
    "verified_actions": lambda s, d: _r(_verified(s, d), "symbol", "date", "kind", "result", factor="factor", cash="cash", before="before", after="after", error="error"),
    "action_report": lambda s, d: actions.action_report(_verified(s, d)),
    "audited_positions": lambda s, d: _r(_positions(s, d), "symbol", "date", "kind", "price_ok", "position_ok", "cash_ok", expected_price="expected_price", expected_position="expected_position", expected_cash="expected_cash"),
    "ledger_faults": lambda s, d: actions.ledger_faults(*_events(s, d)),
    "total_return_ledger": lambda s, d: actions.total_return_ledger(*_events(s, d)).select("symbol", "date", *[F.round(c, 9).alias(c) for c in _LEDGER_COLUMNS]),
    "continuous_contracts": lambda s, d: _r(_continuous(s, d), "symbol", "date", "contract", "method", close="close", continuous="continuous"),
}

_NUMBERED = f"{BARS_SQL}, nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM bars)"
_VERIFIED = f"""WITH {_NUMBERED}, a0 AS (SELECT symbol, CAST(date + CAST(symbol % 2 AS INT) AS DATE) AS date, k, ['split', 'cash_dividend', 'reverse_split', 'special_dividend', 'ticker_change', 'split', 'swap'][CAST(k // 20 % 7 + 1 AS INT)] AS kind FROM nb WHERE k % 20 = 0),
a1 AS (SELECT symbol, date, kind, kind IN ('split', 'reverse_split') AS cut, kind LIKE '%dividend' AS paid, CAST(CASE WHEN kind IN ('split', 'reverse_split') THEN CASE WHEN k % 100 = 0 THEN 0 WHEN k % 3 = 0 THEN 2 ELSE 1 END END AS DOUBLE) AS factor, CAST(CASE WHEN kind LIKE '%dividend' AND k % 80 <> 0 THEN 1 + k % 3 END AS DOUBLE) AS cash FROM a0),
a2 AS (SELECT a1.*, b.close AS before FROM a1 ASOF LEFT JOIN bars b ON a1.symbol = b.symbol AND a1.date > b.date),
a3 AS (SELECT a2.*, b.close AS after FROM a2 ASOF LEFT JOIN bars b ON a2.symbol = b.symbol AND a2.date <= b.date),
a4 AS (SELECT *, CASE WHEN NOT cut AND NOT paid THEN 'unchecked' WHEN cut AND NOT coalesce(factor > 0, false) THEN 'bad_factor' WHEN paid AND NOT coalesce(cash > 0, false) THEN 'bad_cash' WHEN before IS NULL OR after IS NULL THEN 'no_price' WHEN before <= 0 OR after <= 0 THEN 'non_positive_price' END AS fault FROM a3),
a5 AS (SELECT *, CASE WHEN fault IS NULL THEN CASE WHEN cut THEN abs(after - before / factor) / (before / factor) ELSE abs(before - after - cash) / before END END AS error FROM a4),
va AS (SELECT *, coalesce(fault, CASE WHEN error <= CASE WHEN cut THEN 0.01 ELSE 0.05 END THEN 'consistent' ELSE 'inconsistent' END) AS result FROM a5)"""
_LEDGER = f"""WITH {_NUMBERED}, pd AS (SELECT symbol, CASE WHEN symbol % 10 = 9 AND k = 80 THEN DATE '1980-01-01' ELSE date END AS date, 0.5 + 0.25 * (k % 3) AS distribution FROM nb WHERE k % 40 = 0),
cu AS (SELECT symbol, date, CASE WHEN symbol % 10 = 8 AND k = 60 THEN -1 WHEN symbol % 2 = 1 THEN 3 ELSE 0.3 END AS split_ratio FROM nb WHERE k % 60 = 0),
fl AS (SELECT symbol, date, 'repeated_session' AS fault FROM bars GROUP BY 1, 2 HAVING count(*) > 1
 UNION ALL SELECT symbol, date, 'non_positive_price' FROM bars WHERE least(open, high, low, close) <= 0 UNION ALL SELECT symbol, date, 'negative_volume' FROM bars WHERE volume < 0
 UNION ALL SELECT symbol, date, 'invalid_high' FROM bars WHERE high < greatest(open, close, low) UNION ALL SELECT symbol, date, 'invalid_low' FROM bars WHERE low > least(open, close, high)
 UNION ALL SELECT DISTINCT symbol, date, 'distribution_without_session' FROM pd ANTI JOIN bars USING (symbol, date) UNION ALL SELECT DISTINCT symbol, date, 'split_without_session' FROM cu ANTI JOIN bars USING (symbol, date)
 UNION ALL SELECT DISTINCT symbol, date, 'invalid_split' FROM cu WHERE split_ratio <= 0)"""
_CHAIN = f"""WITH {BARS_SQL}, ch AS (SELECT symbol, date, q + ahead AS contract, close * (1 + 0.01 * ahead) + ahead * (q % 3) AS close, CAST(last_day(date_trunc('quarter', date) + to_months(CAST(2 + 3 * ahead AS INT))) AS DATE) AS expiry FROM (SELECT *, year(date) * 4 + quarter(date) AS q FROM bars), (VALUES (0), (1)) v(ahead)),
co AS (SELECT symbol, contract, min(expiry) AS expiry FROM ch GROUP BY 1, 2),
rl AS (SELECT *, CAST(list_filter(list_transform(range(1, 20), lambda i: expiry - CAST(i AS INT)), lambda x: isodow(x) <= 5)[5] AS DATE) AS roll FROM co),
sp AS (SELECT *, lag(roll) OVER w AS start, lead(contract) OVER w AS follows FROM rl WINDOW w AS (PARTITION BY symbol ORDER BY expiry)),
fr AS (SELECT ch.symbol, ch.date, ch.contract, ch.close, n.close AS ahead FROM ch JOIN sp ON ch.symbol = sp.symbol AND ch.contract = sp.contract AND (start IS NULL OR ch.date > start) AND ch.date <= roll LEFT JOIN ch n ON n.symbol = ch.symbol AND n.date = ch.date AND n.contract = follows),
gp AS (SELECT symbol, contract, arg_max(close, date) AS old, arg_max(ahead, date) AS new FROM fr WHERE ahead IS NOT NULL GROUP BY 1, 2),
ad AS (SELECT symbol, contract, product(coalesce(new / old, 1)) OVER w AS factor, sum(coalesce(new - old, 0)) OVER w AS shift FROM sp LEFT JOIN gp USING (symbol, contract) WINDOW w AS (PARTITION BY symbol ORDER BY expiry DESC))"""

ORACLE = {
    "verified_actions": f"{_VERIFIED} SELECT symbol, date, kind, result, factor, cash, round(before, 6) AS before, round(after, 6) AS after, round(error, 6) AS error FROM va",
    "action_report": f"{_VERIFIED} SELECT kind, count(*) AS n, count(DISTINCT symbol) AS symbols, count(*) FILTER (result <> 'unchecked') AS checked, count(*) FILTER (result = 'consistent') AS passed, kind <> 'swap' AS known, CASE WHEN count(*) FILTER (result <> 'unchecked') > 0 THEN bool_and(result = 'consistent') END AS plausible FROM va GROUP BY kind",
    "audited_positions": f"""{_VERIFIED}, p AS (SELECT *, 100.0 + symbol % 5 AS held, day(date) % 3 AS odd FROM va WHERE before IS NOT NULL AND after IS NOT NULL),
e AS (SELECT *, CASE WHEN cut THEN before / nullif(factor, 0) WHEN paid THEN before - cash END AS ep, CASE WHEN cut THEN CASE WHEN factor > 0 THEN held * factor END WHEN paid THEN held END AS ex, CASE WHEN cut THEN 0 WHEN paid THEN cash * held END AS ec, CASE WHEN odd = 0 THEN held ELSE held * coalesce(factor, 1) END AS gx, CASE WHEN odd = 1 THEN 0 ELSE coalesce(cash, 0) * held END AS gc FROM p)
SELECT symbol, date, kind, CASE WHEN cut OR paid THEN coalesce(abs(after - ep) <= 1e-6 * greatest(1, abs(ep)), false) END AS price_ok, CASE WHEN cut OR paid THEN coalesce(abs(gx - ex) <= 1e-6 * greatest(1, abs(ex)), false) END AS position_ok, CASE WHEN cut OR paid THEN coalesce(abs(gc - ec) <= 1e-6 * greatest(1, abs(ec)), false) END AS cash_ok, round(ep, 6) AS expected_price, round(CAST(ex AS DOUBLE), 6) AS expected_position, round(CAST(ec AS DOUBLE), 6) AS expected_cash FROM e""",
    "ledger_faults": f"{_LEDGER} SELECT symbol, date, fault FROM fl",
    "total_return_ledger": f"""{_LEDGER}, j AS (SELECT b.*, coalesce(CAST(distribution AS DOUBLE), 0) AS distribution, coalesce(CAST(split_ratio AS DOUBLE), 1) AS split_ratio FROM bars b LEFT JOIN pd USING (symbol, date) LEFT JOIN cu USING (symbol, date) WHERE symbol NOT IN (SELECT symbol FROM fl)),
l AS (SELECT *, coalesce(product(split_ratio) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS later FROM j),
r AS (SELECT *, (lead(open / later) OVER w + lead(distribution / later) OVER w - open / later) / (open / later) AS lr FROM l WINDOW w AS (PARTITION BY symbol ORDER BY date)),
t AS (SELECT *, coalesce(product(1 + coalesce(lr, 0)) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS tr FROM r)
SELECT symbol, date, round(distribution, 9) AS distribution, round(split_ratio, 9) AS split_ratio, round(open / later, 9) AS adj_open, round(close / later, 9) AS adj_close, round(lr, 9) AS long_return, round(-lr, 9) AS short_return, round(tr, 9) AS tr_open, round(tr * close / open, 9) AS tr_close FROM t""",
    "continuous_contracts": f"{_CHAIN} SELECT symbol, date, contract, method, round(close, 6) AS close, round(CASE method WHEN 'ratio' THEN close * factor ELSE close + shift END, 6) AS continuous FROM fr JOIN ad USING (symbol, contract), (VALUES ('ratio'), ('difference')) m(method)",
}
