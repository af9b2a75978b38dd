"""Indicator, tape, factor and episode queries and the SQL that checks them."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidemark.operators import recurrence
from tidemark.operators import episodes as e
from tidemark.operators import factors as fa
from tidemark.operators import features as f
from tidemark.operators import indicators as i
from tidemark.operators import panel as p
from tidemark.operators import sequential as q
from tidemark.operators import trades as t
from tidemark.operators.tables import _ohlc
from tidemark.plans.market import _RETS, _quotes, _r, _rets
from tidemark.sources.derived import BARS_SQL, TICKS_SQL, bars, read, ticks
from tidemark.streaming.bars import replayed, stream_bars

DARK = [3, 4]


def _clean(s, d):
    """Returns to nine places, so that quantiles and signs agree in every engine."""
    return _rets(s, d).withColumn("ret", F.round("ret", 9))


def _factor(s, d):
    x = i.forward_return(f.momentum(bars(s, d), 20), 1)
    return x.select("symbol", "date", F.round("mom", 9).alias("factor"), F.round("forward", 9).alias("forward"))


def _actions(s, d):
    x = bars(s, d).withColumn("k", F.row_number().over(f.by("symbol", "date"))).where("k % 50 = 0")
    m = F.col("symbol") % 3
    return x.select("symbol", "date", F.when(m == 0, "split").when(m == 1, "dividend").otherwise("spinoff").alias("kind"), F.when(m == 0, 2.0).when(m == 1, 1.0).otherwise(0.9).alias("factor"))


def _weights(s, d):
    return f.cross_signal(_rets(s, d), 5, 20)


def _trades(s, d):
    return ticks(s, d).where("kind != 'view'").select("symbol", "ts", "seq", "venue", "price", "size")


def _stream(s, d):
    schema = read(s, d, "events").schema
    raw = s.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a file or a folder of part files
    k = F.get_json_object("props", "$.k").cast("int")
    x = raw.select((F.col("user_id") % 20).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (100 + F.col("value").cast("double")).alias("price"), (1 + k).cast("long").alias("size"))
    return _r(replayed(stream_bars(x, "1 hour", "1 hour")), "symbol", F.col("start").cast("timestamp_ntz").alias("start"), "volume", "n", open="open", high="high", low="low", close="close")


def _masked(s, d):
    c = read(s, d, "customer")
    return c.select("c_custkey", F.when(F.col("c_name").isNotNull(), F.concat(F.lit("PII_"), F.substring(F.sha2(F.concat(F.lit("key:"), F.col("c_name")), 256), 1, 16))).alias("c_name"))


def _newest(s, d):
    o = read(s, d, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", F.col("o_totalprice").cast("double").alias("price")), F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return o.select("o_custkey", "m.o_orderkey", "m.price").orderBy(F.desc("price"), "o_custkey").limit(20)


def _delisted(s, d):
    last = bars(s, d).groupBy("symbol").agg(F.max("date").alias("end")).where("symbol % 4 != 0")
    newest = last.agg(F.max("end").alias("newest"))
    return last.join(F.broadcast(newest), F.lit(True)).where(F.col("end").between(F.date_sub("newest", 5), F.date_sub("newest", 1))).drop("newest")  # one row


def _rollup(s, d):
    return bars(s, d).withColumn("year", F.year("date")).rollup("symbol", "year").agg(F.sum("volume").alias("volume"), F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


QUERIES = {
    "weighted_average": lambda s, d: _r(i.weighted_average(bars(s, d), 5), "symbol", "date", wma="wma"),
    "simple_rsi": lambda s, d: _r(i.simple_rsi(bars(s, d), 14), "symbol", "date", rsi="rsi"),
    "price_channels": lambda s, d: _r(i.channels(bars(s, d), 14), "symbol", "date", upper="upper", lower="lower", stochastic="stochastic", williams="williams"),
    "rolling_zscore": lambda s, d: _r(i.rolling_zscore(bars(s, d), 20), "symbol", "date", z="z"),
    "rolling_trend": lambda s, d: _r(i.rolling_trend(bars(s, d), 20), "symbol", "date", slope="slope", r2="r2", efficiency="efficiency"),
    "range_volatility": lambda s, d: _r(i.range_volatility(bars(s, d), 20), "symbol", "date", parkinson="parkinson", garman_klass="garman_klass", rogers_satchell="rogers_satchell"),
    "flow_imbalance": lambda s, d: _r(i.flow_imbalance(bars(s, d), 20), "symbol", "date", "signed_volume", imbalance="imbalance"),
    "price_impact": lambda s, d: _r(i.price_impact(bars(s, d), 20), "symbol", "date", kyle="kyle", amihud="amihud"),
    "spread_estimates": lambda s, d: _r(i.spread_estimates(bars(s, d), 20), "symbol", "date", high_low="high_low", serial="serial"),
    "forward_returns": lambda s, d: _r(i.forward_return(bars(s, d), 5), "symbol", "date", forward="forward"),
    "confirmed_state": lambda s, d: i.confirmed(_clean(s, d), 3).select("symbol", "date", "state"),
    "candle_flags": lambda s, d: i.candles(bars(s, d)).select("symbol", "date", "gap_up", "gap_down", "inside", "engulfing"),
    "calendar_flags": lambda s, d: i.calendar(bars(s, d)).select("symbol", "date", "weekday", "left", "turn"),
    "macd": lambda s, d: _r(recurrence.macd(bars(s, d).select("symbol", "date", "close"), 12, 26, 9), "symbol", "date", fast="fast", slow="slow", signal="signal", macd="macd"),
    "volume_bars": lambda s, d: _r(_ohlc(q.threshold_bars(ticks(s, d).select("symbol", "ts", "seq", "price", "size"), 500, "size"), "symbol", "bar"), "symbol", "bar", "volume", "n", open="open", high="high", low="low", close="close"),
    "dollar_bars": lambda s, d: _r(_ohlc(q.threshold_bars(ticks(s, d).select("symbol", "ts", "seq", "price", "size", (F.col("price") * F.col("size")).alias("money")), 100000, "money"), "symbol", "bar"), "symbol", "bar", "volume", "n", open="open", high="high", low="low", close="close"),
    "session_volume": lambda s, d: _r(t.session_volume(ticks(s, d)), "symbol", "session", "volume", "n", share="share"),
    "session_bars": lambda s, d: _r(t.session_bars(ticks(s, d), "1 hour"), "symbol", "session", F.col("start").cast("timestamp_ntz").alias("start"), "volume", open="open", high="high", low="low", close="close", vwap="vwap"),
    "block_trades": lambda s, d: _r(t.blocks(ticks(s, d), 95, 15000.0), "symbol", "seq", "size", "reason", share="share"),
    "dark_share": lambda s, d: _r(t.dark_share(ticks(s, d), DARK), "symbol", "dark", "volume", share="share"),
    "signed_flow": lambda s, d: t.flow(_trades(s, d), _quotes(s, d)).select("symbol", "bought", "sold", "net", F.round("net_money", 3).alias("net_money")),
    "venue_quality": lambda s, d: _r(t.venue_quality(_trades(s, d), _quotes(s, d), DARK), "kind", "n", "volume", mean_size="mean_size", vwap="vwap", spread_bps="spread_bps"),
    "back_adjusted": lambda s, d: _r(t.back_adjusted(bars(s, d), _actions(s, d)), "symbol", "date", product="product", adj_close="adj_close"),
    "information_coefficient": lambda s, d: _r(fa.information_coefficient(_factor(s, d)), "date", "n", ic="ic", rank_ic="rank_ic"),
    "factor_returns": lambda s, d: _r(fa.factor_returns(_factor(s, d)), "date", "n", ret="ret"),
    "quantile_returns": lambda s, d: _r(fa.quantile_returns(_factor(s, d), 5), "bin", "n", forward="forward"),
    "factor_turnover": lambda s, d: _r(fa.factor_turnover(_factor(s, d)), "symbol", "n", turnover="turnover"),
    "drawdown_episodes": lambda s, d: _r(e.drawdown_episodes(_clean(s, d)), "symbol", "start", "end", "n", "open", depth="depth"),
    "conditional_drawdown": lambda s, d: _r(e.conditional_drawdown(p.drawdown(_clean(s, d)).withColumn("dd", F.round("dd", 9)), 0.05), "symbol", "n", cdar="cdar"),
    "longest_streaks": lambda s, d: e.longest_streaks(_clean(s, d)),
    "return_shape": lambda s, d: _r(e.shape(_clean(s, d)), "symbol", skew="skew", kurtosis="kurtosis", tail_ratio="tail_ratio", best="best", worst="worst"),
    "rolling_risk": lambda s, d: _r(e.rolling_risk(_rets(s, d), 20), "symbol", "date", vol="vol", sharpe="sharpe"),
    "round_trips": lambda s, d: _r(e.round_trips(_weights(s, d)), "symbol", "side", "opened", "closed", "bars", pnl="pnl", mfe="mfe", mae="mae"),
    "trade_stats": lambda s, d: _r(e.trade_stats(e.round_trips(_weights(s, d))), "symbol", "bucket", "n", win_rate="win_rate", expectancy="expectancy", holding="holding"),
    "inverse_volatility": lambda s, d: _r(e.inverse_volatility(_rets(s, d), 60), "symbol", "date", weight="weight"),
    "rebalance_dates": lambda s, d: e.rebalance_dates(bars(s, d)),
    "walk_forward": lambda s, d: e.walk_forward(bars(s, d), 5, 0.5).select("symbol", "fold", "start", "end", "n_test", F.col("n_train").cast("long").alias("n_train")),
    "masked_names": _masked,
    "newest_version": _newest,
    "delisted_in_window": _delisted,
    "volume_rollup": _rollup,
    "streamed_bars": _stream,
}

_V = "PARTITION BY symbol ORDER BY date"
_N = lambda n: f"({_V} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_CLEAN = f"{_RETS}, x AS (SELECT * REPLACE (round(ret, 9) AS ret) FROM rets)"
_SIGNED = f"{BARS_SQL}, d AS (SELECT *, lag(close) OVER ({_V}) AS past FROM bars), k AS (SELECT *, close - past AS dp, coalesce(last_value(CASE WHEN close <> past THEN sign(close - past) END IGNORE NULLS) OVER ({_V} ROWS UNBOUNDED PRECEDING), 0) * volume AS sv FROM d)"
_FACTOR = f"{BARS_SQL}, y AS (SELECT symbol, date, round(close / lag(close, 20) OVER ({_V}) - 1, 9) AS factor, round(lead(close) OVER ({_V}) / close - 1, 9) AS forward FROM bars), z AS (SELECT * FROM y WHERE factor IS NOT NULL AND forward IS NOT NULL)"
_SESSION = "CASE WHEN hour(ts) < 14 THEN 'premarket' WHEN hour(ts) >= 20 THEN 'afterhours' ELSE 'regular' END"
_OHLC4 = "round(arg_min(price, seq), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, seq), 6) AS close, CAST(sum(size) AS BIGINT) AS volume"
_ASOF = f"{TICKS_SQL}, q AS (SELECT symbol, ts, ((price - 0.01 * (1 + size % 5)) + (price + 0.01 * (1 + size % 5))) / 2 AS mid FROM ticks WHERE kind = 'view'), tr AS (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq) AS past FROM ticks WHERE kind <> 'view'), m AS (SELECT tr.*, mid FROM tr ASOF LEFT JOIN q ON tr.symbol = q.symbol AND tr.ts >= q.ts)"
_TRIPS = f"""{_RETS}, sg AS (SELECT *, CAST(CASE WHEN count(close) OVER {_N(20)} = 20 THEN sign(avg(close) OVER {_N(5)} - avg(close) OVER {_N(20)}) ELSE 0 END AS INT) AS side FROM rets),
n AS (SELECT *, CASE WHEN side IS DISTINCT FROM lag(side) OVER ({_V}) THEN 1 ELSE 0 END AS st FROM sg), g AS (SELECT *, sum(st) OVER ({_V}) AS run FROM n),
tp AS (SELECT symbol, run, side, min(date) AS opened, max(date) AS closed, arg_min(close, date) AS entry, arg_max(close, date) AS ex, max(close) AS hi, min(close) AS lo, count(*) AS bars FROM g WHERE side <> 0 GROUP BY symbol, run, side),
trips AS (SELECT *, side * (ex / entry - 1) AS pnl, greatest(side * (hi / entry - 1), side * (lo / entry - 1)) AS mfe, least(side * (hi / entry - 1), side * (lo / entry - 1)) AS mae FROM tp)"""
_DD = f"{_CLEAN}, eq AS (SELECT symbol, date, exp(sum(ln(1 + coalesce(ret, 0))) OVER ({_V} ROWS UNBOUNDED PRECEDING)) AS equity FROM x), dd AS (SELECT *, equity / max(equity) OVER ({_V} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM eq)"
_BARS_OF = lambda measure, limit: f"""WITH RECURSIVE {TICKS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS i, CAST({measure} AS DOUBLE) AS m FROM ticks),
w AS (SELECT symbol, i, m AS total, CAST(0 AS BIGINT) AS bar FROM k WHERE i = 1 UNION ALL SELECT k.symbol, k.i, CASE WHEN w.total >= {limit} THEN k.m ELSE w.total + k.m END, CASE WHEN w.total >= {limit} THEN w.bar + 1 ELSE w.bar END FROM w JOIN k ON k.symbol = w.symbol AND k.i = w.i + 1)
SELECT k.symbol, bar, count(*) AS n, {_OHLC4} FROM k JOIN w ON k.symbol = w.symbol AND k.i = w.i GROUP BY k.symbol, bar"""  # noqa: E731

ORACLE = {
    "weighted_average": f"WITH {BARS_SQL} SELECT symbol, date, round((5 * close + 4 * lag(close) OVER v + 3 * lag(close, 2) OVER v + 2 * lag(close, 3) OVER v + lag(close, 4) OVER v) / 15, 6) AS wma FROM bars WINDOW v AS ({_V})",
    "simple_rsi": f"WITH {BARS_SQL}, d AS (SELECT symbol, date, close - lag(close) OVER ({_V}) AS d FROM bars), g AS (SELECT symbol, date, count(d) OVER v AS n, avg(greatest(d, 0)) OVER v AS g, avg(greatest(-d, 0)) OVER v AS l FROM d WINDOW v AS {_N(14)}) SELECT symbol, date, round(CASE WHEN n < 14 THEN NULL WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 ELSE 50 END, 6) AS rsi FROM g",
    "price_channels": f"WITH {BARS_SQL}, c AS (SELECT *, CASE WHEN count(*) OVER v = 14 THEN max(high) OVER v END AS upper, CASE WHEN count(*) OVER v = 14 THEN min(low) OVER v END AS lower FROM bars WINDOW v AS {_N(14)}) SELECT symbol, date, round(upper, 6) AS upper, round(lower, 6) AS lower, round(100 * (close - lower) / nullif(upper - lower, 0), 6) AS stochastic, round(-100 * (upper - close) / nullif(upper - lower, 0), 6) AS williams FROM c",
    "rolling_zscore": f"WITH {BARS_SQL} SELECT symbol, date, CASE WHEN count(*) OVER v = 20 THEN round((close - avg(close) OVER v) / nullif(stddev_samp(close) OVER v, 0), 6) END AS z FROM bars WINDOW v AS {_N(20)}",
    "rolling_trend": f"WITH {BARS_SQL}, y AS (SELECT symbol, date, CAST(row_number() OVER ({_V}) AS DOUBLE) AS x, ln(close) AS y FROM bars), s AS (SELECT *, abs(y - lag(y) OVER ({_V})) AS step, abs(y - lag(y, 19) OVER ({_V})) AS net FROM y) SELECT symbol, date, CASE WHEN count(*) OVER v = 20 THEN round(regr_slope(y, x) OVER v, 6) END AS slope, CASE WHEN count(*) OVER v = 20 THEN round(pow(covar_pop(y, x) OVER v / nullif(stddev_pop(y) OVER v * stddev_pop(x) OVER v, 0), 2), 6) END AS r2, round(net / nullif(sum(step) OVER {_N(19)}, 0), 6) AS efficiency FROM s WINDOW v AS {_N(20)}",
    "range_volatility": f"WITH {BARS_SQL}, r AS (SELECT symbol, date, pow(ln(high / low), 2) / (4 * ln(2)) AS p, 0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) AS g, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS r FROM bars) SELECT symbol, date, "
    + ", ".join(f"CASE WHEN count(*) OVER v = 20 THEN round(sqrt(greatest(avg({c}) OVER v, 0) * 252), 6) END AS {name}" for c, name in (("p", "parkinson"), ("g", "garman_klass"), ("r", "rogers_satchell")))
    + f" FROM r WINDOW v AS {_N(20)}",
    "flow_imbalance": f"WITH {_SIGNED} SELECT symbol, date, sv AS signed_volume, CASE WHEN count(*) OVER v = 20 THEN round(sum(sv) OVER v / nullif(sum(volume) OVER v, 0), 6) END AS imbalance FROM k WINDOW v AS {_N(20)}",
    "price_impact": f"WITH {_SIGNED}, a AS (SELECT *, abs(dp / past) / (close * volume) AS a FROM k) SELECT symbol, date, CASE WHEN count(dp) OVER v = 20 THEN round(covar_pop(dp, sv) OVER v / nullif(var_pop(sv) OVER v, 0), 6) END AS kyle, CASE WHEN count(a) OVER v = 20 THEN round(1e6 * avg(a) OVER v, 6) END AS amihud FROM a WINDOW v AS {_N(20)}",
    "spread_estimates": f"""WITH {BARS_SQL}, b AS (SELECT *, lag(high) OVER ({_V}) AS h1, lag(low) OVER ({_V}) AS l1, close - lag(close) OVER ({_V}) AS d FROM bars),
c AS (SELECT *, lag(d) OVER ({_V}) AS e, pow(ln(high / low), 2) + pow(ln(h1 / l1), 2) AS be, CASE WHEN h1 IS NOT NULL THEN pow(ln(greatest(high, h1) / least(low, l1)), 2) END AS ga FROM b),
a AS (SELECT *, (sqrt(2 * be) - sqrt(be)) / (3 - 2 * sqrt(2)) - sqrt(ga / (3 - 2 * sqrt(2))) AS al FROM c), s AS (SELECT *, CASE WHEN al IS NOT NULL THEN greatest(2 * (exp(al) - 1) / (1 + exp(al)), 0) END AS s FROM a)
SELECT symbol, date, CASE WHEN count(s) OVER v = 20 THEN round(avg(s) OVER v, 6) END AS high_low, CASE WHEN count(e) OVER v = 20 THEN round(2 * sqrt(greatest(-covar_samp(d, e) OVER v, 0)), 6) END AS serial FROM s WINDOW v AS {_N(20)}""",
    "forward_returns": f"WITH {BARS_SQL} SELECT symbol, date, round(lead(close, 5) OVER ({_V}) / close - 1, 6) AS forward FROM bars",
    "confirmed_state": f"WITH {_CLEAN}, s AS (SELECT symbol, date, CAST(coalesce(sign(ret), 0) AS INT) AS s FROM x), k AS (SELECT *, CASE WHEN count(*) OVER v = 3 AND min(s) OVER v = max(s) OVER v THEN s END AS k FROM s WINDOW v AS {_N(3)}) SELECT symbol, date, coalesce(last_value(k IGNORE NULLS) OVER ({_V} ROWS UNBOUNDED PRECEDING), 0) AS state FROM k",
    "candle_flags": f"WITH {BARS_SQL}, l AS (SELECT *, lag(open) OVER v AS o1, lag(high) OVER v AS h1, lag(low) OVER v AS l1, lag(close) OVER v AS c1 FROM bars WINDOW v AS ({_V})) SELECT symbol, date, CAST(coalesce(low > h1, false) AS INT) AS gap_up, CAST(coalesce(high < l1, false) AS INT) AS gap_down, CAST(coalesce(high < h1 AND low > l1, false) AS INT) AS inside, CAST(coalesce(greatest(open, close) > greatest(o1, c1) AND least(open, close) < least(o1, c1) AND sign(close - open) = -sign(c1 - o1), false) AS INT) AS engulfing FROM l",
    "calendar_flags": f"WITH {BARS_SQL}, k AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol, date_trunc('month', date) ORDER BY date) AS k, count(*) OVER (PARTITION BY symbol, date_trunc('month', date)) AS n FROM bars) SELECT symbol, date, CAST(isodow(date) AS INT) AS weekday, CAST(n - k AS INT) AS left, CAST(k <= 3 OR n - k < 1 AS INT) AS turn FROM k".replace("AS left", 'AS "left"'),
    "macd": f"""WITH RECURSIVE {BARS_SQL}, k AS (SELECT symbol, date, close, row_number() OVER ({_V}) AS i FROM bars),
w AS (SELECT symbol, i, close AS fast, close AS slow, CAST(0 AS DOUBLE) AS signal FROM k WHERE i = 1 UNION ALL
SELECT symbol, i, fast, slow, signal + (fast - slow - signal) * 0.2 FROM (SELECT k.symbol, k.i, w.fast + (k.close - w.fast) * 2 / 13 AS fast, w.slow + (k.close - w.slow) * 2 / 27 AS slow, w.signal FROM w JOIN k ON k.symbol = w.symbol AND k.i = w.i + 1))
SELECT k.symbol, k.date, round(fast, 6) AS fast, round(slow, 6) AS slow, round(signal, 6) AS signal, round(fast - slow, 6) AS macd FROM k JOIN w ON k.symbol = w.symbol AND k.i = w.i""",
    "volume_bars": _BARS_OF("size", 500),
    "dollar_bars": _BARS_OF("price * size", 100000),
    "session_volume": f"WITH {TICKS_SQL}, s AS (SELECT symbol, {_SESSION} AS session, CAST(sum(size) AS BIGINT) AS volume, count(*) AS n FROM ticks GROUP BY ALL) SELECT symbol, session, volume, n, round(volume / sum(volume) OVER (PARTITION BY symbol), 6) AS share FROM s",
    "session_bars": f"WITH {TICKS_SQL} SELECT symbol, {_SESSION} AS session, date_trunc('hour', ts) AS start, {_OHLC4}, round(sum(price * greatest(size, 1)) / sum(greatest(size, 1)), 6) AS vwap FROM ticks WHERE hour(ts) < 14 OR hour(ts) >= 20 GROUP BY ALL",
    "block_trades": f"WITH {TICKS_SQL}, s AS (SELECT *, sum(size) OVER (PARTITION BY symbol) AS total FROM ticks) SELECT symbol, seq, size, CASE WHEN size >= 95 AND price * size >= 15000 THEN 'both' WHEN size >= 95 THEN 'size' ELSE 'notional' END AS reason, round(size / total, 6) AS share FROM s WHERE size >= 95 OR price * size >= 15000",
    "dark_share": f"WITH {TICKS_SQL} SELECT symbol, CAST(sum(CASE WHEN venue IN (3, 4) THEN size ELSE 0 END) AS BIGINT) AS dark, CAST(sum(size) AS BIGINT) AS volume, round(sum(CASE WHEN venue IN (3, 4) THEN size ELSE 0 END) / sum(size), 6) AS share FROM ticks GROUP BY symbol",
    "signed_flow": f"WITH {_ASOF}, s AS (SELECT *, CAST(CASE WHEN abs(price - mid) > 0 THEN sign(price - mid) ELSE coalesce(sign(price - past), 0) END AS BIGINT) AS sg FROM m) SELECT symbol, CAST(sum(CASE WHEN sg = 1 THEN size ELSE 0 END) AS BIGINT) AS bought, CAST(sum(CASE WHEN sg = -1 THEN size ELSE 0 END) AS BIGINT) AS sold, CAST(sum(sg * size) AS BIGINT) AS net, round(sum(sg * size * price), 3) AS net_money FROM s GROUP BY symbol",
    "venue_quality": f"WITH {_ASOF} SELECT CASE WHEN venue IN (3, 4) THEN 'dark' ELSE 'lit' END AS kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS volume, round(avg(size), 6) AS mean_size, round(sum(price * size) / sum(size), 6) AS vwap, round(avg(20000 * abs(price - mid) / mid), 6) AS spread_bps FROM m GROUP BY 1",
    "back_adjusted": f"""WITH {BARS_SQL}, k AS (SELECT *, row_number() OVER v AS i, lag(close) OVER v AS past FROM bars WINDOW v AS ({_V})),
c AS (SELECT *, CASE WHEN i % 50 <> 0 THEN 1.0 WHEN symbol % 3 = 0 THEN 0.5 WHEN symbol % 3 = 1 THEN 1 - 1 / past ELSE 0.9 END AS cut FROM k),
f AS (SELECT *, exp(coalesce(sum(ln(cut)) OVER ({_V} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS product FROM c) SELECT symbol, date, round(product, 6) AS product, round(close * product, 6) AS adj_close FROM f""",
    "information_coefficient": f"WITH {_FACTOR}, r AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY factor) + (count(*) OVER (PARTITION BY date, factor) - 1) / 2 AS rf, rank() OVER (PARTITION BY date ORDER BY forward) + (count(*) OVER (PARTITION BY date, forward) - 1) / 2 AS rr FROM z) SELECT date, count(*) AS n, round(covar_pop(factor, forward) / nullif(stddev_pop(factor) * stddev_pop(forward), 0), 6) AS ic, round(covar_pop(rf, rr) / nullif(stddev_pop(rf) * stddev_pop(rr), 0), 6) AS rank_ic FROM r GROUP BY date HAVING count(*) >= 3",
    "factor_returns": f"WITH {_FACTOR}, w AS (SELECT *, factor - avg(factor) OVER (PARTITION BY date) AS w FROM z) SELECT date, count(*) AS n, round(sum(w * forward) / nullif(sum(abs(w)), 0), 6) AS ret FROM w GROUP BY date",
    "quantile_returns": f"WITH {_FACTOR}, b AS (SELECT *, CAST(ntile(5) OVER (PARTITION BY date ORDER BY factor, symbol) AS INT) AS bin FROM z) SELECT bin, count(*) AS n, round(avg(forward), 6) AS forward FROM b GROUP BY bin",
    "factor_turnover": f"WITH {_FACTOR}, r AS (SELECT symbol, date, percent_rank() OVER (PARTITION BY date ORDER BY factor) AS p FROM y WHERE factor IS NOT NULL), m AS (SELECT symbol, abs(p - lag(p) OVER ({_V})) AS m FROM r) SELECT symbol, count(m) AS n, round(avg(m), 6) AS turnover FROM m GROUP BY symbol",
    "drawdown_episodes": f"WITH {_DD}, u AS (SELECT *, dd < -1e-12 AS un, max(date) OVER (PARTITION BY symbol) AS fin FROM dd), n AS (SELECT *, CASE WHEN un IS DISTINCT FROM lag(un) OVER ({_V}) THEN 1 ELSE 0 END AS st FROM u), g AS (SELECT *, sum(st) OVER ({_V}) AS run FROM n) SELECT symbol, min(date) AS start, max(date) AS \"end\", count(*) AS n, CAST(max(date) = max(fin) AS INT) AS open, round(min(dd), 6) AS depth FROM g WHERE un GROUP BY symbol, run",
    "conditional_drawdown": f"WITH {_DD}, r AS (SELECT symbol, round(dd, 9) AS dd FROM dd), q AS (SELECT symbol, quantile_cont(dd, 0.05) AS cut FROM r GROUP BY symbol) SELECT r.symbol, count(*) AS n, round(avg(dd), 6) AS cdar FROM r JOIN q ON r.symbol = q.symbol WHERE dd <= cut GROUP BY r.symbol",
    "longest_streaks": f"WITH {_CLEAN}, s AS (SELECT symbol, date, CAST(coalesce(sign(ret), 0) AS INT) AS s FROM x), n AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER ({_V}) THEN 1 ELSE 0 END AS st FROM s), g AS (SELECT *, sum(st) OVER ({_V}) AS run FROM n), c AS (SELECT symbol, s, count(*) AS n FROM g GROUP BY symbol, run, s) SELECT symbol, coalesce(max(CASE WHEN s = 1 THEN n END), 0) AS wins, coalesce(max(CASE WHEN s = -1 THEN n END), 0) AS losses FROM c GROUP BY symbol",
    "return_shape": f"WITH {_CLEAN}, m AS (SELECT symbol, ret, avg(ret) OVER v AS mu, stddev_pop(ret) OVER v AS sd FROM x WHERE ret IS NOT NULL WINDOW v AS (PARTITION BY symbol)) SELECT symbol, round(avg(pow((ret - mu) / sd, 3)), 6) AS skew, round(avg(pow((ret - mu) / sd, 4)) - 3, 6) AS kurtosis, round(abs(quantile_cont(ret, 0.95) / nullif(quantile_cont(ret, 0.05), 0)), 6) AS tail_ratio, round(max(ret), 6) AS best, round(min(ret), 6) AS worst FROM m GROUP BY symbol",
    "rolling_risk": f"WITH {_RETS} SELECT symbol, date, CASE WHEN count(ret) OVER v = 20 THEN round(stddev_samp(ret) OVER v * sqrt(252), 6) END AS vol, CASE WHEN count(ret) OVER v = 20 THEN round(avg(ret) OVER v / nullif(stddev_samp(ret) OVER v, 0) * sqrt(252), 6) END AS sharpe FROM rets WINDOW v AS {_N(20)}",
    "round_trips": f"WITH {_TRIPS} SELECT symbol, side, opened, closed, bars, round(pnl, 6) AS pnl, round(mfe, 6) AS mfe, round(mae, 6) AS mae FROM trips",
    "trade_stats": f"WITH {_TRIPS} SELECT symbol, CASE WHEN bars <= 1 THEN '1' WHEN bars <= 5 THEN '2-5' WHEN bars <= 20 THEN '6-20' ELSE '>20' END AS bucket, count(*) AS n, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(pnl), 6) AS expectancy, round(avg(bars), 6) AS holding FROM trips GROUP BY 1, 2",
    "inverse_volatility": f"WITH {_RETS}, v AS (SELECT symbol, date, CASE WHEN count(ret) OVER v = 60 THEN 1 / nullif(stddev_samp(ret) OVER v, 0) END AS i FROM rets WINDOW v AS {_N(60)}) SELECT symbol, date, round(i / sum(i) OVER (PARTITION BY date), 6) AS weight FROM v",
    "rebalance_dates": f"WITH {BARS_SQL} SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS period, min(date) AS date FROM bars GROUP BY 1, 2",
    "walk_forward": f"WITH {BARS_SQL}, k AS (SELECT symbol, date, row_number() OVER ({_V}) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM bars), h AS (SELECT *, n - CAST(floor(n * 0.5) AS BIGINT) AS first FROM k), w AS (SELECT *, least((k - first) // greatest((n - first) // 5, 1), 4) AS fold FROM h WHERE k >= first) SELECT symbol, fold, min(date) AS start, max(date) AS \"end\", count(*) AS n_test, min(k) AS n_train FROM w GROUP BY symbol, fold",
    "masked_names": "SELECT c_custkey, 'PII_' || substr(sha256('key:' || c_name), 1, 16) AS c_name FROM customer",
    "newest_version": "WITH r AS (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DOUBLE) AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) SELECT o_custkey, o_orderkey, price FROM r WHERE r = 1 ORDER BY price DESC, o_custkey LIMIT 20",
    "delisted_in_window": f"WITH {BARS_SQL} SELECT symbol, max(date) AS \"end\" FROM bars WHERE symbol % 4 <> 0 GROUP BY symbol QUALIFY max(date) BETWEEN max(max(date)) OVER () - 5 AND max(max(date)) OVER () - 1",
    "volume_rollup": f"WITH {BARS_SQL} SELECT symbol, CAST(year(date) AS INT) AS year, sum(volume) AS volume, count(*) AS n, CAST(grouping(symbol) * 2 + grouping(year(date)) AS INT) AS level FROM bars GROUP BY ROLLUP (symbol, year(date))",
    "streamed_bars": f"WITH {TICKS_SQL} SELECT symbol, date_trunc('hour', ts) AS start, count(*) AS n, {_OHLC4} FROM ticks GROUP BY ALL",
}
