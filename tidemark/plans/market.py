"""Queries over the derived market tables and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import features as f
from tidemark.operators import panel as p
from tidemark.operators import tables as t
from tidemark.sources.derived import BARS_SQL, TICKS_SQL, bars, read, ticks


def _r(df: DataFrame, *keep: str, **rounded: str) -> DataFrame:
    return df.select(*[F.expr(c) if isinstance(c, str) else c for c in keep], *[F.round(c, 6).alias(n) for n, c in rounded.items()])


#: Ratios of short decimals tie at six places; nine tell them apart.
_VWAP = "round(vwap, 9) AS vwap"


def _rets(spark, sf):
    return f.returns(bars(spark, sf))


def _quotes(spark, sf):
    x = ticks(spark, sf).where("kind = 'view'")
    k = 0.01 * (1 + F.col("size") % 5)
    return x.select("symbol", "ts", (F.col("price") - k).alias("bid"), (F.col("price") + k).alias("ask"))


def _trades(spark, sf):
    return ticks(spark, sf).where("kind != 'view'").select("symbol", "ts", "seq", "price", "size")


def _listings(spark, sf):
    return bars(spark, sf).groupBy("symbol").agg(F.min("date").alias("start"), F.max("date").alias("last")).select("symbol", "start", F.when(F.col("symbol") % 4 != 0, F.col("last")).alias("end"))


def _orders(spark, sf, new: bool):
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("price"))
    m = F.col("o_orderkey") % 97
    if not new:
        return o.where(m != 1)
    return o.where(m != 2).withColumn("price", F.when(m == 3, F.col("price") + 1).otherwise(F.col("price")))


QUERIES = {
    "daily_bars": lambda s, d: _r(bars(s, d), "symbol", "date", open="open", high="high", low="low", close="close", volume="volume"),
    "simple_returns": lambda s, d: _r(_rets(s, d), "symbol", "date", ret="ret"),
    "rolling_stats": lambda s, d: _r(f.rolling_stats(bars(s, d), 20, "close"), "symbol", "date", mean="mean_20", std="std_20", lo="min_20", hi="max_20"),
    "bollinger_bands": lambda s, d: _r(f.bollinger(bars(s, d), 20, 2.0), "symbol", "date", mid="mid", upper="upper", lower="lower"),
    "average_true_range": lambda s, d: _r(f.average_true_range(bars(s, d), 14), "symbol", "date", tr="tr", atr="atr"),
    "skip_momentum": lambda s, d: _r(f.momentum(bars(s, d), 20, 1), "symbol", "date", mom="mom"),
    "signed_streak": lambda s, d: f.signed_streak(_rets(s, d)).select("symbol", "date", "streak"),
    "cross_section": lambda s, d: _r(f.cross_section(_rets(s, d).select("symbol", "date", F.round("ret", 9).alias("ret")), "ret"), "symbol", "date", z="z", pct="pct"),
    "drawdown_series": lambda s, d: _r(p.drawdown(_rets(s, d)), "symbol", "date", equity="equity", dd="dd"),
    "tail_risk": lambda s, d: _r(p.tail_risk(_rets(s, d).withColumn("ret", F.round("ret", 9))), "symbol", var="var", es="es"),
    "monthly_returns": lambda s, d: _r(p.monthly(_rets(s, d)), "symbol", "month", "n", ret="ret"),
    "tick_bars": lambda s, d: _r(t.tick_bars(ticks(s, d), 50), "symbol", "bar", "volume", "n", _VWAP, open="open", high="high", low="low", close="close"),
    "time_bars": lambda s, d: _r(t.time_bars(ticks(s, d), "1 hour"), "symbol", F.col("start").cast("timestamp_ntz").alias("start"), "volume", "n", _VWAP, open="open", high="high", low="low", close="close"),
    "signed_trades": lambda s, d: _r(t.signed_trades(_trades(s, d), _quotes(s, d)), "symbol", "seq", "size", "sign", mid="mid"),
    "contract_counts": lambda s, d: t.contract_counts(bars(s, d), 0.1),
    "change_capture": lambda s, d: t.changes(_orders(s, d, False), _orders(s, d, True), "o_orderkey", ["status", "price"]),
    "members_as_of": lambda s, d: t.members_as_of(bars(s, d).select("date").distinct(), _listings(s, d)),
    "keyword_search": lambda s, d: _r(t.keyword_search(read(s, d, "documents").select("doc_id", "text"), ["the", "tion", "der", "les"], 50), "doc_id", score="score"),
}

_RETS = f"{BARS_SQL}, rets AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM bars)"
_W = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_FULL = f"count(close) OVER {_W} = 20"
_OHLC = "round(arg_min(price, seq), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, seq), 6) AS close, CAST(sum(size) AS BIGINT) AS volume, count(*) AS n, round(sum(price * size) / sum(size), 9) AS vwap"
_ORDERS = "o AS (SELECT o_orderkey, o_orderstatus AS status, CAST(o_totalprice AS DOUBLE) AS price FROM orders), a AS (SELECT * FROM o WHERE o_orderkey % 97 <> 1), b AS (SELECT o_orderkey, status, CASE WHEN o_orderkey % 97 = 3 THEN price + 1 ELSE price END AS price FROM o WHERE o_orderkey % 97 <> 2)"

ORACLE = {
    "daily_bars": f"WITH {BARS_SQL} SELECT symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM bars",
    "simple_returns": f"WITH {_RETS} SELECT symbol, date, round(ret, 6) AS ret FROM rets",
    "rolling_stats": f"WITH {BARS_SQL} SELECT symbol, date, CASE WHEN {_FULL} THEN round(avg(close) OVER {_W}, 6) END AS mean, CASE WHEN {_FULL} THEN round(stddev_samp(close) OVER {_W}, 6) END AS std, CASE WHEN {_FULL} THEN round(min(close) OVER {_W}, 6) END AS lo, CASE WHEN {_FULL} THEN round(max(close) OVER {_W}, 6) END AS hi FROM bars",
    "bollinger_bands": f"WITH {BARS_SQL}, m AS (SELECT symbol, date, CASE WHEN {_FULL} THEN avg(close) OVER {_W} END AS mid, CASE WHEN {_FULL} THEN stddev_pop(close) OVER {_W} END AS dev FROM bars) SELECT symbol, date, round(mid, 6) AS mid, round(mid + 2 * dev, 6) AS upper, round(mid - 2 * dev, 6) AS lower FROM m",
    "average_true_range": f"WITH {BARS_SQL}, q AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS past FROM bars), tr AS (SELECT symbol, date, greatest(high - low, coalesce(abs(high - past), 0), coalesce(abs(low - past), 0)) AS tr FROM q) SELECT symbol, date, round(tr, 6) AS tr, CASE WHEN count(tr) OVER v = 14 THEN round(avg(tr) OVER v, 6) END AS atr FROM tr WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)",
    "skip_momentum": f"WITH {BARS_SQL} SELECT symbol, date, round(lag(close, 1) OVER v / lag(close, 21) OVER v - 1, 6) AS mom FROM bars WINDOW v AS (PARTITION BY symbol ORDER BY date)",
    "signed_streak": f"WITH {_RETS}, s AS (SELECT symbol, date, CAST(coalesce(sign(ret), 0) AS INT) AS sg FROM rets), n AS (SELECT *, CASE WHEN sg = lag(sg) OVER (PARTITION BY symbol ORDER BY date) THEN 0 ELSE 1 END AS st FROM s), g AS (SELECT *, sum(st) OVER (PARTITION BY symbol ORDER BY date) AS run FROM n) SELECT symbol, date, CAST(sg * row_number() OVER (PARTITION BY symbol, run ORDER BY date) AS INT) AS streak FROM g",
    "cross_section": f"WITH {_RETS}, x AS (SELECT symbol, date, round(ret, 9) AS ret FROM rets WHERE ret IS NOT NULL) SELECT symbol, date, round((ret - avg(ret) OVER (PARTITION BY date)) / nullif(stddev_pop(ret) OVER (PARTITION BY date), 0), 6) AS z, round(100 * (rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2) / count(ret) OVER (PARTITION BY date), 6) AS pct FROM x",
    "drawdown_series": f"WITH {_RETS}, e AS (SELECT symbol, date, exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY symbol ORDER BY date)) AS equity FROM rets) SELECT symbol, date, round(equity, 6) AS equity, round(equity / max(equity) OVER (PARTITION BY symbol ORDER BY date) - 1, 6) AS dd FROM e",
    "tail_risk": f"WITH {_RETS}, x AS (SELECT symbol, round(ret, 9) AS ret FROM rets WHERE ret IS NOT NULL), q AS (SELECT symbol, quantile_cont(ret, 0.05) AS var FROM x GROUP BY symbol) SELECT x.symbol, round(max(var), 6) AS var, round(avg(ret), 6) AS es FROM x JOIN q USING (symbol) WHERE ret <= var GROUP BY x.symbol",
    "monthly_returns": f"WITH {_RETS} SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS n, round(exp(sum(ln(1 + ret))) - 1, 6) AS ret FROM rets WHERE ret IS NOT NULL GROUP BY ALL",
    "tick_bars": f"WITH {TICKS_SQL}, k AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1) // 50 AS bar FROM ticks) SELECT symbol, bar, {_OHLC} FROM k GROUP BY symbol, bar",
    "time_bars": f"WITH {TICKS_SQL} SELECT symbol, date_trunc('hour', ts) AS start, {_OHLC} FROM ticks GROUP BY ALL",
    "signed_trades": f"""WITH {TICKS_SQL}, q AS (SELECT symbol, ts, ((price - 0.01 * (1 + size % 5)) + (price + 0.01 * (1 + size % 5))) / 2 AS mid FROM ticks WHERE kind = 'view'), tr AS (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq) AS past FROM ticks WHERE kind <> 'view')
SELECT tr.symbol, seq, size, CAST(CASE WHEN abs(price - mid) > 0 THEN sign(price - mid) ELSE coalesce(sign(price - past), 0) END AS INT) AS sign, round(mid, 6) AS mid FROM tr ASOF LEFT JOIN q ON tr.symbol = q.symbol AND tr.ts >= q.ts""",
    "contract_counts": f"WITH {_RETS} SELECT symbol, count(*) AS n, count(*) FILTER (high < low OR high < greatest(open, close) OR low > least(open, close)) AS impossible, count(*) FILTER (volume <= 0) AS no_volume, count(*) FILTER (abs(ret) > 0.1) AS extreme, CAST(max(date) - min(date) AS INT) AS span_days FROM rets GROUP BY symbol",
    "change_capture": f"WITH {_ORDERS} SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'insert' WHEN b.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS op, a.status AS old_status, b.status AS new_status, a.price AS old_price, b.price AS new_price FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.status IS DISTINCT FROM b.status OR a.price IS DISTINCT FROM b.price",
    "members_as_of": f"WITH {BARS_SQL}, l AS (SELECT symbol, min(date) AS s, CASE WHEN symbol % 4 <> 0 THEN max(date) END AS e FROM bars GROUP BY symbol) SELECT date, count(*) AS members FROM (SELECT DISTINCT date FROM bars) d JOIN l ON s <= date AND (e IS NULL OR date <= e) GROUP BY date",
    "keyword_search": "WITH h AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents), k AS (SELECT * FROM h WHERE word IN ('the', 'tion', 'der', 'les')), df AS (SELECT word, count(*) AS df FROM k GROUP BY word) SELECT doc_id, round(sum(ln(1 + (SELECT count(*) FROM documents) / (1.0 + df))), 6) AS score FROM k JOIN df USING (word) GROUP BY doc_id ORDER BY sum(ln(1 + (SELECT count(*) FROM documents) / (1.0 + df))) DESC, doc_id LIMIT 50",
}
