"""Feature, liquidity, execution, text and monitoring queries and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lanes as q
from tidemark.operators import neighbours
from tidemark.plans.market import _r
from tidemark.plans.panels import _HELD, _held
from tidemark.plans.research import _CLEAN, _FACTOR, _N, _V, _clean, _factor
from tidemark.sources.derived import BARS_SQL, TICKS_SQL, bars, read, ticks

RULES = [("calm", "ret", "<", 0.01), ("up", "ret", ">", 0.0), ("deep", "volume", ">=", 40.0)]
BUCKETS = [(1, 10), (11, 20), (21, 50), (51, 100)]
SPOTS = [80.0, 95.0, 100.0, 105.0, 120.0]
STOP = ["THE", "AND"]


def _votes(s, d):
    x = _clean(s, d).withColumns({f"s{k}": F.coalesce(F.signum(F.col("close") - F.lag("close", k).over(q._by())), F.lit(0.0)) for k in (1, 5, 20)})
    return x.select("symbol", "date", *[q.vote(["s1", "s5", "s20"], r).alias(r) for r in ("majority", "unanimity", "median")])


def _sells(s, d):
    l = read(s, d, "lineitem")  # noqa: E741
    n = F.when(F.col("l_linenumber") % 3 == 0, -F.col("l_quantity").cast("double")).otherwise(F.col("l_quantity").cast("double"))
    return l.select((F.col("l_suppkey") * 100 + F.col("l_orderkey") % 100).alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), n.alias("quantity"), (F.col("l_discount").cast("double") - 0.05).alias("pnl"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))


def _orders(s, d):
    l = read(s, d, "lineitem")  # noqa: E741
    return l.select(F.col("l_quantity").cast("int").alias("size"), (F.col("l_returnflag") != "R").alias("filled"), (F.col("l_tax").cast("double") * 100).alias("spread_bps"), F.col("l_linestatus").alias("category"), (F.col("l_suppkey") % 9).alias("venue"), F.col("l_discount").cast("double").alias("payment"))


def _legs(s, d):
    return read(s, d, "part").select((F.col("p_partkey") % 100).alias("strategy"), F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("put").alias("kind"), (90.0 + F.col("p_size")).alias("strike"), F.when(F.col("p_partkey") % 3 == 0, -1.0).otherwise(1.0).alias("quantity"), (F.col("p_size") / 10).alias("premium"))


def _vectors(s, d):
    e = read(s, d, "embeddings")
    key = e.columns[0]
    return e.select(F.col(key).cast("long").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))


def _nearest(s, d):
    v = _vectors(s, d)
    return _r(neighbours.nearest(v, v.where("id % 100 = 0"), 10), "query", "id", cosine="cosine")


def _meta(s, d):
    x = _held(s, d)
    return x.select("symbol", "date", q.meta_labels(F.col("w"), F.lead("ret").over(q._by()), 0.01).alias("label"), F.round(q.dead_band(F.col("ret"), 0.01), 6).alias("ret"))


def _seq(s, d):
    x = q.sequences(_clean(s, d).where("ret is not null"), ["ret", "volume"], 5, 3)
    b = [c for c in x.columns if c.startswith("seq_")][1]
    total = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, v: a + v)
    return x.select("symbol", "date", F.size("seq_ret").alias("n"), F.round(F.get("seq_ret", 0), 6).alias("first"), F.round(total(b), 4).alias("total"), F.round("target", 6).alias("target"))


QUERIES = {
    "auto_threshold": lambda s, d: _r(q.auto_threshold(ticks(s, d), 10), "symbol", "days", "ticks", volume="volume", money="money"),
    "monthly_closes": lambda s, d: _r(q.resampled(bars(s, d), "month"), "symbol", "period", "n", close="close", ret="ret"),
    "session_ends": lambda s, d: q.session_ends(ticks(s, d)).select("symbol", "seq", "session", "last"),
    "latest_by_feed": lambda s, d: _r(q.latest_by_feed(ticks(s, d), "kind"), "symbol", "kind", F.col("ts").cast("timestamp_ntz").alias("ts"), price="price", premium_bps="premium_bps"),
    "volume_profile": lambda s, d: _r(q.volume_profile(bars(s, d), 10, 1.0), "symbol", "bin", "control", "node", volume="volume"),
    "funding": lambda s, d: _r(q.funding(_held(s, d).select("symbol", "date", (F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("pnl"), (F.col("symbol") % 5 / 10000).alias("rate"), F.col("w").alias("position"))), "symbol", "date", net="net", yearly="yearly"),
    "liquidity": lambda s, d: _r(q.liquidity(bars(s, d), 20, 0.05, 26.0), "symbol", "date", "thin", **{c: c for c in ("adv", "money", "vol", "turnover_cv", "spread_bps", "capacity")}),
    "liquidity_class": lambda s, d: _r(q.liquidity_class(bars(s, d), (1000.0, 2850.0, 2900.0)), "symbol", "class", "haircut", adv="adv", active="active"),
    "dynamic_cap": lambda s, d: _r(q.dynamic_cap(bars(s, d), 20, 1.5), "symbol", "date", "capped", cap="cap"),
    "spread_block": lambda s, d: q.spread_block(bars(s, d).withColumns({"high": F.round("high", 6), "low": F.round("low", 6)}), 20, 2.03),
    "log_and_lagged": lambda s, d: _r(q.log_and_lagged(bars(s, d), [1, 3]), "symbol", "date", log_ret="log_ret", lag_1="lag_1", lag_3="lag_3"),
    "rolling_shape": lambda s, d: q.rolling_shape(_clean(s, d), 30).select("symbol", "date", F.round("skew", 4).alias("skew"), F.round("kurtosis", 4).alias("kurtosis")),
    "band_position": lambda s, d: _r(q.band_position(bars(s, d), 20, 2.0), "symbol", "date", percent="percent", width="width"),
    "commodity_channel": lambda s, d: _r(q.commodity_channel(bars(s, d), 14), "symbol", "date", cci="cci", up="up", down="down"),
    "mid_rank": lambda s, d: _r(q.mid_rank(bars(s, d).withColumn("close", F.round("close", 6)), 20, "close"), "symbol", "date", rank="rank"),
    "serial_structure": lambda s, d: q.serial_structure(_clean(s, d), 60, 5).select("symbol", "date", F.round("rho", 4).alias("rho"), F.round("ratio", 4).alias("ratio")),
    "yang_zhang": lambda s, d: _r(q.yang_zhang(bars(s, d), 20), "symbol", "date", vol="vol"),
    "frac_diff": lambda s, d: _r(q.frac_diff(bars(s, d), 0.4, 0.01), "symbol", "date", diff="diff"),
    "barrier_labels": lambda s, d: q.barriers(bars(s, d).withColumn("close", F.round("close", 6)), 1.01, 20, 10),
    "meta_labels": _meta,
    "sequences": _seq,
    "pair_spread": lambda s, d: q.pair_spread(bars(s, d), 20).select("symbol", "date", F.round("spread", 6).alias("spread"), F.round("z", 4).alias("z")),
    "vol_target": lambda s, d: _r(q.vol_target(_held(s, d), 20, 0.1, 2.0), "symbol", "date", scaled="scaled"),
    "votes": _votes,
    "evaluated_rules": lambda s, d: q.evaluated_rules(_clean(s, d).join(bars(s, d).select("symbol", "date", F.col("volume").alias("v")), ["symbol", "date"]).withColumn("volume", F.col("v")), RULES),
    "quantile_signal": lambda s, d: q.quantile_signal(_factor(s, d).where("factor is not null"), "factor", 0.2),
    "reference_percentile": lambda s, d: _r(q.reference_percentile(_factor(s, d), "factor", F.col("symbol") % 3 == 0), "symbol", "date", pct="pct"),
    "breadth": lambda s, d: _r(q.breadth(_clean(s, d)), "date", "n", **{c: c for c in ("rising", "dispersion", "iqr", "excess")}),
    "month_momentum": lambda s, d: _r(q.month_momentum(bars(s, d)), "symbol", "month", **{c: c for c in ("reversal", "mom_6", "mom_12", "long_reversal")}),
    "screened_weights": lambda s, d: q.screened_weights(bars(s, d).select("symbol", "date", F.col("volume").alias("w")), F.col("symbol") % 4 != 2).select("symbol", "date", F.round("w", 9).alias("w")),
    "wash_sales": lambda s, d: q.wash_sales(_sells(s, d), 30).select("id", "symbol", "date", "quantity"),
    "size_buckets": lambda s, d: _r(q.size_buckets(_orders(s, d), BUCKETS), "low", "n", fill_rate="fill_rate", spread_bps="spread_bps"),
    "venue_report": lambda s, d: _r(q.venue_report(_orders(s, d)), "venue", "category", "n", "size", payment="payment"),
    "reconstructed": lambda s, d: q.reconstructed(bars(s, d).select("symbol", F.round("close", 6).alias("price")), bars(s, d).where("symbol % 10 != 3").groupBy("symbol").agg(F.round(F.max_by("close", "date"), 6).alias("price")), 0.0501),
    "payoffs": lambda s, d: _r(q.payoffs(_legs(s, d), SPOTS), "strategy", "spot", payoff="payoff"),
    "capital_tokens": lambda s, d: q.capital_tokens(read(s, d, "documents").where("text is not null"), STOP, "source"),
    "hash_embedding": lambda s, d: _r(q.hash_embedding(read(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), 64), "doc_id", "k", v="v"),
    "nearest_vectors": _nearest,
    "flattened_events": lambda s, d: q.flattened(read(s, d, "events").select("event_id", "event_type", "props"), "props", "k INT"),
    "stale_feeds": lambda s, d: q.stale_feeds(ticks(s, d), F.lit("2024-02-01 00:00:00").cast("timestamp"), 3600),
    "gap_sessions": lambda s, d: q.gap_sessions(ticks(s, d), 7200),
    "frozen_prices": lambda s, d: q.frozen_prices(bars(s, d).withColumn("close", F.round("close", 0)), 3),
    "only_newer": lambda s, d: q.only_newer(ticks(s, d)).groupBy("symbol").agg(F.count("*").alias("n"), F.max("seq").alias("last")),
    "last_rows": lambda s, d: q.last_rows(ticks(s, d), 20).select("symbol", "seq", "size"),
    "missing_orders": lambda s, d: q.missing_orders(read(s, d, "orders").where("o_orderkey % 7 != 0"), read(s, d, "orders").where("o_orderkey % 5 != 0"), ["o_custkey", "o_orderstatus"]),
    "factor_lags": lambda s, d: _r(q.factor_lags(_factor(s, d), [1, 5, 20]), "lag", "n", corr="corr"),
}

_CASES = lambda n, x: f"CASE WHEN count(close) OVER {_N(n)} = {n} THEN {x} END"
_SIGNS = f"{_CLEAN}, v AS (SELECT symbol, date, coalesce(sign(close - lag(close, 1) OVER ({_V})), 0) AS a, coalesce(sign(close - lag(close, 5) OVER ({_V})), 0) AS b, coalesce(sign(close - lag(close, 20) OVER ({_V})), 0) AS c FROM x)"
_FRAC = q.frac_weights(0.4, 0.01)

ORACLE = {
    "auto_threshold": f"WITH {TICKS_SQL} SELECT symbol, count(DISTINCT CAST(ts AS DATE)) AS days, CAST(greatest(1, floor(count(*) / (count(DISTINCT CAST(ts AS DATE)) * 10))) AS BIGINT) AS ticks, round(sum(size) / (count(DISTINCT CAST(ts AS DATE)) * 10), 6) AS volume, round(sum(price * size) / (count(DISTINCT CAST(ts AS DATE)) * 10), 6) AS money FROM ticks GROUP BY symbol",
    "monthly_closes": f"WITH {BARS_SQL}, g AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS period, arg_max(close, date) AS close, count(*) AS n FROM bars GROUP BY 1, 2) SELECT symbol, period, n, round(close, 6) AS close, round(close / lag(close) OVER (PARTITION BY symbol ORDER BY period) - 1, 6) AS ret FROM g",
    "session_ends": f"WITH {TICKS_SQL} SELECT symbol, seq, CAST(ts AS DATE) AS session, coalesce(lead(CAST(ts AS DATE)) OVER w <> CAST(ts AS DATE), true) AS last FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)",
    "latest_by_feed": f"WITH {TICKS_SQL}, m AS (SELECT *, avg(price) OVER (PARTITION BY symbol) AS m FROM ticks) SELECT symbol, kind, ts, round(price, 6) AS price, round((price / m - 1) * 1e4, 6) AS premium_bps FROM m QUALIFY row_number() OVER (PARTITION BY symbol, kind ORDER BY ts DESC, seq DESC) = 1",
    "volume_profile": f"WITH {BARS_SQL}, m AS (SELECT *, min(close) OVER w AS lo, max(close) OVER w AS hi FROM bars WINDOW w AS (PARTITION BY symbol)), b AS (SELECT symbol, CAST(coalesce(least(9, floor((close - lo) / nullif(hi - lo, 0) * 10)), 0) AS INT) AS bin, sum(volume) AS volume FROM m GROUP BY 1, 2), z AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, bin) = 1 AS control, (volume - avg(volume) OVER w) / nullif(stddev_pop(volume) OVER w, 0) AS s FROM b WINDOW w AS (PARTITION BY symbol)) SELECT symbol, bin, control, CASE WHEN s >= 1 THEN 'high' WHEN s <= -1 THEN 'low' ELSE 'mid' END AS node, round(volume, 6) AS volume FROM z",
    "funding": f"WITH {_HELD} SELECT symbol, date, round(w * r0 - w * ((symbol % 5) / 10000), 6) AS net, round((symbol % 5) / 10000 * 3 * 365, 6) AS yearly FROM c",
    "liquidity": f"WITH {BARS_SQL}, l AS (SELECT *, close * volume AS m, ln(close / lag(close) OVER ({_V})) AS r FROM bars), f AS (SELECT symbol, date, close, " + ", ".join(_CASES(20, e) + f" AS {n}" for n, e in (("adv", f"avg(volume) OVER {_N(20)}"), ("money", f"sum(m) OVER {_N(20)}"), ("vol", f"stddev_samp(r) OVER {_N(20)} * sqrt(252)"), ("turnover_cv", f"stddev_samp(volume) OVER {_N(20)} / nullif(avg(volume) OVER {_N(20)}, 0)"), ("spread_bps", f"least(2 * stddev_samp(r) OVER {_N(20)} * 1e4, 50)"))) + " FROM l) SELECT symbol, date, coalesce(adv < 26, true) AS thin, round(adv, 6) AS adv, round(money, 6) AS money, round(vol, 6) AS vol, round(turnover_cv, 6) AS turnover_cv, round(spread_bps, 6) AS spread_bps, round(adv * 0.05::DOUBLE * close, 6) AS capacity FROM f",
    "liquidity_class": f"WITH {BARS_SQL}, g AS (SELECT symbol, avg(close * volume) AS adv, avg(CASE WHEN close * volume >= 1000 THEN 1.0 ELSE 0.0 END) AS active FROM bars GROUP BY symbol), k AS (SELECT *, CASE WHEN adv >= 2900 THEN 'deep' WHEN adv >= 2850 THEN 'normal' WHEN adv >= 1000 THEN 'thin' ELSE 'none' END AS class FROM g) SELECT symbol, class, CASE class WHEN 'deep' THEN 1::DOUBLE WHEN 'normal' THEN 0.7::DOUBLE WHEN 'thin' THEN 0.4::DOUBLE ELSE 0 END AS haircut, round(adv, 6) AS adv, round(active, 6) AS active FROM k",
    "dynamic_cap": f"WITH {BARS_SQL}, m AS (SELECT *, close * volume AS m FROM bars), k AS (SELECT *, CASE WHEN count(close) OVER {_N(20)} = 20 THEN avg(m) OVER {_N(20)} END AS a FROM m) SELECT symbol, date, m > 1.5::DOUBLE * a AS capped, round(least(m, 1.5::DOUBLE * a), 6) AS cap FROM k",
    "spread_block": f"WITH {BARS_SQL}, r AS (SELECT symbol, date, round(high, 6) - round(low, 6) AS r FROM bars) SELECT symbol, date, coalesce(r > 2.03::DOUBLE * avg(r) OVER ({_V} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), false) AS blocked FROM r",
    "log_and_lagged": f"WITH {BARS_SQL} SELECT symbol, date, round(ln(close / lag(close) OVER v), 6) AS log_ret, round(lag(close, 1) OVER v / lag(close, 2) OVER v - 1, 6) AS lag_1, round(lag(close, 3) OVER v / lag(close, 4) OVER v - 1, 6) AS lag_3 FROM bars WINDOW v AS ({_V})",
    "rolling_shape": f"WITH {_CLEAN} SELECT symbol, date, CASE WHEN count(ret) OVER v = 30 THEN round(skewness(ret) OVER v, 4) END AS skew, CASE WHEN count(ret) OVER v = 30 THEN round(kurtosis(ret) OVER v, 4) END AS kurtosis FROM x WINDOW v AS {_N(30)}",
    "band_position": f"WITH {BARS_SQL}, m AS (SELECT symbol, date, close, count(close) OVER v AS n, avg(close) OVER v AS m, stddev_samp(close) OVER v AS sd FROM bars WINDOW v AS {_N(20)}) SELECT symbol, date, CASE WHEN n = 20 THEN round((close - (m - 2 * sd)) / nullif(4 * sd, 0), 6) END AS percent, CASE WHEN n = 20 THEN round(4 * sd / nullif(m, 0), 6) END AS width FROM m",
    "commodity_channel": f"""WITH {BARS_SQL}, t AS (SELECT *, (high + low + close) / 3 AS t FROM bars), l AS (SELECT *, list(t) OVER {_N(14)} AS l, avg(t) OVER {_N(14)} AS m, list_reverse(list(high) OVER {_N(15)}) AS h, list_reverse(list(low) OVER {_N(15)}) AS w FROM t)
SELECT symbol, date, CASE WHEN len(l) = 14 THEN round((t - m) / nullif(0.015::DOUBLE * list_sum(list_transform(l, lambda z: abs(z - m))) / 14, 0), 6) END AS cci, CASE WHEN len(h) = 15 THEN round(100.0 * (14 - (list_position(h, list_max(h)) - 1)) / 14, 6) END AS up, CASE WHEN len(w) = 15 THEN round(100.0 * (14 - (list_position(w, list_min(w)) - 1)) / 14, 6) END AS down FROM l""",
    "mid_rank": f"WITH {BARS_SQL}, c AS (SELECT symbol, date, round(close, 6) AS close FROM bars), l AS (SELECT *, list(close) OVER {_N(20)} AS l FROM c) SELECT symbol, date, CASE WHEN len(l) = 20 THEN round((len(list_filter(l, lambda z: z < close)) + len(list_filter(l, lambda z: z = close)) / 2) / 20 - 0.5, 6) END AS rank FROM l",
    "serial_structure": f"WITH {_CLEAN}, p AS (SELECT symbol, date, ret, lag(ret) OVER ({_V}) AS p, CASE WHEN count(ret) OVER {_N(5)} = 5 THEN sum(ret) OVER {_N(5)} END AS s FROM x) SELECT symbol, date, CASE WHEN count(p) OVER v = 60 AND count(s) OVER v = 60 THEN round(covar_pop(ret, p) OVER v / nullif(stddev_pop(ret) OVER v * stddev_pop(p) OVER v, 0), 4) END AS rho, CASE WHEN count(p) OVER v = 60 AND count(s) OVER v = 60 THEN round(var_pop(s) OVER v / nullif(5 * var_pop(ret) OVER v, 0), 4) END AS ratio FROM p WINDOW v AS {_N(60)}",
    "yang_zhang": f"WITH {BARS_SQL}, l AS (SELECT symbol, date, ln(open / lag(close) OVER ({_V})) AS o, ln(close / open) AS c, ln(high / open) * (ln(high / open) - ln(close / open)) + ln(low / open) * (ln(low / open) - ln(close / open)) AS rs FROM bars), z AS (SELECT *, 0.34::DOUBLE / (1.34::DOUBLE + 21::DOUBLE / 19) AS k FROM l) SELECT symbol, date, CASE WHEN count(o) OVER v = 20 THEN round(sqrt(greatest(var_samp(o) OVER v + k * var_samp(c) OVER v + (1 - k) * avg(rs) OVER v, 0) * 252), 6) END AS vol FROM z WINDOW v AS {_N(20)}",
    "frac_diff": f"WITH {BARS_SQL}, l AS (SELECT symbol, date, ln(close) AS l FROM bars) SELECT symbol, date, round(" + " + ".join(f"({w!r})::DOUBLE * lag(l, {k}) OVER ({_V})" for k, w in enumerate(_FRAC)) + ", 6) AS diff FROM l",
    "barrier_labels": f"""WITH {BARS_SQL}, c AS (SELECT symbol, date, round(close, 6) AS close FROM bars), r AS (SELECT *, ln(close / lag(close) OVER ({_V})) AS r FROM c), s AS (SELECT *, CASE WHEN count(r) OVER {_N(20)} = 20 THEN stddev_samp(r) OVER {_N(20)} END AS s, list(close) OVER ({_V} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS nx FROM r),
p AS (SELECT *, nullif(coalesce(list_position(list_transform(nx, lambda z: z / close - 1 >= 1.01::DOUBLE * s), true), 0), 0) AS up, nullif(coalesce(list_position(list_transform(nx, lambda z: z / close - 1 <= -1.01::DOUBLE * s), true), 0), 0) AS dn FROM s WHERE s IS NOT NULL AND len(nx) = 10)
SELECT symbol, date, CAST(CASE WHEN up IS NULL AND dn IS NULL THEN 0 WHEN dn IS NULL OR up <= dn THEN 1 ELSE -1 END AS INT) AS label, CAST(coalesce(least(up, dn), 10) AS INT) AS touched FROM p""",
    "meta_labels": f"WITH {_HELD}, n AS (SELECT symbol, date, w, ret, lead(ret) OVER ({_V}) AS f FROM h) SELECT symbol, date, CAST(coalesce(w <> 0 AND sign(w) = sign(f) AND abs(f) > 0.01::DOUBLE, false) AS INT) AS label, round(sign(ret) * greatest(abs(ret) - 0.01::DOUBLE, 0), 6) AS ret FROM n",
    "sequences": f"WITH {_CLEAN}, k AS (SELECT symbol, date, count(*) OVER {_N(5)} AS n, lag(ret, 4) OVER ({_V}) AS first, sum(volume) OVER {_N(5)} AS total, lead(ret, 3) OVER ({_V}) AS target FROM x WHERE ret IS NOT NULL) SELECT symbol, date, CAST(n AS INT) AS n, round(first, 6) AS first, round(total, 4) AS total, round(target, 6) AS target FROM k WHERE n = 5 AND target IS NOT NULL",
    "pair_spread": f"WITH {BARS_SQL}, p AS (SELECT a.symbol, a.date, ln(a.close) - ln(b.close) AS spread FROM bars a JOIN bars b ON b.symbol = a.symbol + 1 AND b.date = a.date) SELECT symbol, date, round(spread, 6) AS spread, CASE WHEN count(*) OVER v = 20 THEN round((spread - avg(spread) OVER v) / nullif(stddev_samp(spread) OVER v, 0), 4) END AS z FROM p WINDOW v AS {_N(20)}",
    "vol_target": f"WITH {_HELD} SELECT symbol, date, round(w * least(2, CASE WHEN count(ret) OVER {_N(20)} = 20 THEN 0.1::DOUBLE / nullif(stddev_samp(ret) OVER {_N(20)} * sqrt(252), 0) END), 6) AS scaled FROM h",
    "votes": f"WITH {_SIGNS} SELECT symbol, date, CASE WHEN abs(a + b + c) * 2 > 3 THEN CAST(sign(a + b + c) AS DOUBLE) ELSE 0 END AS majority, CASE WHEN abs(a + b + c) = 3 THEN CAST(sign(a + b + c) AS DOUBLE) ELSE 0 END AS unanimity, CAST(list_sort([a, b, c])[2] AS DOUBLE) AS median FROM v",
    "evaluated_rules": f"WITH {_CLEAN}, z AS (SELECT x.*, b.volume AS v FROM x JOIN bars b ON b.symbol = x.symbol AND b.date = x.date), g AS (SELECT symbol, count(*) FILTER (ret < 0.01::DOUBLE) AS a, count(*) FILTER (ret > 0) AS b, count(*) FILTER (v >= 40) AS c FROM z GROUP BY symbol) SELECT symbol, unnest(['calm', 'up', 'deep']) AS rule, unnest([a, b, c]) AS n FROM g",
    "quantile_signal": f"WITH {_FACTOR}, c AS (SELECT date, quantile_cont(factor, 0.8::DOUBLE) AS hi, quantile_cont(factor, 0.2::DOUBLE) AS lo FROM y WHERE factor IS NOT NULL GROUP BY date) SELECT symbol, date, CAST(CASE WHEN factor >= hi THEN 1 WHEN factor <= lo THEN -1 ELSE 0 END AS INT) AS signal FROM y JOIN c USING (date) WHERE factor IS NOT NULL",
    "reference_percentile": f"WITH {_FACTOR}, r AS (SELECT symbol, date, factor, CASE WHEN symbol % 3 = 0 THEN 1 ELSE 0 END AS r FROM y), w AS (SELECT symbol, date, factor, sum(r) OVER (PARTITION BY date ORDER BY factor RANGE UNBOUNDED PRECEDING) AS upto, sum(r) OVER (PARTITION BY date, factor) AS same, sum(r) OVER (PARTITION BY date) AS al FROM r WHERE factor IS NOT NULL) SELECT symbol, date, round((upto - same / 2) / nullif(al, 0), 6) AS pct FROM w",
    "breadth": f"WITH {_CLEAN} SELECT date, count(*) AS n, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS rising, round(stddev_pop(ret), 6) AS dispersion, round(quantile_cont(ret, 0.75) - quantile_cont(ret, 0.25), 6) AS iqr, round(sum(ret * ret) / nullif(pow(sum(abs(ret)), 2), 0) - 1 / count(*), 6) AS excess FROM x WHERE ret IS NOT NULL GROUP BY date",
    "month_momentum": f"WITH {BARS_SQL}, m AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(close, date) AS c FROM bars GROUP BY 1, 2) SELECT symbol, month, round(c / lag(c) OVER w - 1, 6) AS reversal, round(lag(c) OVER w / lag(c, 6) OVER w - 1, 6) AS mom_6, round(lag(c) OVER w / lag(c, 12) OVER w - 1, 6) AS mom_12, round(lag(c, 12) OVER w / lag(c, 18) OVER w - 1, 6) AS long_reversal FROM m WINDOW w AS (PARTITION BY symbol ORDER BY month)",
    "screened_weights": f"WITH {BARS_SQL} SELECT symbol, date, round(volume / nullif(sum(volume) OVER (PARTITION BY date), 0), 9) AS w FROM bars WHERE symbol % 4 <> 2",
    "wash_sales": "WITH t AS (SELECT l_suppkey * 100 + l_orderkey % 100 AS symbol, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_linenumber % 3 = 0 THEN -CAST(l_quantity AS DOUBLE) ELSE CAST(l_quantity AS DOUBLE) END AS quantity, CAST(l_discount AS DOUBLE) - 0.05::DOUBLE AS pnl, l_orderkey * 10 + l_linenumber AS id FROM lineitem) SELECT id, symbol, date, quantity FROM t b WHERE quantity > 0 AND EXISTS (SELECT 1 FROM t s WHERE s.symbol = b.symbol AND s.quantity < 0 AND s.pnl < 0 AND b.date > s.date AND b.date <= s.date + 30)",
    "size_buckets": "WITH o AS (SELECT CAST(l_quantity AS INT) AS size, l_returnflag <> 'R' AS filled, CAST(l_tax AS DOUBLE) * 100 AS sp FROM lineitem), b AS (SELECT unnest([1, 11, 21, 51]) AS lo, unnest([10, 20, 50, 100]) AS hi) SELECT CAST(lo AS INT) AS low, count(size) AS n, round(avg(CASE WHEN filled THEN 1.0 WHEN NOT filled THEN 0.0 END), 6) AS fill_rate, round(avg(sp), 6) AS spread_bps FROM b LEFT JOIN o ON size BETWEEN lo AND hi GROUP BY lo",
    "venue_report": "SELECT l_suppkey % 9 AS venue, l_linestatus AS category, count(*) AS n, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS size, round(sum(CAST(l_discount AS DOUBLE)), 6) AS payment FROM lineitem GROUP BY GROUPING SETS ((l_suppkey % 9), (l_linestatus))",
    "reconstructed": f"WITH {BARS_SQL}, m AS (SELECT symbol, round(arg_max(close, date), 6) AS m FROM bars WHERE symbol % 10 <> 3 GROUP BY symbol) SELECT b.symbol, count(*) AS n, count(*) FILTER (abs(round(close, 6) / m - 1) > 0.0501::DOUBLE) AS outside, count(*) FILTER (m IS NULL) AS unmatched FROM bars b LEFT JOIN m ON m.symbol = b.symbol GROUP BY b.symbol",
    "payoffs": "WITH s AS (SELECT unnest([80::DOUBLE, 95, 100, 105, 120]) AS spot), l AS (SELECT p_partkey % 100 AS strategy, p_partkey % 2 = 0 AS call, 90 + p_size AS strike, CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END AS q, p_size / 10 AS premium FROM part) SELECT strategy, spot, round(sum(q * (CASE WHEN call THEN greatest(spot - strike, 0) ELSE greatest(strike - spot, 0) END - premium)), 6) AS payoff FROM l, s GROUP BY 1, 2",
    "capital_tokens": r"WITH w AS (SELECT source, unnest(list_distinct(regexp_split_to_array(text, '[^A-Za-z]+'))) AS token FROM documents WHERE text IS NOT NULL) SELECT source, token, count(*) AS n FROM w WHERE regexp_matches(token, '^[A-Z]{2,5}$') AND token NOT IN ('THE', 'AND') GROUP BY 1, 2",
    "hash_embedding": "WITH w AS (SELECT item_id AS doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda z: length(z) > 0)) AS w FROM benchmark), h AS (SELECT doc_id, md5(w) AS m FROM w), p AS (SELECT doc_id, CAST((" + " + ".join(f"CAST((instr('0123456789abcdef', substr(m, {i + 1}, 1)) - 1) * {16 ** (7 - i)} AS BIGINT)" for i in range(8)) + ") % 64 AS INT) AS k, count(*) AS n FROM h GROUP BY 1, 2) SELECT doc_id, k, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS v FROM p",
    "nearest_vectors": "WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.id AS query, b.id AS id, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0) SELECT query, id, round(c, 6) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) <= 10",
    "flattened_events": "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "stale_feeds": f"WITH {TICKS_SQL}, g AS (SELECT symbol, max(ts) AS l FROM ticks GROUP BY symbol) SELECT symbol, CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(l)) AS BIGINT) AS age, epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(l)) > 3600 AS stale FROM g",
    "gap_sessions": f"WITH {TICKS_SQL}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 7200000000 THEN 1 ELSE 0 END AS n FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)), s AS (SELECT symbol, size, CAST(sum(n) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g) SELECT symbol, session, count(*) AS n, CAST(sum(size) AS BIGINT) AS volume FROM s GROUP BY 1, 2",
    "frozen_prices": f"WITH {BARS_SQL}, c AS (SELECT symbol, date, round(close, 0) AS close FROM bars), n AS (SELECT *, CASE WHEN close <> lag(close) OVER ({_V}) THEN 1 ELSE 0 END AS n FROM c), g AS (SELECT *, sum(n) OVER ({_V} ROWS UNBOUNDED PRECEDING) AS g FROM n) SELECT symbol, min(date) AS start, count(*) AS n FROM g GROUP BY symbol, g HAVING count(*) >= 3",
    "only_newer": f"WITH {TICKS_SQL}, p AS (SELECT *, max(ts) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ticks) SELECT symbol, count(*) AS n, max(seq) AS last FROM p WHERE p IS NULL OR ts > p GROUP BY symbol",
    "last_rows": f"WITH {TICKS_SQL} SELECT symbol, seq, size FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) <= 20",
    "missing_orders": "WITH a AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0) SELECT *, 'intended' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'real' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
    "factor_lags": f"WITH {_FACTOR}, l AS (SELECT factor, lag(factor, 1) OVER ({_V}) AS a, lag(factor, 5) OVER ({_V}) AS b, lag(factor, 20) OVER ({_V}) AS c FROM y) "
    + " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS lag, count(*) AS n, round(corr(factor, {v}), 6) AS corr FROM l WHERE factor IS NOT NULL AND {v} IS NOT NULL" for k, v in ((1, "a"), (5, "b"), (20, "c"))),
}
