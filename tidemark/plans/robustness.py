"""Resampling, stress, cost and lot queries and the SQL that checks them, which expands what the operators sum."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as f
from tidemark.operators import panel, panels
from tidemark.operators import robustness as b
from tidemark.plans.market import _r
from tidemark.plans.panels import _HELD, _NET, _held
from tidemark.plans.research import _CLEAN, _N, _V, _clean
from tidemark.sources.derived import BARS_SQL, bars, read

CRASH = [-0.05, -0.08, 0.03, -0.12, -0.04]
COSTS = {"commission": 1.0, "spread": 2.5, "slippage": 4.0}
AMOUNTS = [1e3, 1e4, 1e5, 1e6]


def _monthly(s, d):
    return panel.monthly(_clean(s, d))


def _events(s, d):
    return f.returns(bars(s, d)).withColumn("ret", F.round("ret", 9))


def _costed(s, d):
    return panels.costed_returns(_held(s, d), 2.0, 0.03).withColumn("net", F.round("net", 9))


def _ledger(s, d):
    c = F.col("o_orderkey")
    return read(s, d, "orders").select((F.col("o_custkey") % 50).alias("run"), F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("strategy"), (c % 11 == 0).alias("manual"), (c % 7 == 0).alias("touched"), (250 + F.col("o_custkey") % 50 * 10).alias("bars"))


def _signals(s, d):
    w = f.by("symbol", "date")
    x = _held(s, d)
    return x.select("symbol", "date", "ret", F.col("w").alias("cross"), F.signum(F.col("close") - F.lag("close", 10).over(w)).alias("momentum"), F.signum(F.lag("ret").over(w)).alias("last"))


def _traded(s, d):
    return _held(s, d).join(bars(s, d).select("symbol", "date", "volume"), ["symbol", "date"])


def _fills(s, d):
    price = 100 * (1 + F.col("l_discount").cast("double") - F.col("l_tax").cast("double"))
    k, q = F.col("l_orderkey"), F.col("l_quantity").cast("double")
    x = read(s, d, "lineitem").select(k.alias("order_id"), F.when(k % 2 == 0, 1).otherwise(-1).alias("side"), q.alias("qty"), price.alias("price"), F.lit(100.0).alias("arrival"), (100 + k % 5 - 2.0).alias("benchmark"), (q * 0.005).alias("commission"))
    return x.withColumn("requested", F.sum("qty").over(f.Window.partitionBy("order_id")) + F.col("order_id") % 4)


def _lots(s, d):
    price = F.round(100 * (1 + F.col("l_discount").cast("double") - F.col("l_tax").cast("double")), 6)
    return read(s, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(-1).alias("side"), F.col("l_quantity").cast("double").alias("qty"), price.alias("price"))


def _quarterly(s, d):
    t = F.col("o_orderdate").cast("date")
    return read(s, d, "orders").groupBy((F.col("o_custkey") % 40).alias("key"), (F.year(t) * 4 + F.quarter(t)).cast("long").alias("quarter")).agg(F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("value"))


def _zscore():
    w = f.by("symbol", "date").rowsBetween(-19, 0)
    return F.round((F.col("close") - F.avg("close").over(w)) / F.nullif(F.stddev_pop("close").over(w), F.lit(0.0)), 9)


def _weighted(df):
    return b.signal_weights(df, _zscore)


QUERIES = {
    "bootstrap_paths": lambda s, d: b.block_bootstrap(_clean(s, d), 20, 20).select("symbol", "path", "n", F.round("mean", 6).alias("mean"), F.round("sharpe", 4).alias("sharpe")),
    "bootstrap_interval": lambda s, d: b.bootstrap_interval(b.block_bootstrap(_clean(s, d), 20, 20)).select("symbol", "paths", *[F.round(c, 4).alias(c) for c in ("low", "mid", "high")]),
    "weight_shuffle": lambda s, d: _r(b.weight_shuffle(_held(s, d), 20), "symbol", "paths", actual="actual", p="p"),
    "noise_injection": lambda s, d: b.crossing_under_noise(bars(s, d), 10, 0.002, 5, 20).select("symbol", "samples", *[F.round(c, 4).alias(c) for c in ("low", "mid", "high")]),
    "scenario_replay": lambda s, d: _r(b.scenario_replay(_clean(s, d), CRASH, 50), "symbol", "n", total="total", fall="fall", stressed_total="stressed_total", stressed_fall="stressed_fall"),
    "withdrawals": lambda s, d: _r(b.withdrawals(_monthly(s, d), 24), "symbol", "starts", "worst_month", worst="worst", median="median"),
    "event_study": lambda s, d: _r(b.event_study(_events(s, d), [0.01, 0.03, 0.05], [1.0, 1.5], [1, 5, 10]), "threshold", "multiple", "horizon", "events", mean="mean", win_rate="win_rate"),
    "market_sweep": lambda s, d: _r(b.market_sweep(_costed(s, d), F.col("symbol") % 7), "market", "n", "passed", mean="mean", sharpe="sharpe", spread="spread"),
    "trial_pressure": lambda s, d: _r(b.trial_pressure(_ledger(s, d)), "run", "strategies", "trials", "manual", "touched", pressure="pressure"),
    "signal_attribution": lambda s, d: _r(b.signal_attribution(_signals(s, d), ["cross", "momentum", "last"]), "symbol", "signal", "rank", total="total", contribution="contribution"),
    "benchmark_pack": lambda s, d: _r(b.benchmark_pack(_costed(s, d), 0.02), "symbol", "baseline", "n", "verdict", ret="ret", vol="vol", sharpe="sharpe", excess="excess", edge="edge"),
    "cost_components": lambda s, d: _r(b.cost_components(_held(s, d), COSTS), "symbol", "component", turnover="turnover", drag="drag"),
    "capacity_curve": lambda s, d: _r(b.capacity_curve(_traded(s, d), AMOUNTS, 0.1), "symbol", "amount", "within", sharpe="sharpe"),
    "execution_costs": lambda s, d: _r(b.execution_costs(_fills(s, d)), "order_id", *[F.round(c, 9).alias(c) for c in ("vwap", "effective", "realised")], **{c: c for c in ("filled", "slippage", "opportunity", "commission", "unfilled")}),
    "fifo_gains": lambda s, d: _r(b.fifo_gains(_lots(s, d)), "symbol", **{c: c for c in ("excess", "matched", "short_gain", "long_gain")}),
    "page_hinkley": lambda s, d: b.page_hinkley(_clean(s, d), "ret", 0.0005, 0.2).select("symbol", "date", F.round("statistic", 6).alias("statistic"), (F.round("statistic", 6) > 0.2).alias("alarm")),
    "distribution_shift": lambda s, d: _r(b.distribution_shift(_clean(s, d), "ret", F.col("date") >= "1996-01-01"), "symbol", "n_reference", "n_recent", kl="kl", outside="outside"),
    "quarterly_surprises": lambda s, d: _r(b.surprises(_quarterly(s, d)), "key", "quarter", "streak", value="value", change="change", surprise="surprise"),
    "signal_weights": lambda s, d: _r(_weighted(bars(s, d)), "symbol", "date", w="w"),
    "causality": lambda s, d: b.causality(bars(s, d), _weighted, "1996-01-01"),
}

_H = lambda *parts: f"CAST('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 8) AS BIGINT)"
_BOOT = f"""{_CLEAN}, xi AS (SELECT symbol, coalesce(ret, 0) AS r, row_number() OVER ({_V}) - 1 AS i FROM x), sz AS (SELECT symbol, count(*) AS n FROM xi GROUP BY symbol),
dr AS (SELECT symbol, n, path, unnest(range(0, CAST(ceil(n / 20.0) AS BIGINT))) AS k FROM sz, (SELECT unnest(range(1, 21)) AS path)),
ps AS (SELECT *, unnest(range(0, least(20, n - k * 20))) AS o FROM dr), at_ AS (SELECT symbol, n, path, ({_H("'7'", "symbol", "path", "k")} % n + o) % n AS i FROM ps),
bt AS (SELECT symbol, CAST(path AS INT) AS path, max(n) AS n, avg(r) AS mean, CASE WHEN stddev_pop(r) > 1e-12 THEN avg(r) / stddev_pop(r) * sqrt(252) ELSE 0 END AS sharpe FROM at_ JOIN xi USING (symbol, i) GROUP BY symbol, path)"""
_SH = lambda c: f"CASE WHEN stddev_pop({c}) > 1e-12 THEN avg({c}) / stddev_pop({c}) * sqrt(252) ELSE 0 END"
_UNIT = lambda c: f"(({_H(c, 'symbol', 'date', 'sample')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
_DRAW = lambda r: f"min(v{r} / greatest(1, m{r}) - 1)"
_SIDE = "CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END"
_PRICE = "100 * (1 + CAST(l_discount AS DOUBLE) - CAST(l_tax AS DOUBLE))"
_GRID = ", ".join(f"({t}::DOUBLE, {m}::DOUBLE, {h})" for t in (0.01, 0.03, 0.05) for m in (1.0, 1.5) for h in (1, 5, 10))
_NETS = f"{_NET}, cn AS (SELECT nt.symbol, nt.date, x.ret, round(net, 9) AS net FROM nt JOIN x USING (symbol, date))"
_W20 = "PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW"

ORACLE = {
    "bootstrap_paths": f"WITH {_BOOT} SELECT symbol, path, n, round(mean, 6) AS mean, round(sharpe, 4) AS sharpe FROM bt",
    "bootstrap_interval": f"WITH {_BOOT} SELECT symbol, count(*) AS paths, round(quantile_cont(sharpe, 0.05), 4) AS low, round(quantile_cont(sharpe, 0.5), 4) AS mid, round(quantile_cont(sharpe, 0.95), 4) AS high FROM bt GROUP BY symbol",
    "weight_shuffle": f"""WITH {_HELD}, xi AS (SELECT symbol, coalesce(w, 0) AS w, coalesce(ret, 0) AS r, row_number() OVER ({_V}) AS i FROM h),
sh AS (SELECT symbol, path, w, row_number() OVER (PARTITION BY symbol, path ORDER BY {_H("'7'", "symbol", "path", "i")}, i) AS i FROM xi, (SELECT unnest(range(1, 21)) AS path)),
v AS (SELECT symbol, path, round(sum(sh.w * xi.r), 9) AS v FROM sh JOIN xi USING (symbol, i) GROUP BY symbol, path), a AS (SELECT symbol, round(sum(w * r), 9) AS actual FROM xi GROUP BY symbol)
SELECT symbol, count(*) AS paths, round(max(actual), 6) AS actual, round(avg(CASE WHEN v >= actual THEN 1 ELSE 0 END), 6) AS p FROM v JOIN a USING (symbol) GROUP BY symbol""",
    "noise_injection": f"""WITH {BARS_SQL}, n AS (SELECT symbol, date, sample, greatest(1e-9, close * (1 + 0.002::DOUBLE * sqrt(-2 * ln({_UNIT("'7a'")})) * cos(2 * pi() * {_UNIT("'7b'")}))) AS close FROM bars, (SELECT unnest(range(1, 11)) AS sample)),
w AS (SELECT *, CASE WHEN count(*) OVER b = 20 THEN sign(round(avg(close) OVER a - avg(close) OVER b, 9)) ELSE 0 END AS w, close / lag(close) OVER o - 1 AS r FROM n
WINDOW o AS (PARTITION BY symbol, sample ORDER BY date), a AS (PARTITION BY symbol, sample ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol, sample ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
g AS (SELECT symbol, sample, coalesce(lag(w) OVER (PARTITION BY symbol, sample ORDER BY date) * r, 0) AS g FROM w), s AS (SELECT symbol, sample, {_SH("g")} AS sharpe FROM g GROUP BY symbol, sample)
SELECT symbol, count(*) AS samples, round(quantile_cont(sharpe, 0.05), 4) AS low, round(quantile_cont(sharpe, 0.5), 4) AS mid, round(quantile_cont(sharpe, 0.95), 4) AS high FROM s GROUP BY symbol""",
    "scenario_replay": f"""WITH {_CLEAN}, i AS (SELECT symbol, date, coalesce(ret, 0) AS r0, row_number() OVER ({_V}) - 51 AS k FROM x),
j AS (SELECT symbol, date, r0, CASE k {" ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in enumerate(CRASH))} ELSE r0 END AS r1 FROM i),
v AS (SELECT *, exp(sum(ln(1 + r0)) OVER u) AS v0, exp(sum(ln(1 + r1)) OVER u) AS v1 FROM j WINDOW u AS ({_V} ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, max(v0) OVER u AS m0, max(v1) OVER u AS m1 FROM v WINDOW u AS ({_V} ROWS UNBOUNDED PRECEDING))
SELECT symbol, count(*) AS n, round(exp(sum(ln(1 + r0))) - 1, 6) AS total, round({_DRAW(0)}, 6) AS fall, round(exp(sum(ln(1 + r1))) - 1, 6) AS stressed_total, round({_DRAW(1)}, 6) AS stressed_fall FROM m GROUP BY symbol""",
    "withdrawals": f"""WITH {_CLEAN}, mo AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, exp(sum(ln(1 + ret))) - 1 AS ret FROM x WHERE ret IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY month) AS k FROM mo), pr AS (SELECT a.symbol, a.month, a.k, b.k AS j, product(1 + c.ret) AS p FROM k a JOIN k b ON a.symbol = b.symbol AND b.k BETWEEN a.k AND a.k + 23 JOIN k c ON c.symbol = a.symbol AND c.k BETWEEN a.k AND b.k GROUP BY ALL),
s AS (SELECT symbol, month, round(1 / sum(1 / p), 9) AS rate FROM pr GROUP BY symbol, month HAVING count(*) = 24)
SELECT symbol, count(*) AS starts, arg_min(month, (rate, month)) AS worst_month, round(min(rate), 6) AS worst, round(quantile_cont(rate, 0.5), 6) AS median FROM s GROUP BY symbol""",
    "event_study": f"""WITH {_CLEAN}, y AS (SELECT symbol, date, ret, close, CASE WHEN count(*) OVER ({_W20}) = 20 THEN volume / avg(volume) OVER ({_W20}) END AS busy, row_number() OVER ({_V}) AS i FROM x),
g(threshold, multiple, horizon) AS (VALUES {_GRID}), e AS (SELECT g.*, b.close / a.close - 1 AS fwd FROM y a JOIN g ON a.ret >= g.threshold AND a.busy >= g.multiple JOIN y b ON b.symbol = a.symbol AND b.i = a.i + g.horizon)
SELECT threshold, multiple, horizon, count(*) AS events, round(avg(fwd), 6) AS mean, round(avg(CASE WHEN fwd > 0 THEN 1 ELSE 0 END), 6) AS win_rate FROM e GROUP BY ALL""",
    "market_sweep": f"WITH {_NETS}, g AS (SELECT symbol % 7 AS market, count(*) AS n, avg(net) AS mean, round({_SH('net')}, 9) AS sharpe FROM cn GROUP BY 1) SELECT market, n, sharpe > 0 AS passed, round(mean, 6) AS mean, round(sharpe, 6) AS sharpe, round(max(sharpe) OVER () - sharpe, 6) AS spread FROM g",
    "trial_pressure": "SELECT o_custkey % 50 AS run, count(DISTINCT o_orderpriority || '/' || o_orderstatus) AS strategies, count(*) AS trials, count(*) FILTER (o_orderkey % 11 = 0) AS manual, count(*) FILTER (o_orderkey % 7 = 0) AS touched, round(count(*) / max(250 + o_custkey % 50 * 10), 6) AS pressure FROM orders GROUP BY 1",
    "signal_attribution": f"""WITH {_HELD}, s AS (SELECT symbol, coalesce(ret, 0) AS r, w AS a, coalesce(sign(close - lag(close, 10) OVER ({_V})), 0) AS b, coalesce(sign(lag(ret) OVER ({_V})), 0) AS c FROM h),
t AS (SELECT symbol, sum((a + b + c) / 3.0::DOUBLE * r) AS total, sum((b + c) / 2.0::DOUBLE * r) AS a, sum((a + c) / 2.0::DOUBLE * r) AS b, sum((a + b) / 2.0::DOUBLE * r) AS c FROM s GROUP BY symbol),
u AS (SELECT symbol, 'cross' AS signal, total, round(total - a, 9) AS contribution FROM t UNION ALL SELECT symbol, 'momentum', total, round(total - b, 9) FROM t UNION ALL SELECT symbol, 'last', total, round(total - c, 9) FROM t)
SELECT symbol, signal, CAST(row_number() OVER (PARTITION BY symbol ORDER BY contribution DESC, signal) AS INT) AS rank, round(total, 6) AS total, round(contribution, 6) AS contribution FROM u""",
    "benchmark_pack": f"""WITH {_NETS}, k AS (SELECT date, avg(ret) AS basket FROM cn WHERE ret IS NOT NULL GROUP BY date), y AS (SELECT * FROM cn JOIN k USING (date) WHERE ret IS NOT NULL),
l AS (SELECT symbol, 'strategy' AS baseline, net AS r FROM y UNION ALL SELECT symbol, 'hold', ret FROM y UNION ALL SELECT symbol, 'cash', 0.02::DOUBLE / 252 FROM y UNION ALL SELECT symbol, 'basket', basket FROM y),
g AS (SELECT symbol, baseline, count(*) AS n, avg(r) * 252 AS ret, stddev_pop(r) * sqrt(252) AS vol FROM l GROUP BY 1, 2), q AS (SELECT *, round(CASE WHEN vol > 1e-9 THEN ret / vol ELSE 0 END, 9) AS sharpe FROM g)
SELECT a.symbol, a.baseline, a.n, CASE WHEN o.sharpe > a.sharpe THEN 'beats' ELSE 'trails' END AS verdict, round(a.ret, 6) AS ret, round(a.vol, 6) AS vol, round(a.sharpe, 6) AS sharpe, round(o.ret - a.ret, 6) AS excess, round(o.sharpe - a.sharpe, 6) AS edge
FROM q a JOIN q o ON a.symbol = o.symbol AND o.baseline = 'strategy' WHERE a.baseline <> 'strategy'""",
    "cost_components": f"""WITH {_HELD}, t AS (SELECT symbol, sum(abs(w - held)) / count(*) * 252 AS turnover FROM c GROUP BY symbol), k(component, bps) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in COSTS.items())})
SELECT symbol, component, round(turnover, 6) AS turnover, round(turnover * bps / 1e4, 6) AS drag FROM t, k""",
    "capacity_curve": f"""WITH {_HELD}, y AS (SELECT c.symbol, c.date, held * r0 AS g, abs(w - held) AS t, CASE WHEN count(*) OVER v = 20 THEN avg(bars.close * volume) OVER v END AS day FROM c JOIN bars USING (symbol, date) WINDOW v AS ({_W20.replace('symbol', 'c.symbol').replace('ORDER BY date', 'ORDER BY c.date')})),
k(amount) AS (VALUES {", ".join(f"({a}::DOUBLE)" for a in AMOUNTS)}), n AS (SELECT symbol, amount, g - t * 0.1::DOUBLE * coalesce(amount * t / day, 0) AS net FROM y, k), s AS (SELECT symbol, amount, round({_SH("net")}, 9) AS sharpe FROM n GROUP BY 1, 2),
f AS (SELECT *, sharpe < lag(sharpe) OVER (PARTITION BY symbol ORDER BY amount) AS fell FROM s)
SELECT symbol, amount, NOT coalesce(bool_or(fell) OVER (PARTITION BY symbol ORDER BY amount), false) AS within, round(sharpe, 6) AS sharpe FROM f""",
    "execution_costs": f"""WITH f AS (SELECT l_orderkey AS order_id, max({_SIDE}) AS side, sum(CAST(l_quantity AS DOUBLE)) AS filled, sum(CAST(l_quantity AS DOUBLE) * {_PRICE}) AS paid, sum(CAST(l_quantity AS DOUBLE) * {_PRICE}) / sum(CAST(l_quantity AS DOUBLE)) AS vwap, sum(CAST(l_quantity AS DOUBLE) * 0.005::DOUBLE) AS commission FROM lineitem GROUP BY 1)
SELECT order_id, round(filled, 6) AS filled, round(vwap, 9) AS vwap, round(2 * abs(vwap - 100), 9) AS effective, round(2 * (vwap - (98 + order_id % 5)) * side, 9) + 0.0::DOUBLE AS realised, round((paid - 100 * filled) * side, 6) + 0.0::DOUBLE AS slippage,
round((order_id % 5 - 2.0::DOUBLE) * side * (order_id % 4), 6) + 0.0::DOUBLE AS opportunity, round(commission, 6) AS commission, round(CAST(order_id % 4 AS DOUBLE), 6) AS unfilled FROM f""",
    "fifo_gains": f"""WITH t AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_orderkey * 10 + l_linenumber AS seq, {_SIDE} AS side, CAST(l_quantity AS DOUBLE) AS qty, round({_PRICE}, 6) AS price FROM lineitem),
n AS (SELECT *, sum(side * qty) OVER o AS net FROM t WINDOW o AS (PARTITION BY symbol ORDER BY date, seq ROWS UNBOUNDED PRECEDING)), l AS (SELECT *, least(0, min(net) OVER (PARTITION BY symbol ORDER BY date, seq ROWS UNBOUNDED PRECEDING)) AS low FROM n),
e AS (SELECT *, CASE WHEN side < 0 THEN lag(low, 1, 0) OVER (PARTITION BY symbol ORDER BY date, seq) - low ELSE 0 END AS excess FROM l),
c AS (SELECT *, qty - excess AS q, sum(qty - excess) OVER (PARTITION BY symbol, side ORDER BY date, seq ROWS UNBOUNDED PRECEDING) AS hi FROM e),
m AS (SELECT b.symbol, least(b.hi, s.hi) - greatest(b.hi - b.q, s.hi - s.q) AS n, s.price - b.price AS gain, s.date - b.date AS days FROM c b JOIN c s ON b.symbol = s.symbol AND b.side > 0 AND s.side < 0 AND b.hi > s.hi - s.q AND s.hi > b.hi - b.q),
g AS (SELECT symbol, sum(n) AS matched, sum(n * gain) FILTER (days <= 365) AS short_gain, sum(n * gain) FILTER (days > 365) AS long_gain FROM m WHERE n > 0 GROUP BY symbol), w AS (SELECT symbol, sum(excess) AS excess FROM e GROUP BY symbol)
SELECT symbol, round(excess, 6) AS excess, round(coalesce(matched, 0), 6) AS matched, round(coalesce(short_gain, 0), 6) AS short_gain, round(coalesce(long_gain, 0), 6) AS long_gain FROM w LEFT JOIN g USING (symbol)""",
    "page_hinkley": f"""WITH RECURSIVE {_CLEAN}, i AS (SELECT symbol, date, ret, row_number() OVER ({_V}) AS i, avg(ret) OVER ({_V} ROWS UNBOUNDED PRECEDING) AS m FROM x WHERE ret IS NOT NULL),
r AS (SELECT symbol, date, i, 0.0::DOUBLE AS ph FROM i WHERE i = 1 UNION ALL SELECT i.symbol, i.date, i.i, greatest(0, r.ph + i.ret - i.m - 0.0005::DOUBLE) FROM r JOIN i ON i.symbol = r.symbol AND i.i = r.i + 1)
SELECT symbol, date, round(ph, 6) AS statistic, round(ph, 6) > 0.2 AS alarm FROM r""",
    "distribution_shift": f"""WITH {_CLEAN}, y AS (SELECT symbol, ret AS v, date >= '1996-01-01' AS recent FROM x WHERE ret IS NOT NULL), e AS (SELECT symbol, min(v) FILTER (NOT recent) AS a, max(v) FILTER (NOT recent) AS b FROM y GROUP BY symbol),
k AS (SELECT y.*, a, b, CAST(greatest(0, least(9, floor(round((v - a) / (b - a) * 10, 9)))) AS INT) AS bin FROM y JOIN e USING (symbol) WHERE b > a),
f AS (SELECT s.symbol, t.bin, count(k.v) FILTER (NOT recent) AS q, count(k.v) FILTER (recent) AS p FROM (SELECT DISTINCT symbol FROM k) s, (SELECT unnest(range(0, 10)) AS bin) t LEFT JOIN k ON k.symbol = s.symbol AND k.bin = t.bin GROUP BY 1, 2),
z AS (SELECT *, (p + 0.5::DOUBLE) / (sum(p) OVER (PARTITION BY symbol) + 5) AS ps, (q + 0.5::DOUBLE) / (sum(q) OVER (PARTITION BY symbol) + 5) AS qs FROM f), d AS (SELECT symbol, sum(ps * ln(ps / qs)) AS kl FROM z GROUP BY symbol),
o AS (SELECT symbol, count(*) FILTER (NOT recent) AS n_reference, count(*) FILTER (recent) AS n_recent, count(*) FILTER (recent AND (v < a OR v > b)) AS out FROM k GROUP BY symbol)
SELECT symbol, n_reference, n_recent, round(kl, 6) AS kl, round(out / nullif(n_recent, 0), 6) AS outside FROM d JOIN o USING (symbol)""",
    "quarterly_surprises": """WITH q AS (SELECT o_custkey % 40 AS key, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS BIGINT) AS quarter, round(sum(CAST(o_totalprice AS DOUBLE)), 2) AS value FROM orders GROUP BY 1, 2),
c AS (SELECT a.*, a.value - b.value AS change FROM q a LEFT JOIN q b ON a.key = b.key AND b.quarter = a.quarter - 4),
s AS (SELECT *, CASE WHEN count(change) OVER p = 8 THEN (change - avg(change) OVER p) / nullif(stddev_samp(change) OVER p, 0) END AS surprise, max(CASE WHEN change > 0 THEN NULL ELSE i END) OVER (PARTITION BY key ORDER BY i) AS stop
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY quarter) AS i FROM c) WINDOW p AS (PARTITION BY key ORDER BY i ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT key, quarter, least(8, i - coalesce(stop, 0)) AS streak, round(value, 6) AS value, round(change, 6) AS change, round(surprise, 6) AS surprise FROM s""",
    "signal_weights": f"WITH {BARS_SQL}, z AS (SELECT symbol, date, round((close - avg(close) OVER {_N(20)}) / nullif(stddev_pop(close) OVER {_N(20)}, 0), 9) AS z FROM bars) SELECT symbol, date, round(CASE WHEN z IS NULL THEN 0 ELSE greatest(-1, least(1, z)) END, 6) AS w FROM z",
    "causality": f"WITH {BARS_SQL} SELECT symbol, count(*) AS checked, CAST(0 AS BIGINT) AS changed FROM bars WHERE date <= '1996-01-01' GROUP BY symbol",
}
