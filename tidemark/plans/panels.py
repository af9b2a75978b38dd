"""Risk, attribution and validation queries over the return panel and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import episodes, pairs
from tidemark.operators import features as f
from tidemark.operators import panels as p
from tidemark.plans.market import _r
from tidemark.plans.research import _CLEAN, _N, _V, _clean
from tidemark.sources.derived import bars, read

GRID = [(2, 10), (5, 20), (5, 50), (10, 50)]
SCENARIOS = [("base", 1.0, 1.0), ("dear", 3.0, 1.0), ("weak", 1.0, 0.5)]


def _held(s, d):
    x = f.cross_signal(_clean(s, d), 5, 20)
    return x.select("symbol", "date", "close", "ret", F.col("w").cast("double").alias("w"))


def _market(s, d):
    return p.market_of(_clean(s, d)).withColumn("market", F.round("market", 9))


def sma_cross(s, d):
    """A moving-average crossing of every symbol after costs: the metrics of its net returns."""
    return _r(p.metric_suite(p.costed_returns(_held(s, d), 2.0)), "symbol", "n", **{c: c for c in ("final", "sharpe", "sortino", "win_rate", "profit_factor")})


def _brinson(s, d):
    x = _held(s, d).withColumn("category", F.col("symbol") % 5).where("ret is not null")
    g = x.groupBy("date", "category").agg(F.sum("w").alias("wp"), F.count("*").cast("double").alias("wb"), F.avg(F.col("ret") * F.col("w")).alias("rp"), F.avg("ret").alias("rb"))
    n = F.sum("wb").over(p.Window.partitionBy("date"))
    return g.withColumns({"wp": F.col("wp") / n, "wb": F.col("wb") / n})


def _tests(s, d):
    g = _clean(s, d).groupBy("symbol").agg(F.avg("ret").alias("m"), F.stddev("ret").alias("sd"), F.count("ret").alias("n"))
    return g.select("symbol", F.round(F.exp(-F.abs(F.col("m") / F.col("sd") * F.sqrt("n"))), 9).alias("p"))


def _pnl(s, d):
    return _clean(s, d).select("symbol", "date", F.round(F.coalesce("ret", F.lit(0.0)) * 1000, 6).alias("pnl"))


def _slips(s, d):
    l = read(s, d, "lineitem")  # noqa: E741
    return l.select(F.col("l_suppkey").alias("symbol"), (F.col("l_quantity").cast("double") / 1000).alias("share"), (F.col("l_discount").cast("double") * 100 + F.col("l_quantity").cast("double") / 10).alias("bps"))


def _bonds(s, d):
    x = read(s, d, "part")
    return x.select(F.col("p_partkey").alias("bond"), (F.col("p_size") / 1000).alias("coupon"), (F.col("p_partkey") % 29 + 1).cast("int").alias("term"), (0.01 + F.col("p_partkey") % 7 / 100).alias("yield"))


def _LATE():
    return F.col("date") >= "1996-01-01"

def _books(s, d):
    """Five portfolios of small crossing weights; a symbol has no row while its weight is 0."""
    return _held(s, d).where("w != 0").select((F.col("symbol") % 5).alias("portfolio"), "symbol", "date", (F.col("w") * 0.02).alias("w"), "ret")


QUERIES = {
    "sma_cross_metrics": sma_cross,
    "costed_returns": lambda s, d: _r(p.costed_returns(_held(s, d), 2.0, 0.03), "symbol", "date", net="net"),
    "metric_suite": lambda s, d: _r(p.metric_suite(p.costed_returns(_held(s, d), 2.0, 0.03)), "symbol", "n", **{c: c for c in ("final", "cagr", "mdd", "calmar", "sharpe", "sortino", "skew", "kurtosis", "win_rate", "profit_factor")}),
    "return_metrics": lambda s, d: _r(p.return_metrics(_clean(s, d)), "symbol", "n", **{c: c for c in ("compounded", "mean", "geometric", "exposure", "volatility")}),
    "drawdown_risk": lambda s, d: _r(p.drawdown_risk(_clean(s, d)), "symbol", **{c: c for c in ("ulcer", "pain", "martin", "pain_ratio", "recovery")}),
    "ratio_metrics": lambda s, d: _r(p.ratio_metrics(_clean(s, d)), "symbol", **{c: c for c in ("sharpe", "sortino", "omega", "gain_pain", "upside", "smart_sharpe", "rho")}),
    "concentration": lambda s, d: _r(p.concentration(_clean(s, d)), "symbol", gini="gini", ruin="ruin"),
    "outlier_ratios": lambda s, d: _r(p.outlier_ratios(_clean(s, d)), "symbol", wins="wins", losses="losses"),
    "yearly_returns": lambda s, d: _r(p.yearly(_clean(s, d)), "symbol", "year", ret="ret", best="best", worst="worst", win_rate="win_rate"),
    "rolling_correlation": lambda s, d: p.rolling_correlation(_clean(s, d), _market(s, d), 60).select("symbol", "date", F.round("corr", 3).alias("corr"), F.round("beta", 3).alias("beta")),
    "market_regression": lambda s, d: _r(p.regression(_clean(s, d), _market(s, d)), "symbol", "n", **{c: c for c in ("beta", "alpha", "r2", "tracking", "information", "idiosyncratic")}),
    "coskewness": lambda s, d: _r(p.coskewness(_clean(s, d), _market(s, d)), "symbol", coskewness="coskewness"),
    "portfolio_returns": lambda s, d: _r(p.portfolio_returns(p.capped_weights(_held(s, d), 1.0, 0.3)), "date", ret="ret", gross="gross", turnover="turnover"),
    "contributions": lambda s, d: _r(p.contributions(_held(s, d), F.col("symbol") % 7), "grp", "n", contribution="contribution", share="share"),
    "brinson": lambda s, d: _r(p.brinson(_brinson(s, d)), "date", "category", allocation="allocation", selection="selection", interaction="interaction"),
    "covariances": lambda s, d: _r(pairs.covariances(_clean(s, d)), "a", "b", "n", cov="cov", corr="corr"),
    "shrunk_covariances": lambda s, d: _r(p.shrunk(pairs.covariances(_clean(s, d)), 0.2, pairs.variances(_clean(s, d))), "a", "b", cov="cov"),
    "pair_similarity": lambda s, d: _r(p.pair_similarity(pairs.covariances(_clean(s, d)), 0.05), "a", "b", "n", "duplicate", corr="corr"),
    "expected_shortfall": lambda s, d: _r(p.expected_shortfall(_clean(s, d), [0.01, 0.05]), "symbol", "level", var="var", es="es"),
    "stressed_quantile": lambda s, d: _r(p.stressed_quantile(_clean(s, d), "1995-01-01", "1995-12-31", 0.05), "symbol", "n", quantile="quantile"),
    "regime_metrics": lambda s, d: _r(p.regime_metrics(_clean(s, d), F.quarter("date")), "symbol", "state", "n", mean="mean", deviation="deviation", sharpe="sharpe"),
    "cost_scenarios": lambda s, d: _r(p.scenarios(_held(s, d), SCENARIOS, 2.0), "symbol", "scenario", total="total", deviation="deviation"),
    "variant_screen": lambda s, d: _r(p.variant_screen(_clean(s, d), GRID, 2.0), "fast", "slow", "n", mean="mean", deviation="deviation"),
    "purged_folds": lambda s, d: p.purged_folds(_clean(s, d), 5, 10, 5),
    "split_combinations": lambda s, d: _r(p.split_combinations(_clean(s, d), 6), "combo", "best", F.col("rank").cast("long").alias("rank"), "n", logit="logit"),
    "adjusted_p": lambda s, d: _r(p.benjamini_hochberg(_tests(s, d), "p", "symbol"), "symbol", "p", q="q"),
    "tail_blocks": lambda s, d: _r(p.tail_blocks(_clean(s, d), 0.02, 10), "symbol", "date", "rank", total="total"),
    "chow_test": lambda s, d: _r(p.chow(_clean(s, d), "1996-01-01"), "symbol", "n", f="f"),
    "tail_dependence": lambda s, d: _r(pairs.tail_dependence(_clean(s, d), 0.1), "a", "b", "n", lower="lower", upper="upper"),
    "welch_test": lambda s, d: _r(p.welch(_clean(s, d), _LATE()), "symbol", "n1", "n0", t="t", freedom="freedom"),
    "circuit_breaker": lambda s, d: _r(p.breaker(_pnl(s, d), 1000.0, 0.1, 0.15), "symbol", "date", "state", day="day", week="week"),
    "ks_windows": lambda s, d: _r(p.ks_windows(_clean(s, d), 50, ~_LATE()), "symbol", "window", d="d"),
    "slippage_fit": lambda s, d: _r(p.slippage_fit(_slips(s, d)), "symbol", "n", slope="slope", intercept="intercept", advice="advice"),
    "bond_table": lambda s, d: _r(p.bond_table(_bonds(s, d), 30), "bond", price="price", duration="duration", convexity="convexity"),
    "risk_measures": lambda s, d: p.risk_measures(_clean(s, d)).select("symbol", "n", *[F.round(c, 9).alias(c) for c in ("variance", "semi_variance", "cvar", "max_drawdown", "mean_drawdown")]),
    "net_of_turnover": lambda s, d: _r(p.net_of_turnover(_books(s, d), 5.0), "portfolio", "n", gross_return="gross_return", net_return="net_return", turnover="turnover", cost="cost"),
    "walk_forward_metrics": lambda s, d: _r(p.walk_forward_metrics(p.costed_returns(_held(s, d), 2.0).select("symbol", "date", F.round("net", 9).alias("net")), episodes.walk_forward(bars(s, d), 5, 0.5)), "symbol", "fold", "n_rows", "passed", "reason", "place", "n_passed", cagr="cagr", mdd="mdd", calmar="calmar", sharpe="sharpe"),
}

_HELD = f"{_CLEAN}, h AS (SELECT symbol, date, close, ret, CAST(CASE WHEN count(close) OVER {_N(20)} = 20 THEN sign(avg(close) OVER {_N(5)} - avg(close) OVER {_N(20)}) ELSE 0 END AS DOUBLE) AS w FROM x), c AS (SELECT *, coalesce(lag(w) OVER ({_V}), 0) AS held, coalesce(ret, 0) AS r0 FROM h)"
_NET = f"{_HELD}, nt AS (SELECT symbol, date, held * r0 - abs(w - held) * 2 / 1e4 - abs(least(held, 0)) * 0.03::DOUBLE / 252 AS net FROM c)"
_MARKET = f"{_CLEAN}, mk AS (SELECT date, round(avg(ret), 9) AS market FROM x WHERE ret IS NOT NULL GROUP BY date), xm AS (SELECT x.*, market FROM x JOIN mk USING (date) WHERE ret IS NOT NULL)"
_DDS = f"{_CLEAN}, e AS (SELECT symbol, date, coalesce(ret, 0) AS r0, exp(sum(ln(1 + coalesce(ret, 0))) OVER ({_V} ROWS UNBOUNDED PRECEDING)) AS v FROM x), dd AS (SELECT *, v / max(v) OVER ({_V} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)"
_PAIRS = f"{_CLEAN}, y AS (SELECT * FROM x WHERE ret IS NOT NULL), pr AS (SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, covar_samp(a.ret, b.ret) AS c, stddev_samp(a.ret) AS sa, stddev_samp(b.ret) AS sb FROM y a JOIN y b ON a.date = b.date AND a.symbol <= b.symbol GROUP BY 1, 2 HAVING count(*) >= 20)"
_SHARPE = lambda side: f"(sum(s) FILTER ({side}) / sum(n) FILTER ({side})) / nullif(sqrt(sum(q) FILTER ({side}) / sum(n) FILTER ({side}) - pow(sum(s) FILTER ({side}) / sum(n) FILTER ({side}), 2)), 0)"
_FOLDS = "\nUNION ALL ".join(
    f"SELECT symbol, CAST({k} AS INT) AS fold, count(*) FILTER (fold = {k}) AS n_test, count(*) FILTER (NOT (fold = {k} OR (least(i + 10, n - 1) > {k} * size AND i <= hi{k}) OR (i > hi{k} AND i <= hi{k} + 5)"
    + "".join(f" OR (i >= {o} * size - 5 AND i < {o} * size) OR (i > hi{o} AND i <= hi{o} + 5)" for o in range(5) if o != k)
    + ")) AS n_train FROM fo GROUP BY symbol"
    for k in range(5)
)

_NET0 = f"{_HELD}, nt AS (SELECT symbol, date, held * r0 - abs(w - held) * 2 / 1e4 AS net FROM c)"

ORACLE = {
    "sma_cross_metrics": f"""WITH {_NET0}, q AS (SELECT symbol, count(*) AS n, exp(sum(ln(1 + net))) AS final, avg(net) AS mu, stddev_pop(net) AS sd, CASE WHEN count(*) FILTER (net < 0) > 1 THEN stddev_pop(net) FILTER (net < 0) ELSE stddev_pop(net) END AS ds, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS wr, sum(greatest(net, 0)) AS gw, sum(least(net, 0)) AS gl FROM nt GROUP BY symbol)
SELECT symbol, n, round(final, 6) AS final, round(CASE WHEN sd > 1e-12 THEN mu / sd * sqrt(252) ELSE 0 END, 6) AS sharpe, round(CASE WHEN ds > 1e-12 THEN mu / ds * sqrt(252) ELSE 0 END, 6) AS sortino, round(wr, 6) AS win_rate, round(CASE WHEN gl < 0 THEN gw / -gl ELSE 0 END, 6) AS profit_factor FROM q""",
    "costed_returns": f"WITH {_NET} SELECT symbol, date, round(net, 6) AS net FROM nt",
    "metric_suite": f"""WITH {_NET}, e AS (SELECT *, exp(sum(ln(1 + net)) OVER ({_V} ROWS UNBOUNDED PRECEDING)) AS v FROM nt), g AS (SELECT *, v / max(v) OVER ({_V} ROWS UNBOUNDED PRECEDING) - 1 AS dd, avg(net) OVER q AS mu, stddev_pop(net) OVER q AS sd FROM e WINDOW q AS (PARTITION BY symbol)),
s AS (SELECT symbol, count(*) AS n, exp(sum(ln(1 + net))) AS final, min(dd) AS mdd, max(mu) AS mu, max(sd) AS sd, CASE WHEN count(*) FILTER (net < 0) > 1 THEN stddev_pop(net) FILTER (net < 0) ELSE max(sd) END AS ds, avg(pow((net - mu) / nullif(sd, 0), 3)) AS k3, avg(pow((net - mu) / nullif(sd, 0), 4)) AS k4, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS wr, sum(greatest(net, 0)) AS gw, sum(least(net, 0)) AS gl FROM g GROUP BY symbol), z AS (SELECT *, pow(final, 252.0 / n) - 1 AS cg FROM s)
SELECT symbol, n, round(final, 6) AS final, round(cg, 6) AS cagr, round(mdd, 6) AS mdd, round(cg / nullif(-mdd, 0), 6) AS calmar, round(CASE WHEN sd > 1e-12 THEN mu / sd * sqrt(252) ELSE 0 END, 6) AS sharpe, round(CASE WHEN ds > 1e-12 THEN mu / ds * sqrt(252) ELSE 0 END, 6) AS sortino, round(CASE WHEN sd > 1e-12 THEN k3 ELSE 0 END, 6) AS skew, round(CASE WHEN sd > 1e-12 THEN k4 ELSE 0 END, 6) AS kurtosis, round(wr, 6) AS win_rate, round(CASE WHEN gl < 0 THEN gw / -gl ELSE 0 END, 6) AS profit_factor FROM z""",
    "return_metrics": f"WITH {_CLEAN} SELECT symbol, count(ret) AS n, round(exp(sum(ln(1 + ret))) - 1, 6) AS compounded, round(avg(ret), 6) AS mean, round(exp(avg(ln(1 + ret))) - 1, 6) AS geometric, round(avg(CASE WHEN ret <> 0 THEN 1.0 WHEN ret = 0 THEN 0.0 END), 6) AS exposure, round(stddev_samp(ret) * sqrt(252), 6) AS volatility FROM x GROUP BY symbol",
    "drawdown_risk": f"WITH {_DDS}, s AS (SELECT symbol, sqrt(avg(dd * dd)) AS u, -avg(dd) AS pn, min(dd) AS m, exp(sum(ln(1 + r0))) AS fv, count(*) AS n FROM dd GROUP BY symbol) SELECT symbol, round(u, 6) AS ulcer, round(pn, 6) AS pain, round((pow(fv, 252.0 / n) - 1) / nullif(u, 0), 6) AS martin, round((pow(fv, 252.0 / n) - 1) / nullif(pn, 0), 6) AS pain_ratio, round((fv - 1) / nullif(-m, 0), 6) AS recovery FROM s",
    "ratio_metrics": f"WITH {_CLEAN}, l AS (SELECT symbol, ret AS e, lag(ret) OVER ({_V}) AS p FROM x), g AS (SELECT symbol, avg(e) AS m, stddev_samp(e) AS sd, sqrt(sum(pow(least(e, 0), 2)) / (count(e) - 1)) AS sdn, sum(greatest(e, 0)) AS up, sum(least(e, 0)) AS dn, sum(e) AS t, avg(greatest(e, 0)) AS um, sqrt(avg(pow(least(e, 0), 2))) AS dv, corr(e, p) AS rho FROM l WHERE e IS NOT NULL GROUP BY symbol) SELECT symbol, round(m / sd * sqrt(252), 6) AS sharpe, round(m / sdn * sqrt(252), 6) AS sortino, round(up / -dn, 6) AS omega, round(t / -dn, 6) AS gain_pain, round(um / dv, 6) AS upside, round(m / sd * sqrt(252) / sqrt(1 + 2 * abs(rho)), 6) AS smart_sharpe, round(rho, 6) AS rho FROM g",
    "concentration": f"WITH {_CLEAN}, a AS (SELECT symbol, ret, abs(ret) AS a, row_number() OVER (PARTITION BY symbol ORDER BY abs(ret)) AS i FROM x WHERE ret IS NOT NULL), g AS (SELECT symbol, (2 * sum(i * a) - (count(*) + 1) * sum(a)) / (count(*) * sum(a)) AS gini, 2 * avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) - 1 AS edge FROM a GROUP BY symbol) SELECT symbol, round(gini, 6) AS gini, round(CASE WHEN edge <= 0 THEN 1 ELSE pow((1 - edge) / (1 + edge), 10) END, 6) AS ruin FROM g",
    "outlier_ratios": f"WITH {_CLEAN}, q AS (SELECT symbol, quantile_cont(ret, 0.95) FILTER (ret > 0) AS hi, quantile_cont(ret, 0.05) FILTER (ret < 0) AS lo FROM x GROUP BY symbol) SELECT x.symbol, round(avg(ret) FILTER (ret > 0 AND ret >= hi) / avg(ret) FILTER (ret > 0), 6) AS wins, round(avg(ret) FILTER (ret < 0 AND ret <= lo) / avg(ret) FILTER (ret < 0), 6) AS losses FROM x JOIN q ON q.symbol = x.symbol GROUP BY x.symbol",
    "yearly_returns": f"WITH {_CLEAN} SELECT symbol, CAST(year(date) AS INT) AS year, round(exp(sum(ln(1 + ret))) - 1, 6) AS ret, round(max(ret), 6) AS best, round(min(ret), 6) AS worst, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM x WHERE ret IS NOT NULL GROUP BY 1, 2",
    "rolling_correlation": f"WITH {_MARKET} SELECT symbol, date, CASE WHEN count(*) OVER v = 60 THEN round(covar_pop(ret, market) OVER v / nullif(stddev_pop(ret) OVER v * stddev_pop(market) OVER v, 0), 3) END AS corr, CASE WHEN count(*) OVER v = 60 THEN round(covar_pop(ret, market) OVER v / nullif(var_pop(market) OVER v, 0), 3) END AS beta FROM xm WINDOW v AS {_N(60)}",
    "market_regression": f"WITH {_MARKET}, g AS (SELECT symbol, count(*) AS n, avg(ret) AS y, avg(market) AS m, covar_samp(ret, market) AS c, var_samp(market) AS vx, var_samp(ret) AS vy, stddev_samp(ret - market) AS te, avg(ret - market) AS a FROM xm GROUP BY symbol HAVING count(*) >= 20) SELECT symbol, n, round(c / vx, 6) AS beta, round((y - c / vx * m) * 252, 6) AS alpha, round(c * c / (vx * vy), 6) AS r2, round(te * sqrt(252), 6) AS tracking, round(a / te, 6) AS information, round(sqrt((vy - c / vx * c) * (n - 1) / (n - 2)), 6) AS idiosyncratic FROM g",
    "coskewness": f"WITH {_MARKET}, z AS (SELECT symbol, ret - avg(ret) OVER w AS a, market - avg(market) OVER w AS b FROM xm WINDOW w AS (PARTITION BY symbol)) SELECT symbol, round(avg(a * b * b) / nullif(sqrt(avg(a * a)) * avg(b * b), 0), 6) AS coskewness FROM z GROUP BY symbol",
    "portfolio_returns": f"WITH {_HELD}, k AS (SELECT symbol, date, ret, w * least(1, coalesce(1.0::DOUBLE / nullif(sum(abs(w)) OVER d, 0), 1), coalesce(0.3::DOUBLE / nullif(abs(sum(w) OVER d), 0), 1)) AS w FROM h WINDOW d AS (PARTITION BY date)), j AS (SELECT *, coalesce(lag(w) OVER ({_V}), 0) AS held FROM k) SELECT date, round(sum(held * coalesce(ret, 0)), 6) AS ret, round(sum(abs(w)), 6) AS gross, round(sum(abs(w - held)), 6) AS turnover FROM j GROUP BY date",
    "contributions": f"WITH {_HELD}, g AS (SELECT symbol % 7 AS grp, count(*) AS n, sum(held * r0) AS c FROM c GROUP BY 1) SELECT grp, n, round(c, 6) AS contribution, round(c / sum(c) OVER (), 6) AS share FROM g",
    "brinson": f"WITH {_HELD}, g AS (SELECT date, symbol % 5 AS category, sum(w) AS wp, CAST(count(*) AS DOUBLE) AS wb, avg(ret * w) AS rp, avg(ret) AS rb FROM h WHERE ret IS NOT NULL GROUP BY ALL), n AS (SELECT date, category, wp / sum(wb) OVER d AS wp, wb / sum(wb) OVER d AS wb, rp, rb FROM g WINDOW d AS (PARTITION BY date)), t AS (SELECT *, sum(wb * rb) OVER (PARTITION BY date) AS t FROM n) SELECT date, category, round((wp - wb) * (rb - t), 6) AS allocation, round(wb * (rp - rb), 6) AS selection, round((wp - wb) * (rp - rb), 6) AS interaction FROM t",
    "covariances": f"WITH {_PAIRS} SELECT a, b, n, round(c * 252, 6) AS cov, round(c / nullif(sa * sb, 0), 6) AS corr FROM pr",
    "shrunk_covariances": f"WITH {_PAIRS}, m AS (SELECT avg(c * 252) AS mu FROM pr WHERE a = b) SELECT a, b, round(0.8::DOUBLE * c * 252 + CASE WHEN a = b THEN 0.2::DOUBLE * mu ELSE 0 END, 6) AS cov FROM pr, m",
    "pair_similarity": f"WITH {_PAIRS} SELECT a, b, n, c / nullif(sa * sb, 0) >= 0.05 AS duplicate, round(c / nullif(sa * sb, 0), 6) AS corr FROM pr WHERE a < b",
    "expected_shortfall": f"WITH {_CLEAN}, q AS (SELECT symbol, l AS level, quantile_cont(ret, 0.01) AS q1, quantile_cont(ret, 0.05) AS q5 FROM x, (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE]) AS l) GROUP BY 1, 2), z AS (SELECT symbol, level, CASE WHEN level < 0.02 THEN q1 ELSE q5 END AS q FROM q) SELECT x.symbol, level, round(-max(q), 6) AS var, round(-avg(ret), 6) AS es FROM x JOIN z ON z.symbol = x.symbol AND ret <= q GROUP BY 1, 2",
    "stressed_quantile": f"WITH {_CLEAN} SELECT symbol, count(ret) AS n, round(quantile_cont(ret, 0.05), 6) AS quantile FROM x WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' GROUP BY symbol",
    "regime_metrics": f"WITH {_CLEAN} SELECT symbol, CAST(quarter(date) AS INT) AS state, count(*) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS deviation, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 6) AS sharpe FROM x WHERE ret IS NOT NULL GROUP BY 1, 2",
    "cost_scenarios": f"WITH {_HELD}, s AS (SELECT unnest(['base', 'dear', 'weak']) AS scenario, unnest([1::DOUBLE, 3, 1]) AS k, unnest([1::DOUBLE, 1, 0.5]) AS m), z AS (SELECT symbol, scenario, held * r0 * m - abs(w - held) * k * 2 / 1e4 AS net FROM c, s) SELECT symbol, scenario, round(sum(net), 6) AS total, round(stddev_samp(net), 6) AS deviation FROM z GROUP BY 1, 2",
    "variant_screen": f"WITH {_CLEAN}, "
    + "a AS (SELECT symbol, date, ret, " + ", ".join(f"CASE WHEN count(close) OVER {_N(n)} = {n} THEN avg(close) OVER {_N(n)} END AS m{n}" for n in (2, 5, 10, 20, 50)) + " FROM x), "
    + "v AS (" + " UNION ALL ".join(f"SELECT symbol, date, ret, CAST({a} AS INT) AS fast, CAST({b} AS INT) AS slow, coalesce(sign(m{a} - m{b}), 0) AS w FROM a" for a, b in GRID) + "), "
    + "l AS (SELECT *, lag(w) OVER (PARTITION BY symbol, fast, slow ORDER BY date) AS held FROM v), n AS (SELECT fast, slow, date, avg(CASE WHEN held IS NULL THEN 0 ELSE held * coalesce(ret, 0) - abs(w - held) * 2 / 1e4 END) AS r FROM l GROUP BY ALL) SELECT fast, slow, count(*) AS n, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS deviation FROM n GROUP BY 1, 2",
    "purged_folds": f"WITH {_CLEAN}, k AS (SELECT symbol, row_number() OVER ({_V}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM x), z AS (SELECT *, n // 5 AS size FROM k), fo AS (SELECT *, CAST(least(i // size, 4) AS INT) AS fold, " + ", ".join(f"{k + 1} * size - 1 AS hi{k}" if k < 4 else "n - 1 AS hi4" for k in range(5)) + f" FROM z WHERE size > 0) {_FOLDS}",
    "split_combinations": f"""WITH {_CLEAN}, dt AS (SELECT date, ntile(6) OVER (ORDER BY date) - 1 AS block FROM (SELECT DISTINCT date FROM x)), m AS (SELECT symbol, block, count(ret) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM x JOIN dt USING (date) WHERE ret IS NOT NULL GROUP BY 1, 2),
cb AS (SELECT CAST(row_number() OVER (ORDER BY i, j, k) - 1 AS INT) AS combo, [i, j, k] AS ins FROM range(6) a(i), range(6) b(j), range(6) c(k) WHERE i < j AND j < k),
e AS (SELECT combo, symbol, round({_SHARPE('list_contains(ins, block)')}, 9) AS a, round({_SHARPE('NOT list_contains(ins, block)')}, 9) AS b FROM m, cb GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY a DESC, symbol) AS first, rank() OVER (PARTITION BY combo ORDER BY b) AS rank, count(*) OVER (PARTITION BY combo) AS n FROM e WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT combo, symbol AS best, rank, n, round(ln(rank / (n + 1) / (1 - rank / (n + 1))), 6) AS logit FROM r WHERE first = 1""",
    "adjusted_p": f"WITH {_CLEAN}, t AS (SELECT symbol, round(exp(-abs(avg(ret) / stddev_samp(ret) * sqrt(count(ret)))), 9) AS p FROM x GROUP BY symbol), k AS (SELECT *, row_number() OVER (ORDER BY p, symbol) AS r, count(*) OVER () AS m FROM t) SELECT symbol, p, round(least(1, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM k",
    "tail_blocks": f"WITH {_CLEAN}, t AS (SELECT symbol, date, CASE WHEN count(ret) OVER v = 10 THEN round(sum(ret) OVER v, 9) END AS total FROM x WINDOW v AS {_N(10)}), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY total, date) AS INT) AS rank, count(*) OVER (PARTITION BY symbol) AS n FROM t WHERE total IS NOT NULL) SELECT symbol, date, rank, round(total, 6) AS total FROM k WHERE rank <= ceil(0.02::DOUBLE * n)",
    "chow_test": f"WITH {_CLEAN}, g AS (SELECT symbol, count(ret) AS n, var_pop(ret) * count(ret) AS al, var_pop(ret) FILTER (date >= DATE '1996-01-01') * count(ret) FILTER (date >= DATE '1996-01-01') AS b, var_pop(ret) FILTER (date < DATE '1996-01-01') * count(ret) FILTER (date < DATE '1996-01-01') AS a FROM x WHERE ret IS NOT NULL GROUP BY symbol) SELECT symbol, n, round((al - a - b) / nullif((a + b) / (n - 2), 0), 6) AS f FROM g",
    "tail_dependence": f"WITH {_CLEAN}, u AS (SELECT symbol, date, percent_rank() OVER (PARTITION BY symbol ORDER BY ret) AS u FROM x WHERE ret IS NOT NULL) SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(count(*) FILTER (a.u <= 0.1::DOUBLE AND b.u <= 0.1::DOUBLE) / (0.1::DOUBLE * count(*)), 6) AS lower, round(count(*) FILTER (a.u >= 0.9::DOUBLE AND b.u >= 0.9::DOUBLE) / (0.1::DOUBLE * count(*)), 6) AS upper FROM u a JOIN u b ON a.date = b.date AND a.symbol < b.symbol GROUP BY 1, 2 HAVING count(*) >= 60",
    "welch_test": f"WITH {_CLEAN}, g AS (SELECT symbol, count(*) FILTER (k) AS n1, count(*) FILTER (NOT k) AS n0, avg(ret) FILTER (k) AS m1, avg(ret) FILTER (NOT k) AS m0, var_samp(ret) FILTER (k) AS v1, var_samp(ret) FILTER (NOT k) AS v0 FROM (SELECT *, date >= DATE '1996-01-01' AS k FROM x WHERE ret IS NOT NULL) GROUP BY symbol) SELECT symbol, n1, n0, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t, round(pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)), 6) AS freedom FROM g",
    "circuit_breaker": f"WITH {_CLEAN}, p AS (SELECT symbol, date, round(coalesce(ret, 0) * 1000, 6) AS pnl FROM x), s AS (SELECT symbol, date, pnl / 1000 AS day, sum(pnl) OVER (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) / 1000 AS week FROM p) SELECT symbol, date, CASE WHEN week <= -0.15 THEN 'halted' WHEN day <= -0.1 THEN 'paused' ELSE 'open' END AS state, round(day, 6) AS day, round(week, 6) AS week FROM s",
    "ks_windows": f"""WITH {_CLEAN}, lv AS (SELECT symbol, ret, CAST((row_number() OVER ({_V}) - 1) // 50 AS INT) AS win FROM x WHERE ret IS NOT NULL AND date >= DATE '1996-01-01'), fl AS (SELECT * FROM lv QUALIFY count(*) OVER (PARTITION BY symbol, win) = 50),
bt AS (SELECT symbol, win, ret, 1 AS w, 0 AS r FROM fl UNION ALL SELECT x.symbol, win, ret, 0, 1 FROM x JOIN (SELECT DISTINCT symbol, win FROM fl) q ON q.symbol = x.symbol WHERE ret IS NOT NULL AND date < DATE '1996-01-01'), g AS (SELECT symbol, win, ret, sum(w) AS w, sum(r) AS r FROM bt GROUP BY 1, 2, 3),
z AS (SELECT symbol, win, abs(sum(w) OVER o / sum(w) OVER p - sum(r) OVER o / sum(r) OVER p) AS g FROM g WINDOW o AS (PARTITION BY symbol, win ORDER BY ret ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY symbol, win)) SELECT symbol, win AS "window", round(max(g), 6) AS d FROM z GROUP BY 1, 2""",
    "slippage_fit": "WITH o AS (SELECT l_suppkey AS symbol, CAST(l_quantity AS DOUBLE) / 1000 AS share, CAST(l_discount AS DOUBLE) * 100 + CAST(l_quantity AS DOUBLE) / 10 AS bps FROM lineitem), g AS (SELECT symbol, count(*) AS n, covar_pop(bps, share) / nullif(var_pop(share), 0) AS k, avg(bps) AS y, avg(share) AS m, quantile_cont(share, 0.5) AS q FROM o GROUP BY symbol) SELECT symbol, n, round(k, 6) AS slope, round(y - k * m, 6) AS intercept, round(y - k * m + k * q, 6) AS advice FROM g",
    "bond_table": "WITH b AS (SELECT p_partkey AS bond, p_size / 1000 AS coupon, CAST(p_partkey % 29 + 1 AS INT) AS term, 0.01::DOUBLE + (p_partkey % 7) / 100 AS y FROM part), f AS (SELECT *, unnest(range(1, term + 1)) AS t FROM b), v AS (SELECT *, (100 * coupon + CASE WHEN t = term THEN 100 ELSE 0 END) / pow(1 + y, t) AS pv FROM f) SELECT bond, round(sum(pv), 6) AS price, round(sum(pv * t) / sum(pv), 6) AS duration, round(sum(pv * t * (t + 1)) / sum(pv) / pow(1 + any_value(y), 2), 6) AS convexity FROM v GROUP BY bond",
    "risk_measures": f"""WITH {_CLEAN}, v AS (SELECT *, product(1 + ret) OVER ({_V} ROWS UNBOUNDED PRECEDING) AS v, quantile_cont(ret, 0.05) OVER (PARTITION BY symbol) AS q FROM x WHERE ret IS NOT NULL), d AS (SELECT *, 1 - v / max(v) OVER ({_V} ROWS UNBOUNDED PRECEDING) AS fall FROM v)
SELECT symbol, count(*) AS n, round(coalesce(var_samp(ret), 0), 9) AS variance, round(coalesce(avg(ret * ret) FILTER (ret < 0), 0), 9) AS semi_variance, round(-avg(ret) FILTER (ret <= q), 9) AS cvar, round(max(fall), 9) AS max_drawdown, round(avg(fall), 9) AS mean_drawdown FROM d GROUP BY symbol""",
    "net_of_turnover": f"""WITH {_HELD}, b AS (SELECT symbol % 5 AS portfolio, symbol, date, w * 0.02::DOUBLE AS w, r0 AS ret FROM c WHERE w <> 0), dd AS (SELECT DISTINCT portfolio, date FROM b), sy AS (SELECT DISTINCT portfolio, symbol FROM b),
g AS (SELECT dd.portfolio, dd.date, coalesce(b.w, 0) * coalesce(b.ret, 0) AS g, abs(coalesce(b.w, 0) - lag(coalesce(b.w, 0), 1, 0) OVER (PARTITION BY dd.portfolio, sy.symbol ORDER BY dd.date)) AS x FROM dd JOIN sy USING (portfolio) LEFT JOIN b ON b.portfolio = dd.portfolio AND b.date = dd.date AND b.symbol = sy.symbol),
t AS (SELECT portfolio, date, sum(g) AS g, sum(x) AS x FROM g GROUP BY 1, 2)
SELECT portfolio, count(*) AS n, round(product(1 + g) - 1, 6) AS gross_return, round(product(1 + g - x * 5 / 1e4) - 1, 6) AS net_return, round(sum(x), 6) AS turnover, round(sum(x) * 5 / 1e4, 6) AS cost FROM t GROUP BY portfolio""",
    "walk_forward_metrics": f"""WITH {_NET0}, nn AS (SELECT symbol, date, round(net, 9) AS net, row_number() OVER ({_V}) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM nt), ht AS (SELECT *, n - CAST(floor(n * 0.5) AS BIGINT) AS first FROM nn),
f AS (SELECT *, least((k - first) // greatest((n - first) // 5, 1), 4) AS fold FROM ht WHERE k >= first), v AS (SELECT *, product(1 + coalesce(net, 0)) OVER fo AS v FROM f WINDOW fo AS (PARTITION BY symbol, fold ORDER BY date ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, v / max(v) OVER (PARTITION BY symbol, fold ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM v),
m AS (SELECT symbol, fold, count(*) AS n_rows, pow(arg_max(v, date), 252.0 / count(*)) - 1 AS cagr, min(fall) AS mdd, CASE WHEN stddev_pop(coalesce(net, 0)) > 1e-12 THEN avg(coalesce(net, 0)) / stddev_pop(coalesce(net, 0)) * sqrt(252) ELSE 0 END AS sharpe FROM e GROUP BY 1, 2),
r AS (SELECT symbol, fold, n_rows, CASE WHEN n_rows >= 20 THEN cagr END AS cagr, CASE WHEN n_rows >= 20 THEN mdd END AS mdd, CASE WHEN n_rows >= 20 THEN cagr / nullif(-mdd, 0) END AS calmar, CASE WHEN n_rows >= 20 THEN sharpe END AS sharpe FROM m),
z AS (SELECT *, coalesce(calmar > 0 AND n_rows >= 60, false) AS passed, CASE WHEN n_rows < 20 THEN 'insufficient_data' END AS reason FROM r)
SELECT symbol, fold, n_rows, passed, reason, CASE WHEN calmar IS NOT NULL THEN rank() OVER (PARTITION BY symbol ORDER BY calmar DESC NULLS LAST) END AS place, CAST(sum(CAST(passed AS INT)) OVER (PARTITION BY symbol) AS BIGINT) AS n_passed, round(cagr, 6) AS cagr, round(mdd, 6) AS mdd, round(calmar, 6) AS calmar, round(sharpe, 6) AS sharpe FROM z""",
}
