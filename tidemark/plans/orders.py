"""Order, alert and file queries and the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark.common import place
from tidemark.functions.distributions import DENSITY, TAIL, TAIL_SCALE
from tidemark.operators import orders as o
from tidemark.operators import panel, recurrence
from tidemark.plans.market import _r
from tidemark.plans.research import _CLEAN, _DD, _clean
from tidemark.plans.robustness import _lots
from tidemark.sources.derived import BARS_SQL, bars, read
from tidemark.sources.files import read_bars_csv, write_csv

TRIALS = 100
EXTRA = ((0, "submitted", "k % 17 <> 0"), (1, "acknowledged", "k % 13 <> 0"), (100, "filled", "k % 3 = 0"), (200, "cancel_requested", "k % 5 = 0"), (300, "cancelled", "k % 10 = 0"))


def _order_events(s, d):
    line = read(s, d, "lineitem")
    fills = line.select(F.col("l_orderkey").alias("order_id"), (F.col("l_linenumber") * 10).cast("int").alias("seq"), F.lit("partially_filled").alias("kind"), F.col("l_quantity").cast("double").alias("qty"), (100 * (1 + F.col("l_discount").cast("double") - F.col("l_tax").cast("double"))).alias("price"))
    head = read(s, d, "orders").select(F.col("o_orderkey").alias("k"))
    rest = [head.where(c).select(F.col("k").alias("order_id"), F.lit(n).alias("seq"), F.lit(kind).alias("kind"), F.lit(1.0).alias("qty"), F.lit(100.0).alias("price")) for n, kind, c in EXTRA]
    return reduce(lambda a, b: a.unionByName(b), rest, fills)


def _falls(s, d):
    x = panel.drawdown(_clean(s, d)).withColumn("dd", F.round("dd", 9))
    return o.alerts(x, {"loss": F.col("ret") <= -0.04, "fall": F.col("dd") <= -0.2}, 30)


def _csv(s, d):
    path = place(s, "csv")
    write_csv(bars(s, d), path)
    return read_bars_csv(s, path, "1994-01-01", "1996-12-31")


def _scaled(c, places):
    """Rounded as SQL engines do that scale, round and scale back: averages lie on ties, where a rounding of the digits goes the other way."""
    return (F.round(F.col(c) * 10.0**places) / 10.0**places).alias(c)


QUERIES = {
    "order_states": lambda s, d: o.order_states(_order_events(s, d)).select("order_id", "state", "events", "illegal", F.round("filled", 6).alias("filled"), F.round("average", 9).alias("average")),
    "average_cost": lambda s, d: recurrence.average_cost(_lots(s, d), ["date", "seq"]).select("symbol", "seq", "position", _scaled("cost", 6), _scaled("realised", 4)),
    "alerts": _falls,
    "deflated_sharpe": lambda s, d: _r(o.deflated_sharpe(_clean(s, d), TRIALS), "symbol", "n", sharpe="sharpe", probabilistic="probabilistic", deflated="deflated"),
    "csv_bars": lambda s, d: _r(_csv(s, d), "symbol", "date", open="open", high="high", low="low", close="close", volume="volume"),
}

_TAIL = "0"
for _c in reversed(TAIL):
    _TAIL = f"({_TAIL} + {_c}::DOUBLE) * t"
_EXTRA = " ".join(f"UNION ALL SELECT o_orderkey, {n}, '{kind}', 1, 100 FROM (SELECT o_orderkey, o_orderkey AS k FROM orders) WHERE {c}" for n, kind, c in EXTRA)
_CDF = lambda z: f"(CASE WHEN {z} >= 0 THEN 1 - {z}_t ELSE {z}_t END)"
_TAILS = lambda z: f"list_transform([1 / (1 + {TAIL_SCALE}::DOUBLE * abs({z}))], lambda t: {DENSITY}::DOUBLE * exp(-{z} * {z} / 2) * {_TAIL})[1] AS {z}_t"

ORACLE = {
    "order_states": f"""WITH RECURSIVE ev(order_id, seq, kind, qty, price) AS (SELECT l_orderkey, l_linenumber * 10, 'partially_filled', CAST(l_quantity AS DOUBLE), 100 * (1 + CAST(l_discount AS DOUBLE) - CAST(l_tax AS DOUBLE)) FROM lineitem {_EXTRA}),
e AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY seq) AS i FROM ev), m(a, k, b) AS (VALUES {", ".join(str(v) for v in o.MOVES)}),
r AS (SELECT DISTINCT order_id, CAST(0 AS BIGINT) AS i, 'created' AS state, CAST(0 AS BIGINT) AS illegal, 0.0::DOUBLE AS filled, 0.0::DOUBLE AS paid FROM e
UNION ALL SELECT r.order_id, e.i, coalesce(m.b, r.state), r.illegal + CASE WHEN m.b IS NULL THEN 1 ELSE 0 END, r.filled + CASE WHEN m.b IS NOT NULL AND e.kind IN ('partially_filled', 'filled') THEN qty ELSE 0 END,
r.paid + CASE WHEN m.b IS NOT NULL AND e.kind IN ('partially_filled', 'filled') THEN qty * price ELSE 0 END FROM r JOIN e ON e.order_id = r.order_id AND e.i = r.i + 1 LEFT JOIN m ON m.a = r.state AND m.k = e.kind)
SELECT order_id, arg_max(state, i) AS state, max(i) AS events, max(illegal) AS illegal, round(max(filled), 6) AS filled, round(CASE WHEN max(filled) > 0 THEN max(paid) / max(filled) END, 9) AS average FROM r GROUP BY order_id""",
    "average_cost": """WITH RECURSIVE t AS (SELECT l_suppkey AS symbol, l_orderkey * 10 + l_linenumber AS seq, row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(l_shipdate AS DATE), l_orderkey * 10 + l_linenumber) AS i,
CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END * CAST(l_quantity AS DOUBLE) AS q, round(100 * (1 + CAST(l_discount AS DOUBLE) - CAST(l_tax AS DOUBLE)), 6) AS p FROM lineitem),
r AS (SELECT symbol, seq, i, q AS position, p AS cost, 0.0::DOUBLE AS realised FROM t WHERE i = 1 UNION ALL
SELECT t.symbol, t.seq, t.i, position + q, CASE WHEN position + q = 0 THEN 0 WHEN position * q >= 0 THEN (cost * abs(position) + p * abs(q)) / (abs(position) + abs(q)) WHEN abs(q) > abs(position) THEN p ELSE cost END,
realised + CASE WHEN position * q < 0 THEN least(abs(q), abs(position)) * (p - cost) * sign(position) ELSE 0 END FROM r JOIN t ON t.symbol = r.symbol AND t.i = r.i + 1)
SELECT symbol, seq, position, round(cost, 6) AS cost, round(realised, 4) AS realised FROM r""",
    "alerts": f"""WITH RECURSIVE {_DD}, rd AS (SELECT dd.symbol, dd.date, x.ret, round(dd, 9) AS dd FROM dd JOIN x USING (symbol, date)), h AS (SELECT symbol, 'loss' AS rule, date FROM rd WHERE ret <= -0.04 UNION ALL SELECT symbol, 'fall', date FROM rd WHERE dd <= -0.2),
nx AS (SELECT a.symbol, a.rule, a.date, min(b.date) AS next FROM h a LEFT JOIN h b ON a.symbol = b.symbol AND a.rule = b.rule AND b.date >= a.date + 30 GROUP BY 1, 2, 3),
f AS (SELECT symbol, rule, min(date) AS date FROM h GROUP BY 1, 2 UNION ALL SELECT nx.symbol, nx.rule, nx.next FROM f JOIN nx USING (symbol, rule, date) WHERE next IS NOT NULL) SELECT symbol, rule, date FROM f""",
    "deflated_sharpe": f"""WITH {_CLEAN}, m AS (SELECT symbol, ret, avg(ret) OVER v AS mu, stddev_pop(ret) OVER v AS sd FROM x WHERE ret IS NOT NULL WINDOW v AS (PARTITION BY symbol)),
g AS (SELECT symbol, count(*) AS n, max(mu) / max(sd) * sqrt(252) AS sr, avg(pow((ret - mu) / sd, 3)) AS k3, avg(pow((ret - mu) / sd, 4)) AS k4 FROM m GROUP BY symbol),
v AS (SELECT *, sqrt((1 - k3 * sr + (k4 - 1) / 4 * sr * sr) / (n - 1)) AS s FROM g), z AS (SELECT *, sr / s AS a, (sr - {o.best_of(TRIALS)!r}::DOUBLE) / s AS b FROM v), c AS (SELECT *, {_TAILS("a")}, {_TAILS("b")} FROM z)
SELECT symbol, n, round(sr, 6) AS sharpe, round({_CDF("a")}, 6) AS probabilistic, round({_CDF("b")}, 6) AS deflated FROM c""",
    "csv_bars": f"WITH {BARS_SQL} SELECT symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM bars WHERE date BETWEEN '1994-01-01' AND '1996-12-31'",
}
