"""Point-in-time, identity, star and registry queries and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import joins as j
from tidemark.plans.market import _listings, _r
from tidemark.sources.derived import BARS_SQL, bars, read

def _AT():
    return F.to_date(F.lit("1997-06-30"))


def _features(s, d):
    o = read(s, d, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select((F.col("o_custkey") % 200).alias("symbol"), day.alias("decision_time"), F.date_add(day, (F.col("o_orderkey") % 40 - 10).cast("int")).alias("available_time"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice").cast("double")).alias("value"))


def _facts(s, d):
    o = read(s, d, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(F.col("o_custkey").alias("symbol"), F.col("o_orderpriority").alias("concept"), F.year(day).alias("period"), F.when(F.col("o_orderstatus") == "F", "annual").otherwise("quarterly").alias("form"), F.date_add(day, 45).alias("accepted"), F.col("o_totalprice").cast("double").alias("value"), F.col("o_orderkey").alias("fact_id"))


def _sessions(s, d):
    return read(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).where("weekday(date) < 5 and date < '1998-01-01'").distinct()


def _policies(s, d):
    x = read(s, d, "customer").select("c_custkey", F.date_add(F.to_date(F.lit("1993-01-01")), (F.col("c_custkey") % 1500).cast("int")).alias("observed"))
    out = None
    for p in ("next_day", "friday_after", "next_month", "quarter_end_60", "thirteen_months"):
        one = j.next_session(x, j.policy_target(F.col("observed"), p), _sessions(s, d)).withColumn("policy", F.lit(p))
        out = one if out is None else out.unionByName(one)
    return out


def _journal(s, d):
    l = read(s, d, "lineitem")  # noqa: E741
    side = F.when(F.col("l_linenumber") % 2 == 1, "BUY").otherwise("SELL")
    money = F.col("l_quantity").cast("double") * 100 * (1 + F.col("l_discount").cast("double"))
    return l.groupBy("l_orderkey", "l_linenumber").agg(F.max_by(F.struct("l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag"), F.struct("l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag")).alias("m")).select("l_orderkey", "l_linenumber", "m.*").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("ts"), side.alias("side"), F.col("l_quantity").cast("double").alias("quantity"),
        F.when(F.col("l_linenumber") % 2 == 1, money).otherwise(-money).alias("notional"), (F.col("l_tax").cast("double") * 10).alias("commission"), F.when(F.col("l_returnflag") != "R", "FILLED").otherwise("REJECTED").alias("status"),
    )


def _trials(s, d):
    p = read(s, d, "part")
    return p.select(F.col("p_partkey").alias("trial"), F.concat(F.lit('{"calmar": '), F.when(F.col("p_partkey") % 9 == 0, F.lit('"n/a"')).otherwise((F.col("p_size") / 10).cast("string")), F.lit("}")).alias("metrics"), F.split("p_type", " ").alias("tags"), F.date_add(F.to_date(F.lit("2020-01-01")), (F.col("p_partkey") % 300).cast("int")).alias("ts"))


def _names(s, d):
    n = read(s, d, "customer").select(F.col("c_custkey").alias("k"))
    return n.select(F.concat(F.lit("S"), F.col("k")).alias("canonical"), F.array(F.concat(F.lit("A"), F.col("k") % 700), F.concat(F.lit("S"), F.col("k") + 1)).alias("aliases"))


def _star(s, d):
    return j.star(bars(s, d), "symbol", "date")


def _by_symbol(s, d):
    facts, symbols, dates = _star(s, d)
    return facts.join(symbols, "symbol_key").join(dates, "date_key").groupBy("symbol", "year", "quarter").agg(F.count("*").alias("n"), F.round(F.sum("volume"), 6).alias("volume"))


def _windows(s, d):
    c = read(s, d, "customer").where("c_custkey % 3 = 0")
    start = F.date_add(F.to_date(F.lit("1993-01-01")), (F.col("c_custkey") % 1800).cast("int"))
    return c.select((F.col("c_custkey") % 100).alias("symbol"), start.alias("start"), F.date_add(start, 4).alias("end"))


def _checked(s, d):
    b = bars(s, d).select("symbol", "date", "close")
    feed = _features(s, d).select(F.col("symbol"), F.col("available_time").alias("date"), F.col("available_time").alias("available"), "value")
    feed = feed.groupBy("symbol", "date").agg(F.max("available").alias("available"), F.max("value").alias("value"))
    return _r(j.asof_checked(b, feed, "symbol", "date", "available", ["value"]), "symbol", "date", "available", value="value")


QUERIES = {
    "asof_checked": _checked,
    "feature_at": lambda s, d: j.feature_at(_features(s, d), _AT(), "symbol"),
    "feature_missingness": lambda s, d: j.missingness(_features(s, d), "symbol"),
    "known_facts": lambda s, d: j.known_facts(_facts(s, d), read(s, d, "customer").select(F.col("c_custkey").alias("symbol"), F.date_add(F.to_date(F.lit("1995-01-01")), (F.col("c_custkey") % 700).cast("int")).alias("decision")), "symbol").groupBy("symbol", "decision").agg(F.count("*").alias("n"), F.max("accepted").alias("last")),
    "latest_concepts": lambda s, d: j.latest_concepts(_facts(s, d), _AT(), 3).withColumn("lag", F.col("lag").cast("int")),
    "policy_sessions": _policies,
    "latest_availability": lambda s, d: _features(s, d).select("symbol", "decision_time", "available_time", j.latest_of(["decision_time", "available_time"]).alias("ready")),
    "active_at": lambda s, d: j.active_at(read(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 120).alias("symbol"), F.col("o_orderdate").cast("date").alias("date")), _listings(s, d), "symbol", "date"),
    "universe_diff": lambda s, d: j.universe_diff(read(s, d, "orders").where("year(o_orderdate) = 1996").select("o_custkey"), read(s, d, "orders").where("year(o_orderdate) = 1997").select("o_custkey"), "o_custkey"),
    "affected_consumers": lambda s, d: j.affected(j.universe_diff(read(s, d, "orders").where("year(o_orderdate) = 1996").select("o_custkey"), read(s, d, "orders").where("year(o_orderdate) = 1997").select("o_custkey"), "o_custkey"), read(s, d, "orders").groupBy(F.col("o_orderpriority").alias("consumer")).agg(F.collect_set("o_custkey").alias("keys")), "o_custkey"),
    "resolved_names": lambda s, d: j.resolved(read(s, d, "orders").select(F.explode(F.array(F.concat(F.lit("S"), F.col("o_custkey")), F.concat(F.lit("A"), F.col("o_custkey")), F.concat(F.lit("S"), F.col("o_custkey") + 1))).alias("symbol")).distinct(), _names(s, d)),
    "normal_symbols": lambda s, d: read(s, d, "part").select("p_partkey", j.normal_symbol(F.concat(F.lit("  "), F.col("p_type"), F.lit(".b "))).alias("symbol")),
    "best_match": lambda s, d: j.best_match(read(s, d, "customer").select(F.col("c_custkey").alias("o_custkey")), read(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("price")), "o_custkey", [F.desc("price"), F.col("o_orderkey")]),
    "star_facts": lambda s, d: _star(s, d)[0].select("symbol_key", "date_key", F.round("close", 6).alias("close")),
    "star_dates": lambda s, d: _star(s, d)[2],
    "star_by_quarter": _by_symbol,
    "event_window": lambda s, d: _r(j.event_window(bars(s, d), read(s, d, "orders").select((F.col("o_custkey") % 100).alias("symbol"), F.col("o_orderdate").cast("date").alias("event")).distinct(), 3), "symbol", "event", "offset", close="close"),
    "calendar_spine": lambda s, d: j.on_spine(read(s, d, "region").select(F.col("r_regionkey").cast("long").alias("symbol")).join(_sessions(s, d)), _features(s, d).groupBy((F.col("symbol") % 5).alias("symbol"), F.col("available_time").alias("date")).agg(F.max("value").alias("value")), "symbol", "date", ["value"], 2),
    "blocked_rows": lambda s, d: j.blocked(bars(s, d).select("symbol", "date"), _windows(s, d), "symbol", "date"),
    "prerequisites": lambda s, d: j.with_prerequisites(_facts(s, d).select("symbol", F.col("concept").alias("tag"), F.col("accepted").alias("available"), "fact_id"), read(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("symbol")), read(s, d, "orders").where("o_orderpriority < '3'").select(F.col("o_orderpriority").alias("tag")).distinct(), _AT()),
    "members_over_time": lambda s, d: j.members_over_time(bars(s, d).select("date"), _listings(s, d)),
    "search_trials": lambda s, d: j.search_trials(_trials(s, d), {"calmar": 2.0}, ["PROMO"], 100).select("trial", "ts"),
    "daily_cash": lambda s, d: _r(j.daily_cash(_journal(s, d)), "date", "n_trades", pnl="pnl"),
    "position_history": lambda s, d: _r(j.positions(_journal(s, d)), "id", "symbol", "ts", "side", position="position"),
    "dashboard": lambda s, d: _r(j.dashboard(_journal(s, d), "symbol"), "symbol", "days", total="total", win_rate="win_rate", sharpe="sharpe", drawdown="drawdown"),
    "compared_runs": lambda s, d: j.compared(read(s, d, "orders").where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("name")).agg(F.count("*").alias("value")), read(s, d, "orders").where("o_orderkey % 2 = 1").groupBy(F.col("o_custkey").alias("name")).agg(F.count("*").alias("value"))),
    "canonical_rules": lambda s, d: j.canonical_rules(read(s, d, "part"), ["p_brand", "p_type"], "p_partkey"),
    "merged_stages": lambda s, d: j.merged_stages([read(s, d, "orders").select("o_custkey", F.lit(k).alias("stage"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status")).where(f"o_orderkey % 3 = {k}") for k in range(3)], "o_custkey", ["stage", "k"]),
    "top_orders": lambda s, d: j.top_by(read(s, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price")), "price", 50, "o_orderkey"),
}


_HEX8 = " + ".join(f"CAST((instr('0123456789abcdef', substr(m, {i + 1}, 1)) - 1) * {16 ** (7 - i)} AS BIGINT)" for i in range(8))
_FEATURES = "feats AS (SELECT o_custkey % 200 AS symbol, CAST(o_orderdate AS DATE) AS decision_time, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 10 AS INT) AS available_time, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_totalprice AS DOUBLE) END AS value FROM orders)"
_FACTS = "facts AS (SELECT o_custkey AS symbol, o_orderpriority AS concept, CAST(year(o_orderdate) AS INT) AS period, CASE WHEN o_orderstatus = 'F' THEN 'annual' ELSE 'quarterly' END AS form, CAST(o_orderdate AS DATE) + 45 AS accepted, CAST(o_totalprice AS DOUBLE) AS value, o_orderkey AS fact_id FROM orders)"
_SESSIONS = "sess AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE isodow(o_orderdate) < 6 AND o_orderdate < DATE '1998-01-01')"
_LISTED = "l AS (SELECT symbol AS k, min(date) AS a, CASE WHEN symbol % 4 <> 0 THEN max(date) END AS b FROM bars GROUP BY symbol)"
_UDIFF = "a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1997), diff AS (SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN a.k IS NULL THEN 'added' ELSE 'removed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL)"
_JOURNAL = """lines AS (SELECT l_orderkey, l_linenumber, max(struct_pack(a := l_suppkey, b := l_shipdate, c := l_quantity, d := l_discount, e := l_tax, f := l_returnflag)) AS m FROM lineitem GROUP BY ALL),
journal AS (SELECT l_orderkey * 10 + l_linenumber AS id, m.a AS symbol, CAST(m.b AS DATE) AS ts, CASE WHEN l_linenumber % 2 = 1 THEN 'BUY' ELSE 'SELL' END AS side, CAST(m.c AS DOUBLE) AS quantity, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END * CAST(m.c AS DOUBLE) * 100 * (1 + CAST(m.d AS DOUBLE)) AS notional, CAST(m.e AS DOUBLE) * 10 AS commission, CASE WHEN m.f <> 'R' THEN 'FILLED' ELSE 'REJECTED' END AS status FROM lines)"""
_POLICY = lambda name, day: f"SELECT c_custkey, observed, '{name}' AS policy, (SELECT min(date) FROM sess WHERE date >= {day}) AS session FROM obs"

ORACLE = {
    "asof_checked": f"WITH {BARS_SQL}, {_FEATURES}, f AS (SELECT symbol, available_time AS date, max(value) AS value FROM feats GROUP BY ALL) SELECT b.symbol, b.date, f.date AS available, round(f.value, 6) AS value FROM bars b ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.date >= f.date",
    "feature_at": f"WITH {_FEATURES} SELECT symbol, decision_time, available_time, value FROM feats WHERE available_time <= DATE '1997-06-30' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY decision_time <= DATE '1997-06-30' DESC, decision_time DESC, available_time DESC, value DESC NULLS LAST) = 1",
    "feature_missingness": f"WITH {_FEATURES} SELECT symbol, count(*) AS n, count(*) FILTER (value IS NULL) AS missing FROM feats GROUP BY symbol",
    "known_facts": f"WITH {_FACTS}, dc AS (SELECT c_custkey AS k, DATE '1995-01-01' + CAST(c_custkey % 700 AS INT) AS decision FROM customer) SELECT symbol, decision, count(*) AS n, max(accepted) AS last FROM facts JOIN dc ON symbol = k AND accepted <= decision GROUP BY ALL",
    "latest_concepts": f"WITH {_FACTS}, b AS (SELECT * FROM facts WHERE accepted <= DATE '1997-06-30' QUALIFY row_number() OVER (PARTITION BY symbol, concept, period ORDER BY form = 'annual' DESC, accepted DESC, fact_id DESC) = 1) SELECT symbol, concept, CAST(row_number() OVER (PARTITION BY symbol, concept ORDER BY period DESC) - 1 AS INT) AS lag, period, value FROM b QUALIFY row_number() OVER (PARTITION BY symbol, concept ORDER BY period DESC) <= 3",
    "policy_sessions": f"WITH {_SESSIONS}, obs AS (SELECT c_custkey, DATE '1993-01-01' + CAST(c_custkey % 1500 AS INT) AS observed FROM customer) "
    + " UNION ALL ".join(_POLICY(n, x) for n, x in (("next_day", "observed + 1"), ("friday_after", "observed + CAST((12 - isodow(observed)) % 7 AS INT)"), ("next_month", "date_trunc('month', observed + INTERVAL 1 MONTH)"), ("quarter_end_60", "last_day(date_trunc('quarter', observed) + INTERVAL 2 MONTH) + 60"), ("thirteen_months", "observed + INTERVAL 13 MONTH"))),
    "latest_availability": f"WITH {_FEATURES} SELECT symbol, decision_time, available_time, greatest(decision_time, available_time) AS ready FROM feats",
    "active_at": f"WITH {BARS_SQL}, {_LISTED} SELECT o_orderkey, o_custkey % 120 AS symbol, CAST(o_orderdate AS DATE) AS date, coalesce(a <= CAST(o_orderdate AS DATE) AND (b IS NULL OR CAST(o_orderdate AS DATE) <= b), false) AS active FROM orders LEFT JOIN l ON k = o_custkey % 120",
    "universe_diff": f"WITH {_UDIFF} SELECT * FROM diff",
    "affected_consumers": f"WITH {_UDIFF}, u AS (SELECT DISTINCT o_orderpriority AS consumer, o_custkey FROM orders) SELECT consumer, count(*) AS touched FROM u JOIN diff USING (o_custkey) GROUP BY consumer",
    "resolved_names": """WITH r AS (SELECT 'S' || c_custkey AS canonical, c_custkey AS k FROM customer), n AS (SELECT canonical AS name, canonical, 0 AS r FROM r UNION ALL SELECT 'A' || (k % 700), canonical, 1 FROM r UNION ALL SELECT 'S' || (k + 1), canonical, 1 FROM r),
o AS (SELECT name, min(r) AS r, max(CASE WHEN r = 0 THEN canonical END) AS own, count(DISTINCT canonical) AS k, min(canonical) AS one FROM n GROUP BY name),
q AS (SELECT DISTINCT unnest(['S' || o_custkey, 'A' || o_custkey, 'S' || (o_custkey + 1)]) AS symbol FROM orders)
SELECT symbol, coalesce(own, CASE WHEN k = 1 THEN one END) AS canonical, CASE WHEN name IS NULL THEN 'unknown' WHEN r = 0 THEN 'canonical' WHEN k > 1 THEN 'ambiguous' ELSE 'alias' END AS status FROM q LEFT JOIN o ON name = symbol""",
    "normal_symbols": "SELECT p_partkey, regexp_replace(upper(trim('  ' || p_type || '.b ')), '[./ _]+', '-', 'g') AS symbol FROM part",
    "best_match": "WITH m AS (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DOUBLE) AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) SELECT c_custkey AS o_custkey, o_orderkey, price FROM customer LEFT JOIN m ON m.o_custkey = c_custkey",
    "star_facts": f"WITH {BARS_SQL}, m AS (SELECT date, close, sha1(CAST(symbol AS VARCHAR)) AS m FROM bars) SELECT CAST('0x' || substr(m, 1, 15) AS BIGINT) AS symbol_key, CAST(strftime(date, '%Y%m%d') AS INT) AS date_key, round(close, 6) AS close FROM m",
    "star_dates": f"WITH {BARS_SQL} SELECT DISTINCT CAST(strftime(date, '%Y%m%d') AS INT) AS date_key, date, CAST(year(date) AS INT) AS year, CAST(quarter(date) AS INT) AS quarter, CAST(month(date) AS INT) AS month, CAST(isodow(date) AS INT) AS weekday FROM bars",
    "star_by_quarter": f"WITH {BARS_SQL} SELECT symbol, CAST(year(date) AS INT) AS year, CAST(quarter(date) AS INT) AS quarter, count(*) AS n, round(sum(volume), 6) AS volume FROM bars GROUP BY ALL",
    "event_window": f"WITH {BARS_SQL}, n AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM bars), e AS (SELECT DISTINCT o_custkey % 100 AS symbol, CAST(o_orderdate AS DATE) AS event FROM orders), a AS (SELECT e.symbol, event, k FROM e ASOF JOIN n ON e.symbol = n.symbol AND event >= n.date) SELECT a.symbol, event, CAST(o AS INT) AS \"offset\", round(n.close, 6) AS close FROM (SELECT symbol, event, k, unnest(range(-3, 4)) AS o FROM a) a JOIN n ON n.symbol = a.symbol AND n.k = a.k + o",
    "calendar_spine": f"WITH {_SESSIONS}, {_FEATURES}, f AS (SELECT symbol % 5 AS symbol, available_time AS date, max(value) AS value FROM feats GROUP BY ALL), sp AS (SELECT CAST(r_regionkey AS BIGINT) AS symbol, date FROM region, sess) SELECT sp.symbol, sp.date, CASE WHEN date_diff('day', f.date, sp.date) <= 2 THEN value END AS value FROM sp ASOF LEFT JOIN f ON sp.symbol = f.symbol AND sp.date >= f.date",
    "blocked_rows": f"WITH {BARS_SQL}, w AS (SELECT c_custkey % 100 AS k, DATE '1993-01-01' + CAST(c_custkey % 1800 AS INT) AS a FROM customer WHERE c_custkey % 3 = 0) SELECT symbol, date, EXISTS (SELECT 1 FROM w WHERE k = symbol AND date BETWEEN a AND a + 4) AS blocked FROM bars",
    "prerequisites": f"WITH {_FACTS} SELECT symbol, concept AS tag, accepted AS available, fact_id FROM facts WHERE accepted <= DATE '1997-06-30' AND concept < '3' AND symbol IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    "members_over_time": f"WITH {BARS_SQL}, {_LISTED} SELECT date, count(*) AS members FROM (SELECT DISTINCT date FROM bars) JOIN l ON a <= date AND (b IS NULL OR date <= b) GROUP BY date",
    "search_trials": "SELECT p_partkey AS trial, DATE '2020-01-01' + CAST(p_partkey % 300 AS INT) AS ts FROM part WHERE p_partkey % 9 <> 0 AND p_size / 10 >= 2 AND list_contains(string_split(p_type, ' '), 'PROMO') ORDER BY 2 DESC, 1 DESC LIMIT 100",
    "daily_cash": f"WITH {_JOURNAL} SELECT ts AS date, count(*) AS n_trades, round(sum(-notional - commission), 6) AS pnl FROM journal WHERE status = 'FILLED' GROUP BY ts",
    "position_history": f"WITH {_JOURNAL} SELECT id, symbol, ts, side, round(sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) OVER (PARTITION BY symbol ORDER BY ts, id), 6) AS position FROM journal WHERE status = 'FILLED'",
    "dashboard": f"WITH {_JOURNAL}, dl AS (SELECT symbol, ts, sum(-notional - commission) AS pnl FROM journal WHERE status = 'FILLED' GROUP BY ALL), c AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol ORDER BY ts) AS c FROM dl), m AS (SELECT *, c - max(c) OVER (PARTITION BY symbol ORDER BY ts) AS dd FROM c) SELECT symbol, count(*) AS days, round(sum(pnl), 6) AS total, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252), 6) AS sharpe, round(min(dd), 6) AS drawdown FROM m GROUP BY symbol",
    "compared_runs": "WITH a AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT coalesce(a.k, b.k) AS name, a.v AS old, b.v AS new FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v",
    "canonical_rules": "SELECT sha256(lower(trim(p_brand)) || '|' || lower(trim(p_type))) AS digest, count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY 1",
    "merged_stages": "SELECT o_custkey, CAST(o_orderkey % 3 AS INT) AS stage, o_orderkey AS k, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3, o_orderkey) = 1",
    "top_orders": "SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price FROM orders ORDER BY price DESC, o_orderkey LIMIT 50",
}
