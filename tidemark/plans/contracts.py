"""Contract, quality and version queries and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.common import written
from tidemark.operators import contracts as c
from tidemark.plans.market import _RETS, _listings, _orders, _r, _rets
from tidemark.sources.derived import BARS_SQL, bars, read

def _DAY():
    return F.to_date(F.lit("1998-06-01"))


def _holidays(s, d):
    return read(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).where("month(date) = 12 and dayofmonth(date) in (24, 25, 31)").distinct()


def _priced(s, d):
    o, k = read(s, d, "orders"), F.col("o_orderkey")
    return o.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date"), F.when(k % 50 != 0, F.col("o_totalprice").cast("double")).alias("price"), (F.col("o_custkey") % 5 + k % 7 - 1).cast("long").alias("rank"), F.col("o_orderstatus").alias("status"))


def _grouped(s, d, new):
    return _orders(s, d, new).withColumn("grp", F.col("o_orderkey") % 400)


def _actions_seen(s, d):
    return read(s, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


def _tries(s, d):
    return read(s, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").cast("int").alias("attempt"), (F.col("l_returnflag") == "A").alias("ok"))


def _edges(s, d):
    """Child to parent: each part leads to the part of half its key, every third to one more of a third."""
    k = read(s, d, "part").where("p_partkey >= 2").select(F.col("p_partkey").cast("long").alias("child"))
    return k.select("child", F.expr("child div 2").alias("parent")).union(k.where("child % 3 = 0").select("child", F.expr("child div 3").alias("parent")))


QUERIES = {
    "field_checks": lambda s, d: c.field_checks(_priced(s, d), {"o_orderkey": (False, True), "price": (False, True), "rank": (True, True), "status": (False, False)}),
    "price_jumps": lambda s, d: c.price_jumps(bars(s, d), 0.05, 0.1),
    "availability_leaks": lambda s, d: c.leaks(_priced(s, d).withColumn("seen", F.date_add("date", (F.col("o_orderkey") % 60).cast("int"))), _DAY(), "seen", "status"),
    "stale_series": lambda s, d: c.staleness(bars(s, d), F.to_date(F.lit("1998-12-01")), 3),
    "sequence_faults": lambda s, d: c.sequence_faults(_actions_seen(s, d), "symbol", "date", "seq"),
    "missing_sessions": lambda s, d: c.missing_sessions(bars(s, d), _holidays(s, d)),
    "unexpected_sessions": lambda s, d: c.unexpected_sessions(bars(s, d), _holidays(s, d)),
    "quality_scores": lambda s, d: c.quality_scores(bars(s, d), 0.13, _holidays(s, d)).select("symbol", "n", "impossible", "not_positive", "extreme", "missing", "score", "decision"),
    "latest_state": lambda s, d: c.latest_state(_priced(s, d), "o_custkey", ["date", "o_orderkey"], "status"),
    "decision_coverage": lambda s, d: c.coverage(read(s, d, "part").select(F.col("p_partkey").alias("symbol")), c.quality_scores(bars(s, d), 0.13), "symbol", "decision"),
    "content_hash": lambda s, d: c.content_hash(read(s, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "o_orderstatus"),
    "dataset_diff": lambda s, d: c.dataset_diff(_grouped(s, d, False), _grouped(s, d, True), "o_orderkey", "grp", ["price"]),
    "stale_artefacts": lambda s, d: c.stale_artefacts(c.dataset_diff(_grouped(s, d, False), _grouped(s, d, True), "o_orderkey", "grp", ["price"]), read(s, d, "part").select((F.col("p_partkey") % 400).alias("grp"), (F.col("p_size") % 10).alias("artefact")), "grp", "artefact"),
    "expectations": lambda s, d: c.expectations(_priced(s, d), [("not_null", "price"), ("unique", "o_orderkey"), ("unique", "price"), ("in_set", "status", ["F", "O"]), ("between", "price", 1000.0, 300000.0), ("matches", "status", "F|P"), ("not_null", "absent")]),
    "table_audit": lambda s, d: c.table_audit(_priced(s, d), ["price", "status"], ["o_custkey", "date"]),
    "return_panel_faults": lambda s, d: c.return_panel_faults(_rets(s, d), 480),
    "survivorship_audit": lambda s, d: c.survivorship(read(s, d, "part").select(F.col("p_partkey").alias("symbol")), _listings(s, d), F.to_date(F.lit("1992-02-01")), F.to_date(F.lit("1998-11-20"))),
    "closed_session_rows": lambda s, d: c.closed_session_rows(read(s, d, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("scope")), "ts", "scope", _holidays(s, d).join(read(s, d, "orders").select(F.col("o_orderpriority").alias("scope")).distinct().where("scope < '3'"))),
    "by_priority": lambda s, d: c.by_priority([_priced(s, d).where("o_orderkey % 3 = 0"), _priced(s, d).where("o_orderkey % 2 = 0").withColumn("price", F.col("price") + 1), _priced(s, d)], ["o_orderkey"], "price").withColumn("source", F.col("source").cast("int")),
    "book_mismatches": lambda s, d: c.book_mismatches(_orders(s, d, False), _orders(s, d, True), "o_orderkey", "price", 0.5),
    "attempts": lambda s, d: c.attempts(read(s, d, "orders").select(F.col("o_orderkey").alias("unit")), _tries(s, d), "unit", "ok", ["attempt"]),
    "allowed_rows": lambda s, d: c.allowed(read(s, d, "orders").select("o_orderkey", "o_orderpriority"), read(s, d, "orders").select(F.col("o_orderpriority").alias("provider"), F.when(F.col("o_orderpriority") < "3", "trade").otherwise("study").alias("usage")).distinct(), "o_orderpriority", "trade"),
    "lineage": lambda s, d: c.ancestors(_edges(s, d), lambda df: written(df, "lineage")),
}

_PRICED = "priced AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_totalprice AS DOUBLE) END AS price, CAST(o_custkey % 5 + o_orderkey % 7 - 1 AS BIGINT) AS rank, o_orderstatus AS status FROM orders)"
_HOLIDAYS = "holidays AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE month(o_orderdate) = 12 AND day(o_orderdate) IN (24, 25, 31))"
_MISSING = f"""{BARS_SQL}, {_HOLIDAYS}, span AS (SELECT symbol, min(date) AS a, max(date) AS b FROM bars GROUP BY symbol),
days AS (SELECT symbol, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
lost AS (SELECT * FROM days d WHERE isodow(date) < 6 AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = d.symbol AND b.date = d.date))"""
_SCORES = """past AS (SELECT *, abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) AS r FROM bars),
sums AS (SELECT symbol, count(*) AS n, count(*) FILTER (high < low OR high < greatest(open, close) OR low > least(open, close)) AS impossible, count(*) FILTER (least(open, high, low, close) <= 0) AS not_positive, count(*) FILTER (r > 0.13) AS extreme FROM past GROUP BY symbol),
sc AS (SELECT s.*, coalesce(g.missing, 0) AS missing FROM sums s LEFT JOIN gaps g USING (symbol)),
sd AS (SELECT *, round(greatest(1 - CASE WHEN impossible > 0 THEN 0.4::DOUBLE ELSE 0 END - CASE WHEN not_positive > 0 THEN 0.2::DOUBLE ELSE 0 END - 0.05::DOUBLE * least(extreme, 5) - 0.01::DOUBLE * least(missing, 30), 0), 4) AS score FROM sc),
scored AS (SELECT *, CASE WHEN impossible > 0 OR score <= 0 THEN 'rejected' WHEN score < 0.5 THEN 'quarantined' WHEN score < 0.85 THEN 'warning' ELSE 'approved' END AS decision FROM sd)"""
_OLD = "old AS (SELECT o_orderkey AS k, o_orderkey % 400 AS grp, CAST(o_totalprice AS DOUBLE) AS price FROM orders WHERE o_orderkey % 97 <> 1), new AS (SELECT o_orderkey AS k, o_orderkey % 400 AS grp, CAST(o_totalprice AS DOUBLE) + CASE WHEN o_orderkey % 97 = 3 THEN 1 ELSE 0 END AS price FROM orders WHERE o_orderkey % 97 <> 2)"
_DIFF = f"""{_OLD}, j AS (SELECT old.k AS ka, new.k AS kb, coalesce(new.grp, old.grp) AS grp, old.price AS a, new.price AS b FROM old FULL JOIN new ON old.k = new.k),
s AS (SELECT grp, count(*) FILTER (ka IS NULL) AS added, count(*) FILTER (kb IS NULL) AS removed, count(*) FILTER (ka IS NOT NULL AND kb IS NOT NULL AND abs(a - b) > 1e-9 + 1e-6 * abs(b)) AS cells, count(ka) AS n, count(kb) AS m FROM j GROUP BY grp),
diff AS (SELECT grp, added, removed, cells, CASE WHEN n = 0 THEN 'added' WHEN m = 0 THEN 'removed' WHEN added + removed + cells > 0 THEN 'changed' ELSE 'unchanged' END AS state FROM s)"""
_HEX8 = " + ".join(f"CAST((instr('0123456789abcdef', substr(m, {i + 1}, 1)) - 1) * {16 ** (7 - i)} AS BIGINT)" for i in range(8))

ORACLE = {
    "field_checks": f"WITH {_PRICED}, s AS (SELECT count(*) FILTER (price IS NULL) AS np, count(*) FILTER (rank <= 0) AS pr, count(*) FILTER (o_orderkey <= 0) AS po FROM priced) SELECT 'o_orderkey' AS field, 0::BIGINT AS nulls, po AS not_positive, po = 0 AS passed FROM s UNION ALL SELECT 'price', np, 0, np = 0 FROM s UNION ALL SELECT 'rank', 0, pr, pr = 0 FROM s UNION ALL SELECT 'status', 0, 0, true",
    "price_jumps": f"WITH {BARS_SQL}, r AS (SELECT symbol, abs(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date))) AS r FROM bars) SELECT symbol, count(*) FILTER (r > 0.1) AS errors, count(*) FILTER (r > 0.05 AND r <= 0.1) AS warnings FROM r GROUP BY symbol",
    "availability_leaks": f"WITH {_PRICED} SELECT status, count(*) AS n, count(*) FILTER (date + CAST(o_orderkey % 60 AS INT) > DATE '1998-06-01') AS leaks, 0::BIGINT AS unknown FROM priced GROUP BY status",
    "stale_series": f"WITH {BARS_SQL}, l AS (SELECT symbol, max(date) AS last FROM bars GROUP BY symbol) SELECT symbol, last, CAST(date_diff('day', last, DATE '1998-12-01') AS INT) AS days, date_diff('day', last, DATE '1998-12-01') > 3 AS stale FROM l",
    "sequence_faults": "WITH a AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_orderkey * 10 + l_linenumber AS seq FROM lineitem), b AS (SELECT *, date <= lag(date) OVER (PARTITION BY symbol ORDER BY seq, date) AS back FROM a) SELECT symbol, count(*) - count(DISTINCT date) AS repeated, count(*) FILTER (back) AS backward FROM b GROUP BY symbol",
    "missing_sessions": f"WITH {_MISSING} SELECT symbol, date FROM lost WHERE date NOT IN (SELECT date FROM holidays)",
    "unexpected_sessions": f"WITH {BARS_SQL}, {_HOLIDAYS} SELECT symbol, count(*) FILTER (isodow(date) > 5) AS weekend, count(*) FILTER (date IN (SELECT date FROM holidays)) AS holiday FROM bars GROUP BY symbol",
    "quality_scores": f"WITH {_MISSING}, gaps AS (SELECT symbol, count(*) AS missing FROM lost WHERE date NOT IN (SELECT date FROM holidays) GROUP BY symbol), {_SCORES} SELECT symbol, n, impossible, not_positive, extreme, missing, score, decision FROM scored",
    "latest_state": f"WITH {_PRICED} SELECT o_custkey, arg_max(status, date * 1 ) AS status, count(*) AS n FROM priced GROUP BY o_custkey".replace("arg_max(status, date * 1 )", "arg_max(status, (date, o_orderkey))"),
    "decision_coverage": f"WITH {_MISSING}, gaps AS (SELECT symbol, count(*) AS missing FROM lost GROUP BY symbol), {_SCORES} SELECT coalesce(decision, 'missing') AS decision, count(*) AS n FROM part LEFT JOIN scored ON p_partkey = symbol GROUP BY 1",
    "content_hash": f"WITH r AS (SELECT o_orderstatus, md5(concat_ws(chr(31), CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority)) AS m FROM orders) SELECT o_orderstatus, count(*) AS n, CAST(sum({_HEX8}) AS BIGINT) AS digest FROM r GROUP BY o_orderstatus",
    "dataset_diff": f"WITH {_DIFF} SELECT grp, added, removed, cells, state FROM diff",
    "stale_artefacts": f"WITH {_DIFF} SELECT CAST(p_size % 10 AS INT) AS artefact, count(DISTINCT p_partkey % 400) AS changed FROM part JOIN diff ON p_partkey % 400 = grp WHERE state <> 'unchanged' GROUP BY 1",
    "expectations": f"""WITH {_PRICED}, s AS (SELECT count(*) AS n, count(*) FILTER (price IS NULL) AS a, count(*) - count(DISTINCT o_orderkey) AS b, count(*) - count(DISTINCT price) - CASE WHEN count(*) FILTER (price IS NULL) > 0 THEN 1 ELSE 0 END AS c,
count(*) FILTER (status NOT IN ('F', 'O')) AS d, count(*) FILTER (price IS NULL OR price NOT BETWEEN 1000 AND 300000) AS e, count(*) FILTER (NOT regexp_matches(status, '^(?:F|P)')) AS f FROM priced),
x AS (SELECT unnest(['not_null', 'unique', 'unique', 'in_set', 'between', 'matches', 'not_null']) AS rule, unnest(['price', 'o_orderkey', 'price', 'status', 'price', 'status', 'absent']) AS field, unnest([a, b, c, d, e, f, n]) AS failed FROM s) SELECT rule, field, failed, failed = 0 AS passed FROM x""",
    "table_audit": f"WITH {_PRICED}, k AS (SELECT o_custkey, date, count(*) AS k, sum(CASE WHEN price IS NULL THEN 1 ELSE 0 END + CASE WHEN status IS NULL THEN 1 ELSE 0 END) AS n FROM priced GROUP BY ALL) SELECT CAST(sum(k) AS BIGINT) AS rows, CAST(sum(n) AS BIGINT) AS nulls, CAST(sum(k - 1) AS BIGINT) AS duplicates, count(*) FILTER (k > 1) AS duplicate_keys FROM k".replace("AS rows,", 'AS "rows",'),
    "return_panel_faults": f"WITH {_RETS} SELECT symbol, count(*) AS n, count(*) FILTER (ret IS NULL) AS missing, count(*) FILTER (ret < -1) AS below, count(*) - count(DISTINCT date) AS repeated, count(*) FILTER (abs(ret) > 1e-12) AS active, count(*) FILTER (ret < -1) = 0 AND count(*) = count(DISTINCT date) AND count(*) >= 480 AND count(*) FILTER (abs(ret) > 1e-12) > 0 AS usable FROM rets GROUP BY symbol",
    "survivorship_audit": f"WITH {BARS_SQL}, l AS (SELECT symbol, min(date) AS a, CASE WHEN symbol % 4 <> 0 THEN max(date) END AS b FROM bars GROUP BY symbol), f AS (SELECT p_partkey AS symbol, CASE WHEN l.symbol IS NULL THEN 'no_listing' WHEN a > DATE '1992-02-01' THEN 'not_listed_yet' WHEN b < DATE '1998-11-20' THEN 'delisted' END AS finding FROM part LEFT JOIN l ON l.symbol = p_partkey) SELECT * FROM f WHERE finding IS NOT NULL",
    "closed_session_rows": f"WITH {_HOLIDAYS}, w AS (SELECT o_orderpriority AS scope, CASE WHEN isodow(o_orderdate) > 5 THEN 'weekend' WHEN o_orderpriority < '3' AND CAST(o_orderdate AS DATE) IN (SELECT date FROM holidays) THEN 'holiday' END AS why FROM orders) SELECT scope, why, count(*) AS n FROM w WHERE why IS NOT NULL GROUP BY ALL",
    "by_priority": f"WITH {_PRICED} SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN price WHEN o_orderkey % 2 = 0 THEN price + 1 ELSE price END AS price, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS INT) AS source, CAST(1 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS sources FROM priced WHERE price IS NOT NULL",
    "book_mismatches": f"WITH {_OLD} SELECT coalesce(old.k, new.k) AS o_orderkey, CASE WHEN old.k IS NULL THEN 'not_in_book' WHEN new.k IS NULL THEN 'not_at_broker' ELSE 'differs' END AS kind, old.price AS ours, new.price AS theirs FROM old FULL JOIN new ON old.k = new.k WHERE old.k IS NULL OR new.k IS NULL OR abs(old.price - new.price) > 0.5",
    "attempts": "WITH a AS (SELECT l_orderkey AS unit, min(l_linenumber) AS attempt, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) SELECT o_orderkey AS unit, CAST(attempt AS INT) AS attempt, coalesce(n, 1) - 1 AS extra, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'accepted' END AS state FROM orders LEFT JOIN a ON unit = o_orderkey",
    "allowed_rows": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority < '3'",
    "lineage": "WITH RECURSIVE k AS (SELECT CAST(p_partkey AS BIGINT) AS child FROM part WHERE p_partkey >= 2), e AS (SELECT child, child // 2 AS parent FROM k UNION ALL SELECT child, child // 3 FROM k WHERE child % 3 = 0), t AS (SELECT child AS node, parent AS ancestor FROM e UNION SELECT t.node, e.parent FROM t JOIN e ON e.child = t.ancestor) SELECT DISTINCT node, ancestor FROM t",
}
