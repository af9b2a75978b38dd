"""Queries of filings, over documents and archives that are made from the given tables, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.common import written
from tidemark.sources import filings
from tidemark.sources.derived import read

#: An archive is packed and opened in one task, so more filings make more archives, not larger ones.
FILINGS = 2500
_COVER = "CASE WHEN k % 4 = 0 THEN 'RESTATEMENT' WHEN k % 4 = 1 THEN 'NEW HOLDINGS' ELSE '' END"


def _documents(s, d):
    """A document of facts for each customer: sums and counts of its orders by year, some of them damaged."""
    year = F.year("o_orderdate")
    o = read(s, d, "orders").groupBy("o_custkey", year.alias("fy")).agg(F.sum(F.col("o_totalprice").cast("decimal(15,2)")).alias("total"), F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    text = lambda c: c.cast("string")
    entry = lambda value: F.struct(text(F.concat("fy", F.lit("-01-01"))).alias("start"), F.when(F.col("last") % 19 != 0, F.concat("fy", F.lit("-12-31"))).alias("end"), value.alias("val"), text(F.col("last")).alias("accn"), F.col("fy"), F.lit("FY").alias("fp"), F.lit("10-K").alias("form"), F.concat(F.col("fy") + 1, F.lit("-02-15")).alias("filed"))
    g = o.groupBy("o_custkey").agg(F.collect_list(entry(F.when(F.col("last") % 13 == 0, F.lit("n/a")).otherwise(text(F.col("total"))))).alias("usd"), F.array_sort(F.collect_list(entry(text(F.col("n"))))).alias("pure"))
    tag = lambda unit, rows: F.struct(F.lit("label").alias("label"), F.create_map(F.lit(unit), rows).alias("units"))
    facts = F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Revenues"), tag("USD", F.col("usd"))), F.lit("dei"), F.create_map(F.lit("OrderCount"), tag("pure", F.concat("pure", F.slice("pure", 1, 1)))))
    text_ = F.to_json(F.struct(F.col("o_custkey").alias("cik"), F.concat(F.lit("Entity "), F.col("o_custkey")).alias("entityName"), facts.alias("facts")))
    return g.select(F.when(F.col("o_custkey") % 17 == 0, F.substring(text_, 1, 60)).otherwise(text_).alias("json"))


def _facts(s, d):
    return filings.normal_facts(filings.company_facts(_documents(s, d)))


def _archives(s, d):
    """Archives by year and manager's number, of some FILINGS each: every order is a filing, its lines are holdings."""
    at = F.to_date("o_orderdate")
    many = max(8, read(s, d, "orders").count() // (7 * FILINGS))  # there are seven years
    o = read(s, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", at.alias("at"), F.concat_ws("-", F.year(at), F.col("o_custkey") % many).alias("path"))
    period = F.date_sub(F.add_months(F.trunc("at", "quarter"), 3), 1)
    text = lambda c: c.cast("string")
    sub = o.select("path", text(F.col("k")).alias("ACCESSION_NUMBER"), text(F.col("at")).alias("FILING_DATE"), F.expr("CASE WHEN k % 4 < 2 THEN '13F-HR/A' ELSE '13F-HR' END").alias("SUBMISSIONTYPE"), F.lpad(text(F.col("o_custkey")), 10, "0").alias("CIK"), F.upper(F.date_format(period, "dd-MMM-yyyy")).alias("PERIODOFREPORT"))
    cover = o.select("path", text(F.col("k")).alias("ACCESSION_NUMBER"), F.expr(_COVER).alias("AMENDMENTTYPE"))
    line = read(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("k"))
    info = line.select("path", text(F.col("k")).alias("ACCESSION_NUMBER"), F.concat(F.lit("issuer "), F.col("l_partkey") % 50).alias("NAMEOFISSUER"), F.lit("COM").alias("TITLEOFCLASS"), F.lpad(text(F.col("l_partkey")), 9, "0").alias("CUSIP"), text(F.round(F.col("l_extendedprice").cast("double")).cast("long")).alias("VALUE"), text(F.col("l_quantity").cast("int")).alias("SSHPRNAMT"), F.expr("CASE WHEN l_linenumber = 7 THEN 'PRN' ELSE 'SH' END").alias("SSHPRNAMTTYPE"), F.expr("CASE WHEN l_linenumber = 6 THEN 'PUT' ELSE '' END").alias("PUTCALL"), F.lit("SOLE").alias("INVESTMENTDISCRETION"))
    return filings.zipped({"SUBMISSION": sub, "COVERPAGE": cover, "INFOTABLE": info}, "path")


def _holdings(s, d, additions=False):
    return filings.holdings(written(filings.archive_rows(_archives(s, d)), "archive-rows"), additions)


def _summed(found):
    return found.groupBy(F.col("manager").cast("long").alias("manager"), "period").agg(F.count("*").alias("n"), F.sum("shares").alias("shares"), F.sum("value").alias("value"))


QUERIES = {
    "company_facts": lambda s, d: _facts(s, d)[0].select("cik", "tag", "unit", "fy", F.col("value").cast("double").alias("value"), F.datediff("end", "start").alias("days")),
    "fact_quarantine": lambda s, d: _facts(s, d)[1].groupBy("fault").agg(F.count("*").alias("n")),
    "filed_holdings": lambda s, d: _summed(_holdings(s, d)[1]),
    "filed_holdings_added": lambda s, d: _summed(_holdings(s, d, True)[1]),
    "filing_exclusions": lambda s, d: _holdings(s, d)[2].select(F.col("manager").cast("long").alias("manager"), "period", F.col("accession").cast("long").alias("accession"), "amendment_type"),
}

_FACTS = """o AS (SELECT o_custkey AS cik, year(o_orderdate) AS fy, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS total, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1, 2),
f AS (SELECT cik, fy, last, 'Revenues' AS tag, 'USD' AS unit, CASE WHEN last % 13 <> 0 THEN total END AS value FROM o WHERE cik % 17 <> 0 UNION ALL SELECT cik, fy, last, 'OrderCount', 'pure', n FROM o WHERE cik % 17 <> 0),
j AS (SELECT *, CASE WHEN value IS NULL THEN 'value' WHEN last % 19 = 0 THEN 'end' END AS fault FROM f)"""
_FILED = f"""o AS (SELECT o_orderkey AS k, o_custkey AS manager, CAST(o_orderdate AS DATE) AS filed, CAST(date_trunc('quarter', CAST(o_orderdate AS DATE)) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period FROM orders WHERE o_custkey <> 0),
x AS (SELECT *, k % 4 < 2 AS amends, {_COVER} AS kind, row_number() OVER (PARTITION BY manager, period ORDER BY filed, CAST(k AS VARCHAR)) AS i FROM o),
y AS (SELECT *, max(CASE WHEN NOT amends THEN i END) OVER w AS f, max(CASE WHEN amends THEN i END) OVER w AS l, max(CASE WHEN NOT amends OR kind = 'RESTATEMENT' THEN i END) OVER w AS wh FROM x WINDOW w AS (PARTITION BY manager, period)),
li AS (SELECT l_orderkey AS k, l_partkey, l_partkey % 50 AS issuer, sum(l_quantity)::DOUBLE AS shares, sum(CAST(round(CAST(l_extendedprice AS DOUBLE)) AS BIGINT))::DOUBLE AS value FROM lineitem WHERE l_linenumber < 6 AND l_quantity > 0 GROUP BY 1, 2, 3)"""
_HELD = lambda which: f"WITH {_FILED} SELECT manager, period, count(*) AS n, sum(shares) AS shares, sum(value) AS value FROM y JOIN li USING (k) WHERE {which} GROUP BY 1, 2"

ORACLE = {
    "company_facts": f"WITH {_FACTS} SELECT cik, tag, unit, CAST(fy AS INT) AS fy, value, CAST(make_date(CAST(fy AS INT), 12, 31) - make_date(CAST(fy AS INT), 1, 1) AS INT) AS days FROM j WHERE fault IS NULL",
    "fact_quarantine": f"""WITH {_FACTS}, b AS (SELECT 'json' AS fault FROM (SELECT DISTINCT cik FROM o WHERE cik % 17 = 0) UNION ALL SELECT fault FROM j WHERE fault IS NOT NULL
UNION ALL SELECT CASE WHEN arg_min(last, fy) % 19 = 0 THEN 'end' ELSE 'repeated' END FROM o WHERE cik % 17 <> 0 GROUP BY cik)
SELECT fault, count(*) AS n FROM b GROUP BY fault""",
    "filed_holdings": _HELD("(l IS NULL AND i = f) OR (i = l AND kind = 'RESTATEMENT')"),
    "filed_holdings_added": _HELD("wh IS NOT NULL AND (i = wh OR (amends AND kind = 'NEW HOLDINGS' AND i > wh))"),
    "filing_exclusions": f"WITH {_FILED} SELECT manager, period, k AS accession, kind AS amendment_type FROM y WHERE i = l AND kind <> 'RESTATEMENT'",
}
