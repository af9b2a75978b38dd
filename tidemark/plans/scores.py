"""Queries of predictor scores and of corporate actions, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.common import dealt, written
from tidemark.operators import scores
from tidemark.plans.market import _r
from tidemark.sources.derived import BARS_SQL, bars, read

#: (signal, sign, horizon, family, grp, quality, t_again, t_first, q_cut, breakpoints, form, filters, absent_status, absent_source)
DEFINITIONS = [
    ("mom", 1.0, 1, "momentum", "trend", "1_good", 4.2, 5.0, 0.1, None, "continuous", None, None, None),
    ("near_high", 1.0, 1, "momentum", "trend", "2_fair", 3.1, None, 0.2, "NYSE", "continuous", "abs(prc) > 1", None, None),
    ("turn", -1.0, 1, "liquidity", None, "1_good", 2.5, 2.9, 0.2, None, "continuous", "exchcd %in% c(1,2), abs(prc)>5", None, None),
    ("swing", -1.0, 1, "risk", None, "3_distant", 9.0, 1.5, 0.3, "nyse", "continuous", "shrcd<=11", None, None),
    ("days", 1.0, 3, "attention", None, None, 1.0, 3.0, None, None, "discrete", "me > me_nyse20", None, None),
    ("rise", 1.0, 3, "momentum", None, "4_lack_data", 2.0, 2.0, 0.2, None, "discrete", "none", None, None),
    ("spread", None, 3, "risk", "wide", "1_good", 3.3, 4.1, 0.25, None, None, "exchcd%in%c(1,2,3)", None, None),
    ("odd", 1.0, 12, "risk", None, "1_good", 3.0, 3.0, 0.2, None, "continuous", "siccd != 6000", None, None),
    ("flat", 1.0, 12, "other", None, "1_good", 3.0, 3.0, 0.2, None, "continuous", "", None, None),
    ("void", 1.0, 20, "other", None, "1_good", 3.0, 3.0, 0.2, None, "continuous", "", "proxy", "snapshot"),
    ("size", -1.0, 11, "size", None, "2_fair", 2.2, 2.4, 0.2, None, "continuous", "exchcd==1", None, None),
]
_SCHEMA = "signal string, sign double, horizon int, family string, grp string, quality string, t_again double, t_first double, q_cut double, breakpoints string, form string, filters string, absent_status string, absent_source string"


def _quarters(s, d):
    x = bars(s, d).withColumn("as_of", F.last_day(F.add_months(F.trunc("date", "quarter"), 2)))
    mean = F.avg((F.col("high") - F.col("low")) / F.col("close"))
    x = dealt(x, read(s, d, "lineitem").count(), "symbol", "as_of")  # no more bars than lines
    return x.groupBy("symbol", "as_of").agg(F.min_by("close", "date").alias("first"), F.max_by("close", "date").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"), F.round(mean, 9).alias("swing"), F.count("*").alias("n"), F.max("date").alias("seen"))


def _features(s, d):
    q = written(_quarters(s, d), "quarters")  # values and context both read it
    k = F.col("symbol")
    mom = F.round(F.col("last") / F.col("first") - 1, 9)
    found = {
        "mom": mom, "near_high": F.round(F.col("last") / F.col("high") - 1, 9), "turn": F.when(k % 11 != 0, F.col("volume")), "swing": F.col("swing"), "days": F.col("n").cast("double"), "rise": F.signum(mom),
        "spread": F.when(F.col("n") >= 3, F.round(F.col("high") / F.col("low") - 1, 9)), "odd": F.col("volume"), "flat": F.lit(1.0), "size": F.when(k % 5 != 0, F.col("volume") * F.col("n")),
    }
    status = lambda name: F.when(k % 3 == (0 if name in ("mom", "days", "size") else 3), "proxy").otherwise("exact")
    one = [F.struct(F.lit(name).alias("signal"), c.cast("double").alias("raw"), status(name).alias("status"), F.lit(f"src_{name}").alias("source"), F.lit(f"f_{name}").alias("formula")) for name, c in found.items()]
    values = q.select("as_of", "symbol", F.explode(F.array(*one)).alias("v"), F.col("seen").alias("available_at")).select("as_of", "symbol", "v.*", "available_at").where("not (signal = 'turn' and symbol % 7 = 0)")
    context = q.select("as_of", "symbol", (k % 4).cast("int").alias("exchange"), F.col("last").alias("price"), (k % 6 != 0).alias("common"), (F.col("last") * F.col("volume")).alias("cap"))
    return scores.feature_table(values, s.createDataFrame(DEFINITIONS, _SCHEMA), context, least_rows=2, least_share=0.05)


def _held(s, d):
    return written(_features(s, d), "features")


def _composite(s, d):
    return scores.composite_scores(_held(s, d), 2, 2.0, 0.35)


QUERIES = {
    "score_features": lambda s, d: _r(_features(s, d), "as_of", "symbol", "signal", "status", "value_status", "source", "age_days", "horizon", "grp", "passed", "filter_status", "bucket", *[F.round(c, 9).alias(c) for c in ("raw", "weight")], pct="pct", score_pct="score_pct"),
    "composite_scores": lambda s, d: _r(_composite(s, d), "as_of", "symbol", "horizon", "signals_used", "signals_expected", "groups_used", "groups_expected", "enough", F.round("confidence", 9).alias("confidence"), raw_score="raw_score", score="score", largest_family="largest_family"),
    "score_contributions": lambda s, d: _r(scores.contributions(_held(s, d), 2.0, 0.35), "as_of", "symbol", "signal", "observed", score_weight="score_weight", added="added", against_neutral="against_neutral"),
    # means of two scores of nine places end in a five at the tenth
    "aggregate_scores": lambda s, d: _r(scores.aggregate_scores(_composite(s, d), [1, 3], 60.0), "as_of", "symbol", "horizons_used", "reason", "ranked", *[F.round(c, 10).alias(c) for c in ("raw_score", "score", "confidence")]),
    "signal_coverage": lambda s, d: _r(scores.signal_coverage(_features(s, d)), "as_of", "signal", "family", "symbols", "exact_rows", "proxy_rows", "coverage", "with_value", "without", "value_sources", "gap_sources", coverage_pct="coverage_pct"),
}

_PROXY = "CASE WHEN symbol % 3 = 0 THEN 'proxy' ELSE 'exact' END"
_VALUES = {
    "mom": ("round(last / first - 1, 9)", _PROXY), "near_high": ("round(last / high - 1, 9)", "'exact'"), "turn": ("CASE WHEN symbol % 11 <> 0 THEN volume END", "'exact'"), "swing": ("swing", "'exact'"),
    "days": ("n", _PROXY), "rise": ("sign(round(last / first - 1, 9))", "'exact'"), "spread": ("CASE WHEN n >= 3 THEN round(high / low - 1, 9) END", "'exact'"), "odd": ("volume", "'exact'"), "flat": ("1", "'exact'"),
    "size": ("CASE WHEN symbol % 5 <> 0 THEN volume * n END", _PROXY),
}
#: What each definition comes to, by hand: sign, horizon, family, group, strength, quantile, NYSE alone, continuous, what an eligible security meets, status of the filter, status and source where there is no value.
_RULES = ", ".join(
    [
        "('mom', 1, 1, 'momentum', 'trend', 0.525 * 0.625, 0.1, false, true, 'none', 'unavailable', 'no_formula')",
        "('near_high', 1, 1, 'momentum', 'trend', 0.3875 * 0.7 * 0.85, 0.2, true, true, 'applied', 'unavailable', 'no_formula')",
        "('turn', -1, 1, 'liquidity', 'single_turn', 0.3125 * 0.3625, 0.2, false, true, 'applied', 'unavailable', 'no_formula')",
        "('swing', -1, 1, 'risk', 'single_swing', 1 * 0.1875 * 0.65, 0.3, true, true, 'applied', 'unavailable', 'no_formula')",
        "('days', 1, 3, 'attention', 'single_days', 0.125 * 0.375 * 0.7, 0.2, false, false, 'applied', 'unavailable', 'no_formula')",
        "('rise', 1, 3, 'momentum', 'single_rise', 0.25 * 0.25 * 0.4, 0.2, false, false, 'none', 'unavailable', 'no_formula')",
        "('spread', 1, 3, 'risk', 'wide', 0.4125 * 0.5125, 0.25, false, true, 'applied', 'unavailable', 'no_formula')",
        "('odd', 1, 12, 'risk', 'single_odd', 0.375 * 0.375, 0.2, false, true, 'unsupported:siccd!=6000', 'unavailable', 'no_formula')",
        "('flat', 1, 12, 'other', 'single_flat', 0.375 * 0.375, 0.2, false, true, 'none', 'unavailable', 'no_formula')",
        "('void', 1, 12, 'other', 'single_void', 0.375 * 0.375, 0.2, false, true, 'none', 'proxy', 'snapshot')",
        "('size', -1, 12, 'size', 'single_size', 0.275 * 0.3 * 0.85, 0.2, false, true, 'applied', 'unavailable', 'no_formula')",
    ]
)
_FEATURES = f"""WITH {BARS_SQL}, q AS (SELECT symbol, CAST(last_day(date_trunc('quarter', date) + INTERVAL 2 MONTH) AS DATE) AS as_of, arg_min(close, date) AS first, arg_max(close, date) AS last, max(high) AS high, min(low) AS low, sum(volume) AS volume, round(avg((high - low) / close), 9) AS swing, count(*) AS n, max(date) AS seen FROM bars GROUP BY 1, 2),
v AS ({" UNION ALL ".join(f"SELECT as_of, symbol, '{k}' AS signal, CAST({e} AS DOUBLE) AS raw, {st} AS status, seen FROM q" for k, (e, st) in _VALUES.items())}),
d(signal, sign, horizon, family, grp, strength, q_cut, nyse, line, fstat, astat, asrc) AS (SELECT * FROM (VALUES {_RULES}) z),
c AS (SELECT as_of, symbol, symbol % 4 AS exch, last AS price, symbol % 6 <> 0 AS common, last * volume AS cap, (SELECT quantile_cont(last * volume, 0.2) FROM q y WHERE y.as_of = q.as_of AND y.symbol % 4 = 1) AS cap20 FROM q),
g AS (SELECT c.as_of, c.symbol, d.*, v.raw, v.seen, exch, coalesce(v.status, astat) AS impl, CASE WHEN v.signal IS NULL THEN asrc ELSE 'src_' || d.signal END AS source, v.signal IS NOT NULL AS named,
 CAST(strength AS DOUBLE) * CASE WHEN v.raw IS NULL THEN 0 WHEN v.status = 'exact' THEN 1 ELSE 0.55 END AS potential,
 coalesce(CASE d.signal WHEN 'near_high' THEN price > 1 WHEN 'turn' THEN exch IN (1, 2) AND price > 5 WHEN 'swing' THEN common WHEN 'days' THEN cap > cap20 WHEN 'spread' THEN exch IN (1, 2, 3) WHEN 'odd' THEN false WHEN 'size' THEN exch = 1 ELSE true END, false) AS passed
 FROM c CROSS JOIN d LEFT JOIN v ON v.as_of = c.as_of AND v.symbol = c.symbol AND v.signal = d.signal AND NOT (v.signal = 'turn' AND v.symbol % 7 = 0)),
e AS (SELECT *, CASE WHEN raw IS NOT NULL AND passed THEN raw * sign END AS x, raw IS NOT NULL AND passed AND (NOT nyse OR exch = 1) AS ref FROM g),
l AS (SELECT as_of, signal, count(x) AS n, count(*) FILTER (ref) AS m, greatest(2, ceil(count(*) * 0.05)) AS need, list(x ORDER BY x) FILTER (ref) AS r, list(x) FILTER (x IS NOT NULL) AS xs, any_value(CAST(q_cut AS DOUBLE)) AS qc FROM e GROUP BY 1, 2),
mo AS (SELECT as_of, signal, max(k) AS most FROM (SELECT as_of, signal, x, count(*) AS k FROM e WHERE x IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
p AS (SELECT *, n < need OR m < need AS few, CASE WHEN m > 0 THEN (m - 1) * qc END AS a, CASE WHEN m > 0 THEN (m - 1) * (1 - qc) END AS z FROM l LEFT JOIN mo USING (as_of, signal)),
t AS (SELECT *, r[CAST(floor(a) AS INT) + 1] + (coalesce(r[CAST(floor(a) AS INT) + 2], r[CAST(floor(a) AS INT) + 1]) - r[CAST(floor(a) AS INT) + 1]) * (a - floor(a)) AS lo, r[CAST(floor(z) AS INT) + 1] + (coalesce(r[CAST(floor(z) AS INT) + 2], r[CAST(floor(z) AS INT) + 1]) - r[CAST(floor(z) AS INT) + 1]) * (z - floor(z)) AS hi,
 NOT few AND n >= 3 AND (most = n OR 1 - most / n < greatest(0.01, 2.0 / n)) AS dull FROM p),
f AS (SELECT e.as_of, e.symbol, e.signal, raw, impl, source, horizon, family, grp, potential, named, passed, CAST(e.as_of - seen AS INT) AS age_days, fstat || CASE WHEN few THEN '|cross_section_below_' || CAST(CAST(need AS INT) AS VARCHAR) ELSE '' END AS filter_status,
 CASE WHEN raw IS NULL THEN 'missing' WHEN NOT passed THEN 'filtered_out' WHEN few THEN 'few_values' WHEN dull THEN 'uninformative' ELSE 'available' END AS value_status,
 CASE WHEN x IS NULL OR few THEN 'unavailable' WHEN dull THEN 'uninformative' WHEN NOT line THEN 'discrete' WHEN lo < hi AND x >= hi THEN 'long' WHEN lo < hi AND x <= lo THEN 'short' ELSE 'neutral' END AS bucket,
 CASE WHEN x IS NOT NULL AND NOT few AND NOT dull THEN 100.0 * (len(list_filter(r, lambda y: y < x)) + len(list_filter(r, lambda y: y <= x))) / (2 * m) END AS pct FROM e JOIN t USING (as_of, signal)),
ft AS MATERIALIZED (SELECT *, CASE WHEN value_status = 'available' THEN impl ELSE 'unavailable' END AS status, CASE WHEN value_status = 'available' THEN potential ELSE 0 END AS weight, CASE WHEN bucket = 'neutral' THEN 50 ELSE pct END AS score_pct FROM f)"""
_WEIGHTS = f"""{_FEATURES}, s0 AS (SELECT as_of, horizon, signal, grp, family, max(potential) AS p0 FROM ft GROUP BY ALL HAVING max(potential) FILTER (impl IN ('exact', 'proxy')) > 0 AND bool_or(named)),
s1 AS (SELECT as_of, horizon, signal, grp, family, least(p0, 2 * median(p0) OVER (PARTITION BY as_of, horizon)) AS p1 FROM s0),
fg AS (SELECT as_of, horizon, grp, family, sum(p1) AS fp, count(*) AS k FROM s1 GROUP BY ALL),
gr AS (SELECT as_of, horizon, grp, first(family ORDER BY fp DESC, family) AS gfam, sum(fp) AS total, CAST(sum(k) AS INT) AS ns FROM fg GROUP BY ALL),
fa AS (SELECT as_of, horizon, gfam, sum(total / ns) AS ev FROM gr GROUP BY ALL),
-- a cap holds for a set of families when each of its rows is above the cap in what the rest leave; take the rounds one after another
w1 AS (SELECT *, count(*) OVER h AS nf, ev / sum(ev) OVER h > 0.35 + 1e-12 AS o1 FROM fa WINDOW h AS (PARTITION BY as_of, horizon)),
w2 AS (SELECT *, NOT o1 AND ev / sum(CASE WHEN NOT o1 THEN ev END) OVER h * (1 - 0.35 * count(*) FILTER (o1) OVER h) > 0.35 + 1e-12 AS o2 FROM w1 WINDOW h AS (PARTITION BY as_of, horizon)),
w3 AS (SELECT *, CASE WHEN nf * 0.35 < 1 - 1e-12 THEN 1.0 / nf WHEN o1 OR o2 THEN 0.35 ELSE ev / sum(CASE WHEN NOT (o1 OR o2) THEN ev END) OVER h * (1 - 0.35 * count(*) FILTER (o1 OR o2) OVER h) END AS share FROM w2 WINDOW h AS (PARTITION BY as_of, horizon)),
ww AS (SELECT s1.as_of, s1.horizon, s1.signal, s1.grp, p1 / total AS within, share * (total / ns) / ev AS gw, share, ns FROM s1 JOIN gr USING (as_of, horizon, grp) JOIN w3 USING (as_of, horizon, gfam)),
ob AS (SELECT ft.as_of, ft.symbol, ft.horizon, ft.signal, ft.grp, status IN ('exact', 'proxy') AND score_pct IS NOT NULL AND weight > 0 AS observed, score_pct, within * gw AS w, share, ns FROM ft JOIN ww USING (as_of, horizon, signal)),
ct AS MATERIALIZED (SELECT *, CASE WHEN observed THEN score_pct ELSE 50 END AS counted, w / sum(w) OVER (PARTITION BY as_of, symbol, horizon) AS sw FROM ob)"""
_SCORES = f"""{_WEIGHTS}, bg AS (SELECT as_of, symbol, horizon, grp, sum(counted * sw) AS added, sum(CASE WHEN observed THEN sw ELSE 0 END) AS seen, count(*) FILTER (observed) AS used, max(ns) AS expected, max(share) AS share FROM ct GROUP BY ALL),
sm AS (SELECT as_of, symbol, horizon, sum(added) AS added, sum(seen) AS seen, sum(used) AS signals_used, sum(expected) AS signals_expected, count(*) FILTER (used > 0) AS groups_used, count(*) AS groups_expected, max(share) AS largest_family FROM bg GROUP BY ALL),
sr AS (SELECT *, CASE WHEN signals_used >= 2 THEN round(added, 9) END AS raw_score FROM sm),
sk AS (SELECT *, CASE WHEN raw_score IS NULL THEN NULL WHEN count(raw_score) OVER h = 1 THEN 50 ELSE 100.0 * (rank() OVER (PARTITION BY as_of, horizon ORDER BY raw_score NULLS LAST) + (count(*) OVER (PARTITION BY as_of, horizon, raw_score) - 1) / 2 - 1) / (count(raw_score) OVER h - 1) END AS score FROM sr WINDOW h AS (PARTITION BY as_of, horizon)),
sc AS MATERIALIZED (SELECT as_of, symbol, horizon, raw_score, score, CASE WHEN signals_used >= 2 THEN least(100, 100 * seen) ELSE 0 END AS confidence, coalesce(signals_used, 0) AS signals_used, coalesce(signals_expected, 0) AS signals_expected, coalesce(groups_used, 0) AS groups_used, coalesce(groups_expected, 0) AS groups_expected, coalesce(signals_used >= 2, false) AS enough, largest_family
 FROM (SELECT as_of, symbol, unnest([1, 3, 6, 12, 36]) AS horizon FROM q) LEFT JOIN sk USING (as_of, symbol, horizon))"""

ORACLE = {
    "score_features": f"{_FEATURES} SELECT as_of, symbol, signal, status, value_status, source, age_days, horizon, grp, passed, filter_status, bucket, round(raw, 9) AS raw, round(CAST(weight AS DOUBLE), 9) AS weight, round(pct, 6) AS pct, round(CAST(score_pct AS DOUBLE), 6) AS score_pct FROM ft",
    "composite_scores": f"{_SCORES} SELECT as_of, symbol, horizon, CAST(signals_used AS BIGINT) AS signals_used, CAST(signals_expected AS BIGINT) AS signals_expected, CAST(groups_used AS BIGINT) AS groups_used, CAST(groups_expected AS BIGINT) AS groups_expected, enough, round(raw_score, 6) AS raw_score, round(CAST(score AS DOUBLE), 6) AS score, round(CAST(confidence AS DOUBLE), 9) AS confidence, round(CAST(largest_family AS DOUBLE), 6) AS largest_family FROM sc",
    "score_contributions": f"{_WEIGHTS} SELECT as_of, symbol, signal, observed, round(sw, 6) AS score_weight, round(counted * sw, 6) AS added, round((counted - 50) * sw, 6) AS against_neutral FROM ct",
    "aggregate_scores": f"""{_SCORES}, u AS (SELECT *, horizon IN (1, 3) AND score IS NOT NULL AND confidence > 0 AS ok FROM sc), a AS (SELECT as_of, symbol, sum(raw_score * confidence) FILTER (ok) / sum(confidence) FILTER (ok) AS raw_score, sum(score * confidence) FILTER (ok) / sum(confidence) FILTER (ok) AS score, coalesce(avg(confidence) FILTER (ok) * count(DISTINCT horizon) FILTER (ok) / 2, 0) AS confidence, count(DISTINCT horizon) FILTER (ok) AS horizons_used FROM u GROUP BY ALL),
b AS (SELECT *, CASE WHEN horizons_used = 0 THEN 'no_usable_horizons' WHEN horizons_used < 2 THEN 'incomplete_horizons' WHEN confidence < 60 THEN 'confidence_too_low' ELSE '' END AS reason FROM a) SELECT as_of, symbol, horizons_used, reason, reason = '' AS ranked, round(raw_score, 10) AS raw_score, round(CAST(score AS DOUBLE), 10) AS score, round(CAST(confidence AS DOUBLE), 10) AS confidence FROM b""",
    "signal_coverage": f"""{_FEATURES}, k AS (SELECT as_of, signal, any_value(family) AS family, count(*) AS symbols, count(*) FILTER (raw IS NOT NULL AND status = 'exact') AS exact_rows, count(*) FILTER (raw IS NOT NULL AND status = 'proxy') AS proxy_rows, coalesce(string_agg(DISTINCT source, ' | ' ORDER BY source) FILTER (raw IS NOT NULL), '') AS value_sources, coalesce(string_agg(DISTINCT source, ' | ' ORDER BY source) FILTER (raw IS NULL), '') AS gap_sources FROM ft GROUP BY 1, 2)
SELECT as_of, signal, family, symbols, exact_rows, proxy_rows, CASE WHEN exact_rows > 0 AND proxy_rows > 0 THEN 'mixed' WHEN exact_rows > 0 THEN 'exact' WHEN proxy_rows > 0 THEN 'proxy' ELSE 'unavailable' END AS coverage, exact_rows + proxy_rows AS with_value, symbols - exact_rows - proxy_rows AS without, value_sources, gap_sources, round(100.0 * (exact_rows + proxy_rows) / symbols, 6) AS coverage_pct FROM k""",
}
