"""Predictor scores on small tables: filters, ties, gaps, caps and empty tables against plain Python."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from tidemark import common
from tidemark.operators import scores

AS_OF = dt.date(2024, 3, 31)
DEF = "signal string, sign double, horizon int, family string, grp string, quality string, t_again double, t_first double, q_cut double, breakpoints string, form string, filters string, absent_status string, absent_source string"
VAL = "as_of date, symbol string, signal string, raw double, status string, source string, formula string, available_at date"
CTX = "as_of date, symbol string, exchange int, price double, common boolean, cap double"


def _define(name, **over):
    row = {"signal": name, "sign": 1.0, "horizon": 1, "family": name, "grp": None, "quality": "1_good", "t_again": 4.0, "t_first": 4.0, "q_cut": 0.2, "breakpoints": None, "form": "continuous", "filters": None, "absent_status": None, "absent_source": None} | over
    return tuple(row[c.split()[0]] for c in DEF.split(", "))


def _value(symbol, signal, raw, status="exact"):
    return (AS_OF, symbol, signal, raw, status, "s", "f", dt.date(2024, 3, 1))


def _context(symbols, **over):
    return [(AS_OF, s, over.get("exchange", 1), over.get("price", 10.0), over.get("common", True), float(k)) for k, s in enumerate(symbols)]


def test_filters_fail_closed(spark):
    texts = [None, " ", "NaN", "abs(prc)>1,exchcd%in%c(1,2)", "ABS( prc ) > 5 , ,shrcd %in% c(10,11)", "abs(prc)>2", "x,abs(prc)>1,a", "abs(prc)>1)", ")abs(prc)>1(", "((", ","]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, filters string")
    got = {r.k: (r.filter_status, r.clauses) for r in scores.parsed_filters(df).collect()}
    assert [got[k][0] for k in range(11)] == ["none", "none", "none", "applied", "applied", "unsupported:abs(prc)>2", "unsupported:a|x", *["unsupported:unbalanced_parentheses"] * 3, "applied"]
    assert got[3][1] == ["abs(prc)>1", "exchcd%in%c(1,2)"] and got[4][1] == ["abs(prc)>5", "shrcd%in%c(10,11)"]


def _table(spark, values, definitions, context, **over):
    x = scores.feature_table(spark.createDataFrame(values, VAL), spark.createDataFrame(definitions, DEF), spark.createDataFrame(context, CTX), **over)
    return {(r.symbol, r.signal): r for r in x.collect()}


def test_feature_table_ties_gaps_and_repeats(spark):
    symbols = [f"s{k}" for k in range(10)]
    raws = [1.0, 1.0, 2.0, 3.0, 3.0, 3.0, 7.0, float("nan"), None, 9.0]
    values = [_value(s, "a", r) for s, r in zip(symbols, raws, strict=True)] + [_value("s0", "a", 1.0), _value("zz", "a", 5.0), _value("s1", "unknown", 5.0), (None, "s1", "a", 4.0, "exact", "s", "f", None)]
    values += [_value(s, "same", 4.0) for s in symbols] + [_value("s0", "few", 1.0)] + [_value(s, "closed", 1.0 * k) for k, s in enumerate(symbols)] + [_value(s, "step", float(k % 3)) for k, s in enumerate(symbols)]
    definitions = [_define("a"), _define("same"), _define("few"), _define("closed", filters="anything"), _define("step", form="discrete", sign=-1.0, horizon=20), _define("none", absent_status="proxy", absent_source="later")]
    got = _table(spark, values, definitions, _context(symbols) + [(AS_OF, "s0", 1, 10.0, True, 0.0), (None, "s1", 1, 1.0, True, 1.0)], least_rows=2)
    assert len(got) == 60
    held = [r for r in raws if r is not None and r == r]
    for s, r in zip(symbols, raws, strict=True):
        row = got[s, "a"]
        if r is None or r != r:
            assert (row.raw, row.value_status, row.status, row.bucket, row.pct, row.score_pct, row.weight) == (None, "missing", "unavailable", "unavailable", None, None, 0.0)
        else:
            assert row.pct == pytest.approx(100 * (sum(x < r for x in held) + sum(x <= r for x in held)) / 16)
            assert row.bucket == ("short" if r <= 1.4 else "long" if r >= 5.4 else "neutral") and row.score_pct == (50 if row.bucket == "neutral" else row.pct)
            assert row.weight == row.potential == pytest.approx(0.25) and row.age_days == 30
    assert {got[s, "same"].value_status for s in symbols} == {"uninformative"} and got["s0", "same"].potential == pytest.approx(0.25)
    assert got["s0", "few"].value_status == "few_values" and got["s0", "few"].filter_status == "none|cross_section_below_2" and got["s1", "few"].value_status == "missing"
    assert {got[s, "closed"].value_status for s in symbols} == {"filtered_out"} and not got["s3", "closed"].passed
    assert got["s0", "step"].bucket == "discrete" and got["s0", "step"].pct > got["s1", "step"].pct > got["s2", "step"].pct and got["s0", "step"].horizon == 12
    assert (got["s0", "none"].implementation, got["s0", "none"].source, got["s0", "none"].formula) == ("proxy", "later", "")


def test_breakpoints_of_one_exchange(spark):
    symbols = [f"s{k}" for k in range(8)]
    context = [(AS_OF, s, 1 if k < 4 else 3, 10.0, None if k == 0 else True, float(k)) for k, s in enumerate(symbols)]
    values = [_value(s, sig, float(k)) for k, s in enumerate(symbols) for sig in ("n", "big", "common")]
    got = _table(spark, values, [_define("n", breakpoints=" nyse "), _define("big", filters="me>me_nyse20"), _define("common", filters="shrcd<=11")], context)
    assert [got[s, "n"].pct for s in symbols] == [12.5, 37.5, 62.5, 87.5, 100, 100, 100, 100]
    assert [got[s, "big"].passed for s in symbols] == [False] + [True] * 7  # the fifth part of 0, 1, 2, 3 is 0.6
    assert [got[s, "common"].passed for s in symbols] == [False] + [True] * 7


def _water(amounts, cap):
    found, left, rest = {}, dict(amounts), 1.0
    if len(left) * cap < 1 - 1e-12:
        return {k: 1 / len(left) for k in left}
    while left:
        total = sum(left.values())
        over = [k for k, a in left.items() if a / total * rest > cap + 1e-12]
        if not over:
            return found | {k: a / total * rest for k, a in left.items()}
        rest -= cap * len(over)
        for k in over:
            found[k] = cap
            del left[k]
    return found


def test_capped_shares_equal_rounds_of_capping(spark):
    cases = [[5, 3, 2, 1, 1, 1, 1], [1, 1, 1], [10, 10, 1, 1, 1, 1], [4, 4, 4, 4], [100, 50, 25, 12, 6, 3, 1, 1], [7], [1, 2, 3, 4, 5, 6]]
    rows = [(c, k, float(a)) for c, case in enumerate(cases) for k, a in enumerate(case)]
    for cap in (0.15, 0.25, 0.5, 1.0):
        got = {(r.c, r.k): r.share for r in scores.capped_shares(spark.createDataFrame(rows + [(9, 0, None), (9, 1, -1.0), (9, 2, 2.0)], "c int, k int, a double"), ["c"], "a", cap).collect()}
        for c, case in enumerate(cases):
            for k, share in _water({k: float(a) for k, a in enumerate(case)}, cap).items():
                assert got[c, k] == pytest.approx(share, abs=1e-12), (cap, case)
        assert (got[9, 0], got[9, 1], got[9, 2]) == (0, 0, 1)
    with pytest.raises(ValueError, match="cap"):
        scores.capped_shares(spark.createDataFrame(rows, "c int, k int, a double"), ["c"], "a", 0.0)


def test_composites_count_gaps_as_neutral(spark):
    symbols = ["a", "b", "c", "d"]
    values = [_value(s, sig, float(v)) for sig, order in {"x": "abcd", "y": "abdc", "z": "dcba"}.items() for v, s in enumerate(order) if (s, sig) not in {("d", "z"), ("c", "z"), ("c", "x")}]
    definitions = [_define("x", form="discrete", grp="g"), _define("y", form="discrete", grp="g", t_again=8.0), _define("z", form="discrete")]
    f = scores.feature_table(spark.createDataFrame(values, VAL), spark.createDataFrame(definitions, DEF), spark.createDataFrame(_context(symbols), CTX))
    t = {(r.symbol, r.signal): r for r in f.collect()}
    w = {r.signal: r for r in scores.signal_weights(f, 2.0, 0.6).collect()}
    assert (w["x"].within, w["y"].within, w["z"].within) == pytest.approx((1 / 3, 2 / 3, 1.0))  # 0.25, 0.5 and 0.25; a group votes with its mean
    assert (w["x"].group_weight, w["z"].group_weight) == pytest.approx((0.6, 0.4)) and w["x"].group_family == "y"
    got = {(r.symbol, r.horizon): r for r in scores.composite_scores(f, 2, 2.0, 0.6, horizons=(1, 3)).collect()}
    assert len(got) == 8 and got["a", 3].score is None and got["a", 3].signals_expected == 0 and not got["a", 3].enough
    point = lambda s, sig: 50.0 if t[s, sig].score_pct is None else t[s, sig].score_pct
    for s in "abd":
        assert got[s, 1].raw_score == pytest.approx(0.2 * point(s, "x") + 0.4 * point(s, "y") + 0.4 * point(s, "z"))
    assert got["d", 1].confidence == pytest.approx(60) and got["a", 1].confidence == pytest.approx(100)
    assert (got["c", 1].raw_score, got["c", 1].confidence, got["c", 1].signals_used) == (None, 0.0, 1)
    ranked = sorted("abd", key=lambda s: got[s, 1].raw_score)
    assert [got[s, 1].score for s in ranked] == [0, 50, 100]
    added = scores.contributions(f, 2.0, 0.6).groupBy("symbol").agg(F.sum("score_weight").alias("w"), F.sum("against_neutral").alias("n"), F.sum("added").alias("r")).collect()
    assert all(r.w == pytest.approx(1) and r.n == pytest.approx(r.r - 50) for r in added)


def test_aggregate_needs_all_horizons(spark):
    rows = [("a", 1, 10.0, 80.0, 50.0), ("a", 3, 20.0, 40.0, 100.0), ("b", 1, 10.0, 80.0, 50.0), ("b", 3, None, None, 90.0), ("c", 1, 1.0, 1.0, 0.0), ("d", 1, 5.0, 5.0, 10.0), ("d", 3, 5.0, 5.0, 10.0), ("d", 36, 9.0, 99.0, 99.0)]
    df = spark.createDataFrame([(AS_OF, *r) for r in rows], "as_of date, symbol string, horizon int, raw_score double, score double, confidence double")
    got = {r.symbol: (r.score, r.confidence, r.horizons_used, r.reason, r.ranked) for r in scores.aggregate_scores(df, [1, 3]).collect()}
    assert got["a"] == (pytest.approx((40 + 40) / 1.5), 75.0, 2, "", True)
    assert got["b"] == (pytest.approx(80.0), 25.0, 1, "incomplete_horizons", False)
    assert got["c"] == (None, 0.0, 0, "no_usable_horizons", False) and got["d"][2:] == (2, "confidence_too_low", False)


def test_empty_tables_give_empty_scores(spark):
    for v, d, c in itertools.product((0, 1), repeat=3):
        values, definitions, context = [_value("a", "x", 1.0)] * v, [_define("x")] * d, _context(["a"]) * c
        f = scores.feature_table(spark.createDataFrame(values, VAL), spark.createDataFrame(definitions, DEF), spark.createDataFrame(context, CTX))
        assert f.count() == (1 if d and c else 0)
        assert scores.composite_scores(f, 1).count() == (5 if d and c else 0) and scores.signal_coverage(f).count() == (1 if d and c else 0)


def test_ladder_counts_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr("tidemark.common.ROWS", 20)
    monkeypatch.setattr(scores, "ROWS", 20)
    rows = [(k % 3, float("nan") if k == 7 else (-0.0 if k % 2 else 0.0) if k < 40 else float(k % 23), k % 4 == 0) for k in range(400)] + [(0, None, True), (1, None, False)]
    df = spark.createDataFrame(rows, "g int, v double, r boolean").withColumn("i", F.monotonically_increasing_id())
    steps = scores.ladder(df, ["g"], "v", F.col("r"), len(rows))
    order = lambda v: (v != v, v if v == v else 0.0)
    got = {(x.g, order(x.v)): (x._k, x._r, x._upto) for x in steps.collect()}
    held = [(g, order(v), r) for g, v, r in rows if v is not None]
    assert got == {(g, v): (sum((a, b) == (g, v) for a, b, _ in held), sum(c for a, b, c in held if (a, b) == (g, v)), sum(c for a, b, c in held if a == g and b <= v)) for g, v, _ in held}
    met = scores.on_ladder(df, steps, ["g"], "v", F.col("i"), len(rows)).collect()
    assert len(met) == len(rows) and all((x._k, x._r, x._upto) == ((None,) * 3 if x.v is None else got[x.g, order(x.v)]) for x in met)


def test_no_cross_section_is_ranked_in_one_task(spark, monkeypatch):
    monkeypatch.setattr("tidemark.common.ROWS", 50)
    monkeypatch.setattr(scores, "ROWS", 50)
    symbols = [f"s{k}" for k in range(300)]
    values = spark.createDataFrame([_value(s, "a", float(k % 150)) for k, s in enumerate(symbols)] + [_value(s, "b", float(k)) for k, s in enumerate(symbols)], VAL)
    f = scores.feature_table(values, spark.createDataFrame([_define("a"), _define("b")], DEF), spark.createDataFrame(_context(symbols), CTX))
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(as_of" in plan and ", 12)" in plan.replace(" REPARTITION", "").replace(", REPARTITION_BY_NUM", "")
    got = {(r.symbol, r.signal): r.pct for r in f.collect()}
    assert all(got[s, "a"] == pytest.approx(100 * (4 * (k % 150) + 2) / 600) and got[s, "b"] == pytest.approx(100 * (2 * k + 1) / 600) for k, s in enumerate(symbols))
    s = {(r.symbol, r.horizon): r.score for r in scores.composite_scores(f, 1, 2.0, 1.0, horizons=(1,)).collect()}
    assert len(s) == 300 and max(s.values()) <= 100 and sum(s.values()) / 300 == pytest.approx(50)


def test_rows_above_one_task_are_dealt_in_a_larger_session_too(spark, monkeypatch):
    monkeypatch.setattr(common, "ROWS", 100)
    df = spark.range(0, 300, 1, 1).withColumn("k", F.col("id") % 50)
    counts = lambda rows: common.dealt(df, rows, "k").groupBy("k").agg(F.count("*").alias("n"))
    whole = common.dealt(df, 300, "k").withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n")).collect()
    assert len(whole) == 4 and max(r.n for r in whole) < 150  # 3 tasks' rows on the session's 4 partitions, which Spark doesn't merge
    plan = counts(300)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.rfind("HashAggregate") < plan.find("Exchange")  # nothing is combined for whole splits of the input
    assert {r.n for r in counts(300).collect()} == {6}
    assert common.dealt(df, 100, "k") is df
