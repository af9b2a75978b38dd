"""Risk measures, turnover and walk-forward windows against numpy on panels with gaps, non-numbers and no rows."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import panels

DAY = lambda k: dt.date(2023, 11, 1) + dt.timedelta(int(k))


def test_risk_measures_of_finite_returns(spark):
    r = np.random.default_rng(4).normal(0, 0.02, 80).round(3)
    rows = [("a", DAY(k), float(v)) for k, v in enumerate(r)] + [("a", DAY(90), None), ("a", DAY(91), float("nan")), ("a", DAY(92), float("inf")), ("one", DAY(0), 0.01), ("none", DAY(0), None), ("up", DAY(0), 0.1), ("up", DAY(1), 0.1)]
    df = spark.createDataFrame(rows, "symbol string, date date, ret double")
    got = {x.symbol: x for x in panels.risk_measures(df, 0.1, 0.001).collect()}
    v = np.cumprod(1 + r)
    fall = 1 - v / np.maximum.accumulate(v)
    low = r[r < 0.001] - 0.001
    want = (80, r.var(ddof=1), (low * low).mean(), -r[r <= np.quantile(r, 0.1)].mean(), fall.max(), fall.mean())
    assert tuple(got["a"])[1:] == pytest.approx(want)
    assert tuple(got["one"])[1:] == (1, 0.0, 0.0, -0.01, 0.0, 0.0) and got["up"].semi_variance == 0 and "none" not in got
    assert panels.risk_measures(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="alpha"):
        panels.risk_measures(df, 1.0)


def test_turnover_counts_entries_and_exits(spark):
    w = np.array([[0.5, 0.5, 0], [0.5, 0, 0.5], [0, 0, 0.5], [0.5, 0, 0.5], [0.2, -0.3, 0]])
    r = np.random.default_rng(1).normal(0, 0.05, w.shape)
    rows = [("p", DAY(3 * t), f"s{k}", float(w[t, k]), float(r[t, k])) for t in range(5) for k in range(3) if w[t, k]]
    rows += [("q", DAY(0), "s0", None, 0.1), ("q", DAY(1), "s0", 1.0, None)]
    df = spark.createDataFrame(rows, "portfolio string, date date, symbol string, w double, ret double").repartition(3)
    got = {x.portfolio: x for x in panels.net_of_turnover(df, 20.0).collect()}
    turned = np.abs(np.diff(np.vstack([np.zeros(3), w]), axis=0)).sum(axis=1)
    gross = (w * r).sum(axis=1)
    assert tuple(got["p"])[1:] == pytest.approx((5, np.prod(1 + gross) - 1, np.prod(1 + gross - turned * 0.002) - 1, turned.sum(), turned.sum() * 0.002))
    assert tuple(got["q"])[1:] == pytest.approx((2, 0.0, -0.002, 1.0, 0.002))
    assert panels.net_of_turnover(df.limit(0), 1.0).count() == 0
    with pytest.raises(ValueError, match="bps"):
        panels.net_of_turnover(df, -1.0)


def test_windows_may_overlap_cross_years_and_be_short(spark):
    r = np.random.default_rng(7).normal(0.002, 0.02, 200).round(4)
    df = spark.createDataFrame([("a", DAY(k), None if k == 70 else float(v)) for k, v in enumerate(r)], "symbol string, date date, net double")
    spans = {0: (0, 59), 1: (30, 129), 2: (150, 168), 3: (170, 189), 4: (500, 600), 5: (140, 199)}
    windows = spark.createDataFrame([("a", f, DAY(lo), DAY(hi)) for f, (lo, hi) in spans.items()], "symbol string, fold int, start date, end date")
    x = np.where(np.arange(200) == 70, 0, r)
    for criterion in ("calmar_positive", "calmar_above_benchmark", "sharpe_positive"):
        got = {g.fold: g for g in panels.walk_forward_metrics(df, windows, criterion, 3.0).collect()}
        calmars = {}
        for f, (lo, hi) in spans.items():
            part = x[lo : hi + 1]
            assert got[f].n_rows == len(part)
            if len(part) < 20:
                assert (got[f].reason, got[f].cagr, got[f].place, got[f].passed) == ("insufficient_data", None, None, False)
                continue
            v = np.cumprod(1 + part)
            cagr, mdd, sharpe = v[-1] ** (252 / len(part)) - 1, (v / np.maximum.accumulate(v) - 1).min(), part.mean() / part.std() * 252**0.5
            calmars[f] = cagr / -mdd
            assert (got[f].cagr, got[f].mdd, got[f].calmar, got[f].sharpe) == pytest.approx((cagr, mdd, calmars[f], sharpe))
            good = {"calmar_positive": calmars[f] > 0, "calmar_above_benchmark": calmars[f] > 3, "sharpe_positive": sharpe > 0}[criterion]
            assert got[f].passed == (good and len(part) >= 60)
        assert {f: got[f].place for f in calmars} == {f: 1 + sum(o > c for o in calmars.values()) for f, c in calmars.items()}
        assert {g.n_passed for g in got.values()} == {sum(g.passed for g in got.values())}
    assert panels.walk_forward_metrics(df, windows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="criterion"):
        panels.walk_forward_metrics(df, windows, "best")


def test_adjusted_p_runs_from_the_end(spark):
    from tidemark.operators import panels

    x = panels.benjamini_hochberg(spark.createDataFrame([(k, p) for k, p in enumerate([0.04, 0.01, 0.03, None, 0.9])], "symbol int, p double"), "p", "symbol")
    assert {r.symbol: round(r.q, 9) for r in x.collect()} == {0: round(0.16 / 3, 9), 1: 0.04, 2: round(0.16 / 3, 9), 4: 0.9}
    assert "currentrow$(), unboundedfollowing$()" not in x._jdf.queryExecution().executedPlan().toString().lower()  # a frame to the end is quadratic


def test_lineage_makes_no_pair_for_each_node_between(spark, monkeypatch):
    from tidemark.operators import contracts

    rows = []
    name = lambda df: rows.append(df.count()) or df.localCheckpoint()
    grid = [((i, j), p) for i in range(6) for j in range(6) for p in ((i - 1, j), (i, j - 1)) if min(p) >= 0]
    edges = spark.createDataFrame([(10 * a[0] + a[1], 10 * b[0] + b[1]) for a, b in grid], "child int, parent int")
    got = {(r.node, r.ancestor) for r in contracts.ancestors(edges, name).collect()}
    assert got == {(10 * i + j, 10 * a + b) for i in range(6) for j in range(6) for a in range(i + 1) for b in range(j + 1) if (a, b) != (i, j)}
    assert sum(rows) == len(got)  # each pair in one round; before, every round held all again
    monkeypatch.setattr(contracts, "STEPS", 3)
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(100, 101), (101, 100)], "child int, parent int")
    got = {(r.node, r.ancestor) for r in contracts.ancestors(chain, lambda df: df.localCheckpoint()).collect()}
    assert got == {(a, b) for a in range(20) for b in range(a + 1, 21)} | {(a, b) for a in (100, 101) for b in (100, 101)}


def test_purged_folds_count_without_sorting_rows(spark):
    df = spark.createDataFrame([(n, f"2024-01-{d + 1:02d}") for n in (3, 5, 6, 7, 13, 29) for d in range(n)], "symbol int, d string").selectExpr("symbol", "cast(d as date) as date")
    for splits, horizon, embargo in ((5, 10, 5), (3, 2, 1), (5, 0, 0), (1, 3, 2)):
        x = panels.purged_folds(df, splits, horizon, embargo)
        assert "Window" not in x._jdf.queryExecution().executedPlan().toString()
        want = set()
        for n in (3, 5, 6, 7, 13, 29):
            size = n // splits
            edges = [(k * size, n - 1 if k == splits - 1 else (k + 1) * size - 1) for k in range(splits)]
            for k, (lo, hi) in enumerate(edges if size else []):
                near = lambda i: any(a - embargo <= i < a or b < i <= b + embargo for j, (a, b) in enumerate(edges) if j != k)  # noqa: E731, B023
                gone = [i for i in range(n) if lo <= i <= hi or (min(i + horizon, n - 1) > lo and i <= hi) or hi < i <= hi + embargo or near(i)]
                want.add((n, k, hi - lo + 1, n - len(gone)))
        assert {tuple(r) for r in x.collect()} == want


def test_missing_sessions_are_counted_not_listed(spark):
    from tidemark.operators import contracts

    r = np.random.default_rng(4)
    rows = [(s, DAY(k), 1.0) for s in range(12) for k in sorted(r.choice(60, 1 + 2 * s, replace=False))] + [(3, DAY(70), 1.0), (3, DAY(70), 1.0), (99, None, 1.0), (None, DAY(0), 1.0), (None, DAY(9), 1.0)]
    df = spark.createDataFrame(rows, "symbol int, date date, close double").selectExpr("symbol", "date", "close as open", "close as high", "close as low", "close")
    off = spark.createDataFrame([(DAY(k),) for k in (5, 6, 7, 7, 30)] + [(None,)], "date date")
    for holidays, closed in ((None, []), (off, [DAY(k) for k in (5, 6, 7, 30)])):
        x = contracts.quality_scores(df, holidays=holidays)
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "LeftAnti" not in plan
        got = {row.symbol: (row.n, row.repeated, row.missing) for row in x.collect()}
        for s in range(12):
            held = {d for k, d, _ in rows if k == s}
            days = [min(held) + dt.timedelta(k) for k in range((max(held) - min(held)).days + 1)]
            assert got[s] == (sum(k == s for k, _, _ in rows), int(s == 3), sum(d.weekday() < 5 and d not in held and d not in closed for d in days))
        assert got[99] == (1, 0, 0) and got[None] == (2, 0, 0)


def test_returns_are_not_dealt_by_date_to_meet_the_market(spark):
    df = spark.createDataFrame([(s, DAY(k), ((k * s) % 7 - 3) / 100) for s in (1, 2, 3) for k in range(30)], "symbol int, date date, ret double").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of unknown or large size
    try:
        x = panels.rolling_correlation(df, panels.market_of(df), 5)
        assert "SortMergeJoin" not in x._jdf.queryExecution().executedPlan().toString()
        assert x.where("beta is not null").count() == 3 * 26
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
