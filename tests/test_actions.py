"""Corporate actions, ledgers and continuous contracts on small tables with gaps, ties, faults and no rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import actions

DAY = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
ACT = "symbol string, date date, kind string, factor double, cash double"
OHLC = "symbol string, date date, open double, high double, low double, close double, volume double"


def test_each_action_meets_the_closes_around_it(spark):
    bars = spark.createDataFrame([("a", DAY(0), 100.0), ("a", DAY(2), 50.4), ("a", DAY(3), None), ("a", DAY(5), 49.0), ("b", DAY(0), -1.0), ("b", DAY(1), 5.0)], "symbol string, date date, close double")
    rows = [
        ("a", DAY(2), "split", 2.0, None), ("a", DAY(1), "split", 2.0, None), ("a", DAY(1), "split", 2.0, None), ("a", DAY(2), "split", 3.0, None), ("a", DAY(4), "cash_dividend", None, 1.4), ("a", DAY(3), "special_dividend", None, 30.0),
        ("a", DAY(0), "reverse_split", 0.5, None), ("a", DAY(9), "split", 1.0, None), ("b", DAY(1), "split", 1.0, None), ("a", DAY(2), "split", 0.0, None), ("a", DAY(2), "split", float("nan"), None), ("a", DAY(2), "cash_dividend", 1.0, None),
        ("a", DAY(2), "merger", None, None), ("a", DAY(2), None, None, None), ("z", DAY(2), "split", 2.0, None),
    ]
    x = actions.verified_actions(bars, spark.createDataFrame(rows, ACT))
    got = sorted((r.symbol, r.date, str(r.kind), str(r.factor), r.result) for r in x.collect())
    want = ["consistent", "consistent", "consistent", "inconsistent", "consistent", "inconsistent", "no_price", "no_price", "non_positive_price", "bad_factor", "bad_factor", "bad_cash", "unchecked", "unchecked", "no_price"]
    assert got == sorted((s, d, str(k), str(f), w) for (s, d, k, f, _), w in zip(rows, want, strict=True))
    (paid,) = x.where("kind = 'cash_dividend' and cash is not null").collect()
    assert (paid.before, paid.after) == (50.4, 49.0) and paid.error == pytest.approx(0, abs=1e-12)
    report = {r.kind: (r.n, r.symbols, r.checked, r.passed, r.known, r.plausible) for r in actions.action_report(x).collect()}
    assert report["merger"] == (1, 1, 0, 0, True, None) and report[None] == (1, 1, 0, 0, False, None) and report["split"] == (9, 3, 9, 3, True, False)
    assert actions.verified_actions(bars.limit(0), spark.createDataFrame([], ACT)).count() == 0
    assert {r.result for r in actions.verified_actions(bars.limit(0), spark.createDataFrame(rows[:2], ACT)).collect()} == {"no_price"}


def test_positions_after_actions(spark):
    rows = [("split", 2.0, None, 10.0, 7.0, 5.0, 14.0, 0.0), ("split", 2.0, None, 10.0, 7.0, 5.1, 13.0, 1.0), ("cash_dividend", None, 0.5, 10.0, 8.0, 9.5, 8.0, 4.0), ("cash_dividend", None, None, 10.0, 8.0, 9.5, 8.0, 4.0), ("split", 0.0, None, 1.0, 1.0, 1.0, 1.0, 0.0), ("merger", None, None, 1.0, 1.0, 1.0, 1.0, 0.0)]
    x = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, kind string, factor double, cash double, pre_price double, pre_position double, post_price double, post_position double, cash_delta double")
    got = [(r.price_ok, r.position_ok, r.cash_ok) for r in actions.audited_positions(x).orderBy("k").collect()]
    assert got == [(True, True, True), (False, False, False), (True, True, True), (False, True, False), (False, False, True), (None, None, None)]


def test_ledger_equals_its_recurrence_and_leaves_faulty_symbols_out(spark):
    closes = [10.0, 12.0, 6.5, 6.0, 13.0]
    good = [("a", DAY(k), c + 0.5, c + 1, c - 1, c, 5.0) for k, c in enumerate(closes)]
    bad = [("rep", DAY(0), 1.0, 1.0, 1.0, 1.0, 1.0)] * 2 + [("neg", DAY(0), -1.0, 1.0, -2.0, 1.0, -1.0), ("hi", DAY(0), 5.0, 4.0, 3.0, 4.0, 1.0), ("gap", DAY(0), None, 4.0, 3.0, 4.0, 1.0), ("off", DAY(0), 1.0, 1.0, 1.0, 1.0, 1.0), ("cut", DAY(0), 1.0, 1.0, 1.0, 1.0, 1.0)]
    bars = spark.createDataFrame(good + bad, OHLC)
    paid = spark.createDataFrame([("a", DAY(1), 0.2), ("a", DAY(1), 0.1), ("a", DAY(4), 1.0), ("off", DAY(3), 1.0), ("off", DAY(3), 2.0)], "symbol string, date date, distribution double")
    cut = spark.createDataFrame([("a", DAY(2), 2.0), ("a", DAY(4), 0.5), ("cut", DAY(0), 0.0)], "symbol string, date date, split_ratio double")
    faults = {(r.symbol, r.fault) for r in actions.ledger_faults(bars, paid, cut).collect()}
    assert faults == {("rep", "repeated_session"), ("neg", "non_positive_price"), ("neg", "negative_volume"), ("hi", "invalid_high"), ("gap", "missing_price"), ("off", "distribution_without_session"), ("cut", "invalid_split")}
    got = actions.total_return_ledger(bars, paid, cut).orderBy("date").collect()
    later = [1.0, 1.0, 0.5, 0.5, 1.0]
    opened = [(c + 0.5) / s for c, s in zip(closes, later, strict=True)]
    dist = [d / s for d, s in zip([0, 0.3, 0, 0, 1.0], later, strict=True)]
    level = 1.0
    assert {r.symbol for r in got} == {"a"} and len(got) == 5
    for k, r in enumerate(got):
        assert r.adj_open == pytest.approx(opened[k]) and r.tr_open == pytest.approx(level) and r.tr_close == pytest.approx(level * closes[k] / (closes[k] + 0.5))
        if k == 4:
            assert r.long_return is None and r.short_return is None
        else:
            ret = (opened[k + 1] + dist[k + 1] - opened[k]) / opened[k]
            assert r.long_return == pytest.approx(ret) and r.short_return == -r.long_return
            level *= 1 + ret
    assert actions.total_return_ledger(bars.limit(0), paid.limit(0), cut.limit(0)).count() == 0


def test_weekdays_before_any_day(spark):
    def before(day, n):
        while n:
            day -= dt.timedelta(1)
            n -= day.weekday() < 5
        return day

    days = spark.createDataFrame([(DAY(k),) for k in range(15)], "d date")
    for n in (1, 2, 4, 5, 6, 11):
        assert {r.d: r.b for r in days.select("d", actions.business_days_before(F.col("d"), n).alias("b")).collect()} == {DAY(k): before(DAY(k), n) for k in range(15)}


def test_contracts_join_without_a_gap(spark):
    expiry = {1: DAY(11), 2: DAY(25), 3: DAY(39)}  # Fridays; two weekdays before are the 10th, 24th and 38th day
    chain = [("s", DAY(k), f"c{c}", 100.0 + k + 10 * c, e) for c, e in expiry.items() for k in range(40) if DAY(k).weekday() < 5]
    df = spark.createDataFrame(chain, "symbol string, date date, contract string, close double, expiry date").where("not (contract = 'c3' and date = '2024-01-24')")  # no price of the third at the second roll
    rolls = {c: e - dt.timedelta(2) for c, e in expiry.items()}
    front = lambda d: min((c for c in expiry if d <= rolls[c]), default=None)
    days = [DAY(k) for k in range(40) if DAY(k).weekday() < 5 and front(DAY(k))]
    raw = {(d, c): p for _, d, c, p, _ in chain}
    last = {1: rolls[1], 2: rolls[2] - dt.timedelta(1)}
    for method in ("difference", "ratio", "none"):
        got = {r.date: r for r in actions.continuous(df, 2, method).collect()}
        assert sorted(got) == days
        for d in days:
            c = front(d)
            assert got[d].contract == f"c{c}" and got[d].close == raw[d, f"c{c}"]
            want = got[d].close
            for k in range(c, 3):
                old, new = raw[last[k], f"c{k}"], raw[last[k], f"c{k + 1}"]
                want = want * new / old if method == "ratio" else want + new - old if method == "difference" else want
            assert got[d].continuous == pytest.approx(want)
    with pytest.raises(ValueError, match="method"):
        actions.continuous(df, 2, "other")
    assert actions.continuous(df.limit(0)).count() == 0
