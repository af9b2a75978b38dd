import datetime as dt

import pytest

from tidemark.operators import robustness as b

DAY = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
PANEL = "symbol int, date date, ret double"


@pytest.fixture(scope="module")
def returns(spark):
    rows = [(1, DAY(k), None if k == 5 else ((k * 37) % 11 - 5) / 100) for k in range(33)] + [(2, DAY(0), 0.01), (None, DAY(0), 0.5), (None, DAY(0), 0.5)]
    return spark.createDataFrame(rows, PANEL)


def test_bootstrap_blocks_cover_as_many_days_as_there_are_and_reruns_agree(returns):
    a, again = (sorted(map(tuple, b.block_bootstrap(returns, 5, 10).where("symbol is not null").collect())) for _ in range(2))
    assert a == again and len(a) == 10 and {r[2] for r in a} == {33, 1}
    assert all(r[3] == pytest.approx(0.01) and r[4] == 0 for r in a if r[0] == 2)


def test_a_block_as_long_as_the_series_keeps_its_mean(returns):
    mean = sum(((k * 37) % 11 - 5) / 100 for k in range(33) if k != 5) / 33
    assert [r.mean for r in b.block_bootstrap(returns.where("symbol = 1"), 3, 50).collect()] == pytest.approx([mean] * 3)


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], PANEL)
    held = spark.createDataFrame([], "symbol int, date date, ret double, w double, close double, volume double, net double")
    assert b.bootstrap_interval(b.block_bootstrap(none, 5, 10)).count() == 0
    for x in (b.weight_shuffle(held, 3), b.scenario_replay(none, [-0.1], 0), b.page_hinkley(none, "ret", 0.0, 1.0), b.capacity_curve(held, [1.0], 0.1), b.benchmark_pack(held, 0.0)):
        assert x.count() == 0


def test_page_hinkley_equals_its_recurrence(returns):
    got = [r.statistic for r in b.page_hinkley(returns.where("symbol = 1"), "ret", 0.001, 0.1).orderBy("date").collect()]
    mean, n, ph, want = 0.0, 0, 0.0, []
    for k in range(33):
        if k == 5:
            continue
        x = ((k * 37) % 11 - 5) / 100
        n += 1
        mean += (x - mean) / n
        ph = 0.0 if n == 1 else max(0.0, ph + x - mean - 0.001)
        want.append(ph)
    assert got == pytest.approx(want)


def test_sells_meet_the_oldest_lots_and_the_excess_meets_none(spark):
    rows = [(1, DAY(0), 1, -1, 5.0, 9.0), (1, DAY(1), 2, 1, 10.0, 100.0), (1, DAY(2), 3, 1, 10.0, 110.0), (1, DAY(3), 4, -1, 15.0, 120.0), (1, DAY(400), 5, -1, 9.0, 90.0)]
    (r,) = b.fifo_gains(spark.createDataFrame(rows, "symbol int, date date, seq int, side int, qty double, price double")).collect()
    # 10 lots at 100 and 5 at 110 go at 120; the other 5 at 110 go at 90 after more than a year.
    assert (r.excess, r.matched, r.short_gain, r.long_gain) == (9.0, 20.0, 250.0, -100.0)


def test_withdrawals_without_growth_share_the_capital(spark):
    df = spark.createDataFrame([(1, dt.date(2024, m, 1), 0.0) for m in range(1, 7)], "symbol int, month date, ret double")
    (r,) = b.withdrawals(df, 4).collect()
    assert r.starts == 3 and r.worst == 0.25 and r.worst_month == dt.date(2024, 1, 1)


def test_a_quarter_without_rows_is_missing(spark):
    df = spark.createDataFrame([(1, q, float(q)) for q in (1, 2, 3, 5, 6, 8)], "key int, quarter long, value double")
    got = {r.quarter: r.change for r in b.surprises(df).collect()}
    assert got == {1: None, 2: None, 3: None, 5: 4.0, 6: 4.0, 8: None}


def test_a_signal_that_looks_ahead_is_found(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, DAY(k), float(k % 5)) for k in range(20)], "symbol int, date date, close double")
    honest = lambda x: b.signal_weights(x, lambda: F.lag("close").over(b._w()) / 4)
    ahead = lambda x: b.signal_weights(x, lambda: F.lead("close").over(b._w()) / 4)
    assert b.causality(df, honest, str(DAY(12))).first().changed == 0
    assert b.causality(df, ahead, str(DAY(12))).first().changed == 1


def test_shuffled_weights_stay_in_their_task(spark):
    import hashlib

    rows = [(s, DAY(k), None if k % 7 == 3 else float((k * s) % 5 - 2), None if k == 4 else ((k * 13 + s) % 11 - 5) / 100) for s in (1, 2, 3) for k in range(20 + s)]
    x = b.weight_shuffle(spark.createDataFrame(rows, "symbol int, date date, w double, ret double").repartition(5), 6)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.find("MapInArrow") < plan.find("Exchange")  # the paths are made after the last exchange
    for r in x.collect():
        own = [(w or 0.0, ret or 0.0) for s, _, w, ret in rows if s == r.symbol]
        key = lambda p, i: (int(hashlib.md5(f"7-{r.symbol}-{p}-{i}".encode()).hexdigest()[:8], 16), i)  # noqa: E731, B023
        v = [round(sum(own[i - 1][0] * own[k][1] for k, i in enumerate(sorted(range(1, len(own) + 1), key=lambda i: key(p, i)))), 9) for p in range(1, 7)]
        actual = round(sum(w * ret for w, ret in own), 9)
        assert (r.paths, r.actual, r.p) == (6, actual, sum(a >= actual for a in v) / 6)


def test_noisy_samples_are_not_shuffled(spark):
    df = spark.createDataFrame([(s, DAY(k), 100.0 + k % 9 + s) for s in (1, 2) for k in range(40)], "symbol int, date date, close double").repartition(3)
    x = b.crossing_under_noise(df, 4, 0.002, 2, 5)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in plan and not [line for line in plan.splitlines() if "hashpartitioning" in line and "sample" in line]
    assert sorted((r.symbol, r.samples) for r in x.collect()) == [(1, 4), (2, 4)]
