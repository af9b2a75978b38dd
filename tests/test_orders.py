import datetime as dt
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tidemark.functions.distributions import normal_cdf
from tidemark.operators import orders as o
from tidemark.operators import recurrence
from tidemark.sources.files import read_bars_csv, write_csv

DAY = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
EVENT = "order_id int, seq int, kind string, qty double, price double"


def test_normal_cdf_is_close_to_the_exact_one(spark):
    z = [k / 4 for k in range(-24, 25)]
    got = [r.p for r in spark.createDataFrame([(v,) for v in z] + [(None,)], "z double").select(normal_cdf(F.col("z")).alias("p")).collect()]
    assert got[-1] is None
    assert got[:-1] == pytest.approx([NormalDist().cdf(v) for v in z], abs=1e-7)


def test_illegal_events_change_nothing(spark):
    rows = [(1, 2, "partially_filled", 4.0, 10.0), (1, 0, "submitted", None, None), (1, 1, "acknowledged", None, None), (1, 3, "filled", 6.0, 20.0), (1, 4, "cancelled", None, None), (2, 0, "filled", 5.0, 5.0), (None, 0, None, None, None)]
    got = {r.order_id: tuple(r)[1:] for r in o.order_states(spark.createDataFrame(rows, EVENT)).collect()}
    assert got[1] == ("filled", 5, 1, 10.0, 16.0)
    assert got[2] == ("created", 1, 1, 0.0, None) and got[None] == ("created", 1, 1, 0.0, None)
    assert o.order_states(spark.createDataFrame([], EVENT)).count() == 0


def test_a_fill_beyond_the_position_turns_it(spark):
    rows = [(1, 0, 1, 10.0, 100.0), (1, 1, 1, 10.0, 110.0), (1, 2, -1, 30.0, 120.0), (1, 3, 1, 10.0, 90.0)]
    got = [(r.position, r.cost, r.realised) for r in recurrence.average_cost(spark.createDataFrame(rows, "symbol int, seq int, side int, qty double, price double")).orderBy("seq").collect()]
    assert got == [(10.0, 100.0, 0.0), (20.0, 105.0, 0.0), (-10.0, 120.0, 300.0), (0.0, 0.0, 600.0)]


def test_alerts_pause_by_rule_and_symbol(spark):
    rows = [(s, DAY(k), -0.1 if k != 4 else None) for s in (1, 2) for k in range(8)]
    df = spark.createDataFrame(rows, "symbol int, date date, ret double")
    rules = {"loss": F.col("ret") < -0.05, "gain": F.col("ret") > 0}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted((r.symbol, r.rule, r.date) for r in o.alerts(df, rules, 3).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(s, "loss", DAY(k)) for s in (1, 2) for k in (0, 3, 6)]
    assert o.alerts(df.limit(0), rules, 3).count() == 0


def test_more_trials_deflate_more(spark):
    df = spark.createDataFrame([(1, DAY(k), 0.0003 + (k % 3 - 1) / 200) for k in range(60)] + [(2, DAY(k), 0.01) for k in range(5)], "symbol int, date date, ret double")
    few, many = ({r.symbol: r for r in o.deflated_sharpe(df, n).collect()} for n in (2, 1000))
    assert few[1].deflated > many[1].deflated and many[1].probabilistic == few[1].probabilistic > 0.99
    assert many[2].probabilistic == many[2].deflated == 0


def test_csv_bars_come_back(spark, tmp_path):
    df = spark.createDataFrame([(s, DAY(k), 1.0, 2.0, 0.5, None if k == 3 else 1.5, 10.0) for s in (1, 2) for k in range(5)], "symbol long, date date, open double, high double, low double, close double, volume double")
    write_csv(df, str(tmp_path / "bars"))
    got = read_bars_csv(spark, str(tmp_path / "bars"), str(DAY(1)))
    assert sorted(tuple(r) for r in got.select(df.columns).collect()) == sorted(tuple(r) for r in df.where(f"close is not null and date >= '{DAY(1)}'").collect())


def test_costs_on_a_tie_round_as_in_the_plain_order(spark):
    rows = [(1, k, 1 if k % 3 else -1, float(1 + k * 7 % 50), round(100 + (k * 37 % 19) / 100, 2)) for k in range(400)]
    held = cost = gain = 0.0
    want = []
    for _, _, side, qty, price in rows:
        q = side * qty
        if held * q < 0:
            gain += min(qty, abs(held)) * (price - cost) * (1 if held > 0 else -1)
            cost = price if qty > abs(held) else cost
        else:
            cost = (cost * abs(held) + price * qty) / (abs(held) + qty) if want else price
        held += q
        cost = cost if held else 0.0
        want.append((held, cost, gain))
    got = recurrence.average_cost(spark.createDataFrame(rows, "symbol int, seq int, side int, qty double, price double").repartition(4)).orderBy("seq").collect()
    assert [(r.position, r.cost, r.realised) for r in got] == want  # to the last bit


def test_many_symbols_share_few_csv_files(spark, tmp_path):
    import pathlib

    df = spark.range(300).select(F.col("id").alias("symbol"), F.lit(DAY(1)).cast("date").alias("date"), *[F.lit(1.5).alias(c) for c in ("open", "high", "low", "close", "volume")])
    write_csv(df, str(tmp_path / "bars"), folders=8)
    assert len(list(pathlib.Path(tmp_path / "bars").rglob("*.csv"))) <= 8
    got = read_bars_csv(spark, str(tmp_path / "bars"))
    assert sorted(r.symbol for r in got.collect()) == list(range(300)) and set(got.columns) == set(df.columns)
