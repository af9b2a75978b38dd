import datetime as dt
import itertools
from pathlib import Path

import duckdb
import pytest

from tidemark.operators import factors, features, panel, recurrence, sequential, tables, trades
from tidemark.plans import actions, contracts, filings, joins, lanes, market, orders, panels, research, robustness, scores, selection, streams, texts, versions

PLANS = (market, research, texts, contracts, joins, panels, lanes, versions, robustness, orders, selection, streams, filings, scores, actions)
QUERIES, ORACLE = {k: q for x in PLANS for k, q in x.QUERIES.items()}, {k: q for x in PLANS for k, q in x.ORACLE.items()}
SF = "/root/testdata/sf0.001"
DAY = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    plain = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else str(v)[:19]
    order = lambda row: ([x for x in row if isinstance(x, str)], [x for x in row if not isinstance(x, str)])
    ours = sorted([tuple(plain(r[c]) for c in cols) for r in got.collect()], key=order)
    theirs = sorted([tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall()], key=order)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or abs(x - y) <= 2e-5 * max(1, abs(x)), (a, b)


def test_rolling_is_null_until_full_and_causal(spark):
    df = spark.createDataFrame([(1, DAY(k), float(k)) for k in range(6)], "symbol int, date date, close double")
    whole = {r.date: r.mean_3 for r in features.rolling_stats(df, 3, "close").collect()}
    part = {r.date: r.mean_3 for r in features.rolling_stats(df.where("close < 4"), 3, "close").collect()}
    assert whole[DAY(1)] is None and whole[DAY(2)] == 1.0
    assert all(whole[d] == v for d, v in part.items())


def test_asof_is_inclusive_and_per_key(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c")], "k int, ts int, tag string")
    right = spark.createDataFrame([(1, 5, 50.0), (1, 3, 30.0)], "k int, ts int, v double")
    assert {r.tag: r.v for r in tables.asof(left, right, "k", "ts", ["v"]).collect()} == {"a": 50.0, "b": None, "c": None}


def test_drawdown_of_nothing_is_empty(spark):
    assert panel.drawdown(spark.createDataFrame([], "symbol int, date date, ret double")).count() == 0


def test_changes_treat_nulls_as_equal(spark):
    old = spark.createDataFrame([(1, None), (2, 1.0), (3, 1.0)], "k int, v double")
    new = spark.createDataFrame([(1, None), (2, None), (4, 1.0)], "k int, v double")
    assert {r.k: r.op for r in tables.changes(old, new, "k", ["v"]).collect()} == {2: "update", 3: "delete", 4: "insert"}


def test_threshold_bars_restart_and_keep_the_partial_bar(spark):
    rows = [(1, k, k, 10.0, v) for k, v in enumerate((3, 3, 3, 9, 1, 2))] + [(2, 0, 0, 5.0, 1), (None, 0, 0, 5.0, None)]
    df = spark.createDataFrame(rows, "symbol int, ts int, seq int, price double, size long")
    got = {(r.symbol, r.seq): r.bar for r in sequential.threshold_bars(df, 5, "size").collect()}
    assert [got[1, k] for k in range(6)] == [0, 0, 1, 1, 2, 2] and got[2, 0] == 0 and got[None, 0] == 0


def test_macd_carries_its_state_over_batches(spark):
    df = spark.createDataFrame([(1, DAY(k), float(k % 7)) for k in range(50)], "symbol int, date date, close double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        parts = [tuple(r) for r in recurrence.macd(df, 3, 6, 2).orderBy("date").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for a, b in zip(parts, [tuple(r) for r in recurrence.macd(df, 3, 6, 2).orderBy("date").collect()], strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-12)  # a scan adds in another order
    assert recurrence.macd(df.limit(0), 3, 6, 2).count() == 0


def test_constant_cross_sections_have_no_coefficient(spark):
    df = spark.createDataFrame([(s, DAY(0), 1.0, float(s)) for s in range(4)] + [(9, DAY(1), None, 1.0)], "symbol int, date date, factor double, forward double")
    (row,) = factors.information_coefficient(df).collect()
    assert row.n == 4 and row.ic is None and row.rank_ic is None


def test_back_adjustment_ends_at_one_and_halves_before_a_split(spark):
    bars = spark.createDataFrame([(1, DAY(k), 10.0, 2.0) for k in range(4)], "symbol int, date date, close double, volume double")
    acts = spark.createDataFrame([(1, DAY(2), "split", 2.0), (1, DAY(3), "dividend", 10.0)], "symbol int, date date, kind string, factor double")
    assert [r.adj_close for r in trades.back_adjusted(bars, acts).orderBy("date").collect()] == [0.0, 0.0, 0.0, 10.0]
    assert [r.adj_close for r in trades.back_adjusted(bars, acts.where("kind = 'split'")).orderBy("date").collect()] == [5.0, 5.0, 10.0, 10.0]


def test_equal_sets_of_words_tie_whatever_their_order(spark):
    rows = [(k, " ".join(w)) for k, w in enumerate(itertools.permutations(["ab", "cd", "ef", "gh"]))]
    rows += [(100 + k, "gh x") for k in range(3)] + [(200, None)] + [(201 + k, "x") for k in range(4)]  # at these counts the sum depends on its order
    got = tables.keyword_search(spark.createDataFrame(rows, "doc_id int, text string").repartition(5), ["ef", "gh", "ab", "cd"], 24).collect()
    assert [r.doc_id for r in got] == list(range(24)) and len({r.score for r in got}) == 1
