"""Choices, duplicates, tests over many strategies, recurrences, chains and streams against brute force."""

import datetime as dt
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audits, duplicates, frontier, pairs, panels, reality, recurrence, volume_time
from tidemark.operators.graph import components

DAY = lambda k: dt.date(2024, 1, 1) + dt.timedelta(int(k))


def test_components_of_chains_hubs_and_loops(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 2), (200, 201), (201, 200), (None, 5), (5, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def _brute_groups(panel, decimals, threshold, share):
    names = sorted({c for c, _, _ in panel})
    dates = sorted({d for _, d, _ in panel})
    x = {c: np.full(len(dates), np.nan) for c in names}
    for c, d, r in panel:
        x[c][dates.index(d)] = np.nan if r is None else r
    least, root = max(10, int(len(dates) * share)), {c: c for c in names}

    def find(c):
        return c if root[c] == c else find(root[c])

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = np.isfinite(x[a]) & np.isfinite(x[b])
            same = (np.nan_to_num(np.round(x[a], decimals)) == np.nan_to_num(np.round(x[b], decimals))).all()
            if not same and both.sum() >= least:
                u, v = x[a][both] - x[a][both].mean(), x[b][both] - x[b][both].mean()
                s = math.sqrt((u * u).sum() * (v * v).sum())
                same = s > 0 and abs((u * v).sum() / s) >= threshold
            if same:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {c: find(c) for c in names}


def test_duplicate_groups_equal_all_pairs(spark):
    r = np.random.default_rng(2)
    panel = []
    for k in range(25):
        base = r.normal(0, 0.02, 120)
        forms = [base, -base * 3, base.copy(), base + r.normal(0, 0.001, 120), r.normal(0, 0.02, 120), np.where(np.arange(120) < 12, np.nan, base)]
        for v, x in enumerate(forms):
            panel += [(k * 10 + v, DAY(t), None if np.isnan(x[t]) else float(x[t])) for t in range(120)]
    family = r.normal(0, 0.02, 120)  # a class of many, so that a bucket is large
    for k in range(1000, 1150):
        panel += [(k, DAY(t), float(v)) for t, v in enumerate(family + r.normal(0, 0.001, 120))]
    panel += [(2000 + k, DAY(t), 0.0) for k in range(3) for t in range(120)]
    df = spark.createDataFrame(panel, "candidate int, date date, ret double").repartition(4)
    results = df.select("candidate").distinct().withColumn("score", F.col("candidate") % 7).unionByName(spark.createDataFrame([(9999, 1)], "candidate int, score int"))
    got = {x.candidate: x for x in duplicates.duplicate_groups(df, results, [F.desc("score")]).collect()}
    want = _brute_groups(panel, 8, 0.98, 0.5) | {9999: 9999}
    assert {c: x.grp for c, x in got.items()} == want
    sizes = Counter(want.values())
    assert all(x.group_size == sizes[x.grp] for x in got.values()) and got[1000].group_size == 150
    best = {g: min((c for c in want if want[c] == g), key=lambda c: (-(c % 7) if c != 9999 else -1, c)) for g in sizes}
    assert {x.grp: c for c, x in got.items() if x.representative} == best


def test_few_pairs_are_compared(spark):
    r = np.random.default_rng(3)
    panel = [(k, DAY(t), float(v)) for k in range(400) for t, v in enumerate(r.normal(0, 1, 60))]
    keyed = duplicates.signed_bands(spark.createDataFrame(panel, "candidate int, date date, ret double"))
    a, b = keyed.selectExpr("candidate a", "band", "key"), keyed.selectExpr("candidate b", "band", "key")
    assert a.join(b, ["band", "key"]).where("a < b").select("a", "b").distinct().count() < 0.01 * 400 * 399 / 2


def test_redundancy_groups_are_complete_links(spark):
    r = np.random.default_rng(5)
    base = {f: r.normal(0, 1, 100) for f in range(3)}
    names = [(f"s{k:02d}", k, None if k % 4 == 3 else f"f{k % 4}", None if k % 5 == 0 else -1 if k % 5 == 1 else 1) for k in range(40)]
    x = {s: (base[k % 3] + r.normal(0, 0.5 + (k % 2) / 3, 100)) * (-1 if k % 5 == 1 else 1) * (-1 if k % 11 == 0 else 1) for s, k, _, _ in names}
    panel = [(s, DAY(t), float(v)) for s, row in x.items() for t, v in enumerate(row) if s != "s07" or t < 50]
    df = spark.createDataFrame(panel, "signal string, date date, ret double")
    got = {r_.signal: (r_.grp, r_.group_size) for r_ in duplicates.redundancy_groups(spark.createDataFrame(names, "signal string, place int, family string, sign int"), df, 0.7).collect()}
    groups = []
    for s, k, f, sign in names:
        fits = lambda m: m[2] == f and "s07" not in (s, m[0]) and np.corrcoef(x[s] * (sign or 1), x[m[0]] * (m[3] or 1))[0, 1] >= 0.7
        home = next((g for g in groups if all(fits(m) for m in g)), None)
        if home is None:
            groups.append([(s, k, f, sign)])
        else:
            home.append((s, k, f, sign))
    assert got == {m[0]: (g[0][0], len(g)) for g in groups for m in g} and max(map(len, groups)) > 2


def test_reality_check_equals_resampled_rows(spark):
    r = np.random.default_rng(7)
    x = r.normal(0, 1, (12, 130))
    x[3] += 0.6
    x[5] = 0.0
    rows = [(f"c{k}", DAY(t), float(v)) for k in range(12) for t, v in enumerate(x[k])] + [("c1", DAY(500), 1.0), ("gone", DAY(1), None)]
    df = spark.createDataFrame(rows, "candidate string, date date, x double").repartition(5)
    overall, each = reality.reality_check(df, seed=3, samples=99, lengths=(10,))
    n, b = 130, 5
    w = reality.stationary_weights(n, 99, b, 3 + b)
    assert (w.sum(1) == n).all()
    t = lambda y: np.divide(y.mean(-1), y.std(-1, ddof=1) / math.sqrt(n), out=np.zeros(len(y)), where=y.std(-1, ddof=1) > 1e-12)
    paths = np.array([t(np.repeat(x - x.mean(1, keepdims=True), k.astype(int), axis=1)) for k in w])
    means = np.array([np.repeat(x, k.astype(int), axis=1).mean(1) for k in w])
    got = {r_.candidate: r_ for r_ in each.collect()}
    assert len(got) == 12
    raw = {k: (1 + (paths[:, k] >= t(x)[k]).sum()) / 100 for k in range(12)}
    for k in range(12):
        g = got[f"c{k}"]
        assert g.spa_p == pytest.approx((1 + (paths.max(1) >= t(x)[k]).sum()) / 100) and g.raw_p == pytest.approx(raw[k])
        assert g.q == pytest.approx(min(1, min(p * 12 / sum(o <= p for o in raw.values()) for p in raw.values() if p >= raw[k])))
        assert (g.low, g.high) == pytest.approx(tuple(np.quantile(means[:, k], [0.025, 0.975]))) and g.deviation == pytest.approx(means[:, k].std(ddof=1))
    all_ = {r_.length: r_ for r_ in overall.collect()}
    assert set(all_) == {5, 10} and all_[5].spa_p == pytest.approx(got["c3"].spa_p) and all_[5].spa_p < 0.1
    few, none = reality.reality_check(df.where(F.col("date") < DAY(50)))
    assert few.count() == 0 and {r_.spa_p for r_ in none.collect()} == {None}


def test_bootstrap_blocks_have_the_mean_length():
    place = np.arange(200_000, dtype=np.int64)
    fresh = reality.drawn(np.zeros_like(place), place, 11, 1) * 20 < 1
    assert 0.9 < fresh.mean() * 20 < 1.1
    u = reality.drawn(np.full_like(place, 3), place, 11, 2)
    assert np.abs(np.histogram(u, 20, (0, 1))[0] / 10_000 - 1).max() < 0.05 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.01


def test_frontier_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(frontier, "CHUNK", 300)
    r = np.random.default_rng(4)
    x = np.round(r.normal(0, 1, (10_000, 3)), 1)  # many ties
    x[:500, 1] = -x[:500, 0]
    rows = [(k, *map(float, v)) for k, v in enumerate(x)] + [(10_000, *map(float, x[np.argmax(x.sum(1))])), (10_001, None, 9.0, 9.0), (10_002, float("nan"), 9.0, 9.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double").repartition(6)
    y = np.array([v[1:] for v in rows[:10_001]], float)
    want = {k for k, v in enumerate(y) if not ((y >= v).all(1) & (y > v).any(1)).any()}
    assert {r_.id for r_ in frontier.frontier(df, ["a", "b", "c"]).collect()} == want
    assert frontier.pruned(df, ["a", "b", "c"]).count() < 1000  # few rows meet those of other tasks
    assert frontier.frontier(df.limit(0), ["a", "b"]).count() == 0
    assert frontier.frontier(df.select("id", F.lit(1.0).alias("a"), F.lit(2.0).alias("b")), ["a", "b"]).count() == len(rows)


def test_diverse_choice_is_the_greedy_one(spark):
    r = np.random.default_rng(6)
    base = r.normal(0, 1, (6, 80))
    x = {k: base[k % 6] * (1 if k % 5 else -1) + r.normal(0, 0.4, 80) for k in range(90)}
    score = {k: float(k // 2 % 30) for k in x}
    panel = [(k, DAY(t), float(v)) for k, row in x.items() for t, v in enumerate(row)]
    scores = spark.createDataFrame([*score.items(), (500, 99.0), (501, None)], "candidate int, score double")
    got = [(r_.candidate, r_.score) for r_ in frontier.diverse(scores, spark.createDataFrame(panel, "candidate int, date date, ret double"), 9, 0.6, block=16).orderBy("place").collect()]
    want = []
    for k in sorted(x, key=lambda k: (-score[k], k)):
        if len(want) < 9 and all(np.corrcoef(x[k], x[o])[0, 1] < 0.6 for o in want):
            want.append(k)
    assert got == [(k, score[k]) for k in want] and len(want) == 9


RECURRENCE_ROWS = [(1, k, float(100 + math.sin(k * 1.7) * 3 + k % 5)) for k in range(400)] + [(2, k, float(k % 4)) for k in range(9)] + [(None, k, float(k % 7)) for k in range(60)] + [(3, k, 7.0) for k in range(40)]



@pytest.fixture
def spread(spark):
    """Small batches and ranges, so that a key crosses many of both."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_scan_equals_its_recurrence_over_many_tasks(spread):
    rows = [(k, t, None if t % 9 == 4 else x) for k, t, x in RECURRENCE_ROWS] + [(4, t, None) for t in range(5)] + [(5, 0, None), (5, 1, 2.0)]
    df = spread.createDataFrame(rows, "symbol int, date int, close double").repartition(5)
    x = recurrence.linear_scan(df, "symbol", ["date"], "y", F.lit(0.9), 0.1 * F.col("close"), F.col("close"))
    got = {(r.symbol, r.date): (r.y, r.y_before) for r in x.collect()}
    by = defaultdict(list)
    for k, t, v in rows:
        by[k].append((t, v))
    for k, own in by.items():
        y = None
        for t, v in sorted(own):
            before, y = y, y if v is None else v if y is None else 0.9 * y + 0.1 * v
            assert got[k, t][0] == (None if y is None else pytest.approx(y, abs=1e-9)) and got[k, t][1] == (None if before is None else pytest.approx(before, abs=1e-9))
    assert len(got) == len(rows)
    assert recurrence.linear_scan(df.limit(0), "symbol", ["date"], "y", F.lit(0.9), F.col("close"), F.col("close")).count() == 0
    assert x.withColumn("p", F.spark_partition_id()).where("symbol = 1").select("p").distinct().count() > 1


@pytest.mark.parametrize("kind", ["kama", "vidya", "frama"])
def test_adaptive_averages_equal_their_recurrence(spread, kind):
    df = spread.createDataFrame([*RECURRENCE_ROWS, (1, 1000, None)], "symbol int, date int, close double").repartition(5)
    got = {(r.symbol, r.date): r.average for r in recurrence.adaptive_average(df, kind, 10).collect()}
    assert len(got) == len(RECURRENCE_ROWS)
    by, weigh = defaultdict(list), recurrence._alpha(kind, 10)
    for k, t, v in RECURRENCE_ROWS:
        by[k].append((t, v))
    for k, own in by.items():
        x, y = np.array([v for _, v in sorted(own)]), None
        for i in range(len(x)):
            y = x[i] if i == 10 else None if i < 10 else y + float(weigh(x[None, i - 10 : i + 1])[0]) * (x[i] - y)
            assert got[k, i] == (None if y is None else pytest.approx(y, abs=1e-9))


def test_average_cost_over_many_tasks(spread):
    r = np.random.default_rng(9)
    rows = [(int(s), k, int(r.choice([1, -1])), float(r.integers(0, 9)), float(np.round(100 + r.normal(), 2))) for s in (1, 2) for k in range(300)]
    got = {(x.symbol, x.seq): (x.position, x.cost, x.realised) for x in recurrence.average_cost(spread.createDataFrame(rows, "symbol int, seq int, side int, qty double, price double")).collect()}
    for s in (1, 2):
        held = cost = gain = 0.0
        for _, k, side, qty, price in (x for x in rows if x[0] == s):
            signed = side * qty
            if held * signed >= 0:
                cost = (cost * abs(held) + price * qty) / (abs(held) + qty) if held or qty else 0.0
            else:
                gain += min(qty, abs(held)) * (price - cost) * (1 if held > 0 else -1)
                cost = price if qty > abs(held) else cost
            held += signed
            cost = cost if held else 0.0
            assert got[s, k] == pytest.approx((held, cost, gain), abs=1e-6)


def _vpin(rows, n, window):
    """The walk of one symbol's trades from bucket to bucket."""
    total, sides, side, past = sum(v for _, _, v in rows if v and v > 0), [], 0.0, None
    for _, p, _ in rows:
        side = side if past is None or p == past else math.copysign(1, p - past)
        past = p
        sides.append(side)
    size, held, net, out, ends = total / n, 0.0, 0.0, [], {}
    for i, (_, _, v) in enumerate(rows):
        left = v or 0
        while left > 1e-9:
            take = min(left, size - held)
            held, net, left = held + take, net + sides[i] * take, left - take
            if held >= size - 1e-9:
                out.append(abs(net) / size)
                held = net = 0.0
                if len(out) >= window:
                    ends[i] = max(ends.get(i, 0.0), sum(out[-window:]) / window)
    found, last = [], None
    for i in range(len(rows)):
        last = i if i in ends else last
        found.append(ends[last] if last is not None and i - last <= window else None)
    return found


def test_vpin_splits_trades_over_buckets(spread):
    r = np.random.default_rng(10)
    tapes = {1: [(t, float(100 + r.integers(-2, 3)), int(r.integers(0, 20))) for t in range(300)], 2: [(t, float(50 + t % 3), 5) for t in range(40)], 3: [(0, 1.0, 4)]}
    tapes[1][150] = (150, 103.0, 700)  # more than three buckets
    rows = [(s, t, t, p, v) for s, tape in tapes.items() for t, p, v in tape]
    df = spread.createDataFrame(rows, "symbol int, ts int, seq int, price double, size long").repartition(4)
    got = {(x.symbol, x.ts): x.vpin for x in volume_time.vpin(df, 20, 5).collect()}
    assert len(got) == len(rows)
    for s, tape in tapes.items():
        for t, v in enumerate(_vpin(tape, 20, 5)):
            assert got[s, t] == (None if v is None else pytest.approx(v, abs=1e-9)), (s, t)
    parts = volume_time.volume_buckets(volume_time.tick_signed(df), 20).groupBy("symbol", "bucket").agg(F.sum("part").alias("v")).where("symbol = 1").collect()
    assert len(parts) == 20 and max(x.v for x in parts) == pytest.approx(min(x.v for x in parts))
    assert volume_time.vpin(df.limit(0)).count() == 0


def test_a_changed_a_cut_out_and_a_swapped_entry_are_found(spark):
    rows = [(c, k, f"note {k}" if k % 3 else None) for c in ("a", "b", "c", "d", None) for k in range(6)]
    log = audits.chained(spark.createDataFrame(rows, "chain string, k int, note string"), "chain", ["k"], ["k", "note"]).cache()
    assert {(r.n_events, r.ok) for r in audits.verified_chains(log, "chain", "seq", ["k", "note"]).collect()} == {(6, True)}
    bad = log.withColumn("note", F.when((F.col("chain") == "a") & (F.col("seq") == 2), "changed").otherwise(F.col("note")))
    bad = bad.where("not (chain <=> 'b' and seq = 3)").withColumn("seq", F.when((F.col("chain") == "b") & (F.col("seq") > 3), F.col("seq") - 1).otherwise(F.col("seq")))
    bad = bad.withColumn("seq", F.when((F.col("chain") == "c") & F.col("seq").isin(4, 5), 9 - F.col("seq")).otherwise(F.col("seq")))
    bad = bad.unionByName(bad.where("chain = 'd' and seq = 1"))
    got = {r.chain: (r.ok, r.broken, r.fault) for r in audits.verified_chains(bad, "chain", "seq", ["k", "note"]).collect()}
    assert got == {"a": (False, 2, "payload"), "b": (False, 3, "link"), "c": (False, 4, "link"), "d": (False, 1, "repeated"), None: (True, None, None)}
    assert audits.verified_chains(log.where("seq != 0"), "chain", "seq", ["k", "note"]).where("not ok and broken = 1").count() == 5


def test_wilder_and_weighted_deviation_over_many_tasks(spread):
    import pandas as pd

    df = spread.createDataFrame(RECURRENCE_ROWS, "symbol int, date int, close double").repartition(5)
    got = {(r.symbol, r.date): r.rsi for r in recurrence.wilder_rsi(df, 14).collect()}
    dev = {(r.symbol, r.date): r.ewm_std for r in recurrence.ewm_deviation(df, 20, "close").collect()}
    by = defaultdict(list)
    for k, t, v in RECURRENCE_ROWS:
        by[k].append((t, v))
    for k, own in by.items():
        x = np.array([v for _, v in sorted(own)])
        d = np.diff(x)
        g, f = np.clip(d, 0, None), np.clip(-d, 0, None)
        want = pd.Series(x).ewm(span=20).std()
        for i in range(len(x)):
            if i == 14:
                a, b = g[:14].mean(), f[:14].mean()
            elif i > 14:
                a, b = (a * 13 + g[i - 1]) / 14, (b * 13 + f[i - 1]) / 14
            rsi = None if i < 14 else 100.0 if b == 0 else 100 - 100 / (1 + a / b)
            assert got[k, i] == (None if rsi is None else pytest.approx(rsi, abs=1e-9))
            assert dev[k, i] == (None if i == 0 else pytest.approx(want[i], abs=1e-6))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(pairs, "KEYS", 5)
    monkeypatch.setattr(pairs, "DAYS", 16)


def test_covariances_in_blocks_equal_those_of_each_pair(spark, small_blocks):
    import pandas as pd

    r = np.random.default_rng(12)
    rows = [(k, DAY(t), None if r.random() < 0.2 else float(r.normal(0.01, 0.02) + k / 1000)) for k in range(17) for t in range(90) if r.random() < 0.8]
    rows += [(50, DAY(t), 0.25) for t in range(90)] + [(51, DAY(t), 0.1) for t in range(10)] + [(None, DAY(1), 0.1), (3, None, 0.1)]
    df = spark.createDataFrame(rows, "symbol int, date date, ret double").repartition(4)
    wide = pd.DataFrame([x for x in rows if x[0] is not None and x[1] is not None], columns=["s", "d", "r"]).pivot(index="d", columns="s", values="r").astype(float)
    got = {(x.a, x.b): x for x in pairs.covariances(df).collect()}
    count = wide.notna().astype(int).T @ wide.notna().astype(int)
    want = {(a, b) for a in wide for b in wide if a <= b and count.loc[a, b] >= 20}
    assert set(got) == want
    for a, b in want:
        both = wide[[a]].join(wide[[b]], rsuffix="_").dropna().to_numpy() if a != b else np.repeat(wide[[a]].dropna().to_numpy(), 2, 1)
        c = np.cov(both.T)[0, 1]
        assert got[a, b].n == len(both) and got[a, b].cov == pytest.approx(c * 252, abs=1e-9)
        s = both.std(0).prod()
        assert got[a, b].corr == (None if s < 1e-12 else pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-9))
    assert pairs.covariances(df.limit(0)).count() == 0


@pytest.mark.parametrize("target", pairs.TARGETS)
def test_shrinkage_equals_its_formula(spark, small_blocks, target):
    r = np.random.default_rng(13)
    x = r.normal(0, 1, (60, 12)) @ r.normal(0, 0.3, (12, 12)) / 50
    rows = [(f"c{k:02d}", DAY(t), float(x[t, k])) for k in range(12) for t in range(60)] + [("c00", DAY(99), 0.3)]
    df = spark.createDataFrame(rows, "candidate string, date date, x double")
    c = x - x.mean(0)
    s, sq = c.T @ c / 60, (c * c).T @ (c * c) / 60
    sd, off = np.sqrt(np.diag(s)), ~np.eye(12, dtype=bool)
    f = {"constant_variance": np.trace(s) / 12 * np.eye(12), "identity": np.eye(12), "single_factor": np.where(off, s[off].mean(), s), "constant_correlation": np.where(off, (s / np.outer(sd, sd))[off].mean() * np.outer(sd, sd), s)}[target]
    delta = min(1.0, max(0.0, (sq - s * s).sum() / ((f - s) ** 2).sum() / 60))
    alpha, mu = (s * s).mean(), np.trace(s) / 12
    got = pairs.shrunk_covariances(df, target).collect()
    assert len(got) == 78 and all(g.intensity == pytest.approx(delta) and g.oas == pytest.approx(min(1, (alpha + mu**2) / (61 * (alpha - mu**2 / 12)))) for g in got)
    want = (delta * f + (1 - delta) * s) * 252
    assert all(g["cov"] == pytest.approx(want[int(g.a[1:]), int(g.b[1:])], abs=1e-12) for g in got)
    if target == "identity":
        w = (1 - 2 / 61) ** np.arange(59, -1, -1)
        w /= w.sum()
        e = x - w @ x
        want = (e * w[:, None]).T @ e * 252 / (1 - (w**2).sum())
        assert all(g["cov"] == pytest.approx(want[int(g.a[1:]), int(g.b[1:])], abs=1e-12) for g in pairs.exponential_covariances(df).collect())
        assert pairs.shrunk_covariances(df.limit(0)).count() == pairs.exponential_covariances(df.limit(0)).count() == 0


def test_pair_sums_over_many_blocks_need_no_sum_after(spark, monkeypatch):
    monkeypatch.setattr(pairs, "KEYS", 3)
    monkeypatch.setattr(pairs, "DAYS", 7)
    r = np.random.default_rng(21)
    x = {(f"k{k:02d}", t): float(r.normal()) for k in range(20) for t in range(-10, 30) if r.random() < 0.5 and (k < 18 or t < -5 + 20 * (k - 18))}
    df = spark.createDataFrame([(k, DAY(t), v) for (k, t), v in x.items()], "symbol string, date date, ret double").repartition(5)
    found = pairs.pair_sums(df, {"x": F.col("ret")}, {"n": ("one", "one"), "sx": ("x", "one"), "sq": ("x^2", "x")})
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(v.a, v.b): (v.n, v.sx, v.sq) for v in found.collect()}
    names, want = sorted({k for k, _ in x}), {}
    for i, a in enumerate(names):
        for b in names[i:]:
            both = [t for t in range(-10, 30) if (a, t) in x and (b, t) in x]
            if both:
                want[a, b] = pytest.approx((len(both), sum(x[a, t] for t in both), sum(x[a, t] ** 2 * x[b, t] for t in both)))
    assert got == want


def test_pairs_that_meet_by_chance_are_not_joined_with_returns(spark, monkeypatch):
    r = np.random.default_rng(22)
    base = r.normal(0, 0.02, (300, 60))
    panel = [(k * 10 + v, DAY(t), float(y)) for k, row in enumerate(base) for v in (0, 1) for t, y in enumerate(row * (1, -2)[v] + (0, 0.001)[v] * r.normal(size=60))]
    seen = []
    plain = duplicates.correlated
    monkeypatch.setattr(duplicates, "correlated", lambda p, *a: seen.append(p.count()) or plain(p, *a))
    df = spark.createDataFrame(panel, "candidate int, date date, ret double")
    links = {(x.a, x.b) for x in duplicates.near_links(df, 0.98, 10).collect()}
    assert links == {(k * 10, k * 10 + 1) for k in range(300)} and sum(seen) <= 320


def test_blocks_are_written_once_however_many_they_meet(spark, monkeypatch):
    monkeypatch.setattr(pairs, "KEYS", 3)
    monkeypatch.setattr(pairs, "DAYS", 7)
    df = spark.createDataFrame([(k, DAY(t), float((k * 7 + t * t) % 11)) for k in range(30) for t in range(21)], "symbol int, date date, ret double")
    blocks = pairs.packed(df, {"x": F.col("ret")})
    files = [name for block in blocks.files for name in block.values()]
    packed = spark.read.parquet(*files)
    assert len(blocks.files) > 5 and len(files) == packed.count() == len(set(files))
    assert packed.agg(F.sum(F.octet_length("d"))).first()[0] == 30 * 21  # a byte for each row of the panel
    found = pairs.multiplied(blocks, {"n": ("one", "one"), "s": ("x", "x")})
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 30 * 31 // 2


def test_shrinkage_of_all_targets_needs_no_pairs(spark, small_blocks, monkeypatch):
    r = np.random.default_rng(31)
    rows = [(k, DAY(t), float(r.normal(k / 10, 0.02))) for k in range(17) for t in range(50)] + [(3, DAY(80), 0.5), (None, DAY(1), 0.1)]
    df = spark.createDataFrame(rows, "candidate int, date date, x double")
    want = {k: pairs.shrunk_covariances(df, k).agg(F.count("*").alias("n"), F.max("intensity").alias("i"), F.max("oas").alias("o")).first() for k in pairs.TARGETS}
    columns = []
    plain = pairs.multiplied
    monkeypatch.setattr(pairs, "multiplied", lambda *a, **k: columns.append(plain(*a, **k).columns) or plain(*a, **k))
    got = {x.target: x for x in pairs.shrinkage(df).collect()}
    assert set(got) == set(pairs.TARGETS) and all((got[k].n, got[k].intensity, got[k].oas) == pytest.approx((w.n, w.i, w.o)) for k, w in want.items())
    assert len(columns) == 2 and not any({"a", "b"} & set(c) for c in columns)  # two passes for four targets, of sums alone
    assert pairs.shrinkage(df.where("candidate = 4")).where("n = 1").count() == 4 and pairs.shrinkage(df.limit(0)).count() == 0


def test_complete_dates_are_counted_by_candidate(spark):
    rows = [(k, DAY(t), float(k + t)) for k in range(40) for t in range(9) if (k, t) != (7, 4)] + [(3, DAY(5), 1.0), (3, DAY(20), 1.0), (None, DAY(4), 1.0), (8, None, 1.0), (9, DAY(1), None)]
    x, n = pairs._complete(spark.createDataFrame(rows, "candidate int, date date, x double"))
    assert n == 8 and {(v.candidate, v.t) for v in x.where("candidate is not null").collect()} == {(k, t) for k in range(40) for t in range(8)}


def test_shrunk_covariances_make_pairs_once(spark, small_blocks):
    r = np.random.default_rng(33)
    df = spark.createDataFrame([(k, DAY(t), float(r.normal(0, 0.02))) for k in range(13) for t in range(40) if k < 12 or t < 9], "symbol int, date date, ret double")
    got = panels.shrunk(pairs.covariances(df), 0.2, pairs.variances(df))
    assert got._jdf.queryExecution().executedPlan().toString().lower().count("mapinarrow") == 1
    want = {(x.a, x.b): x["cov"] for x in panels.shrunk(pairs.covariances(df), 0.2).collect()}
    assert len(want) == 78 and {(x.a, x.b): x["cov"] for x in got.collect()} == pytest.approx(want)


def test_families_are_packed_apart_and_once(spark, monkeypatch):
    monkeypatch.setattr(pairs, "KEYS", 4)
    r = np.random.default_rng(34)
    panel = spark.createDataFrame([(k, DAY(t), float(r.normal())) for k in range(24) for t in range(70)], "signal int, date date, ret double")
    names = spark.createDataFrame([(k, k, f"f{k % 2}", 1) for k in range(24)], "signal int, place int, family string, sign int")
    seen = []
    plain = pairs.packed
    monkeypatch.setattr(pairs, "packed", lambda *a, **k: seen.append(plain(*a, **k)) or seen[-1])
    assert duplicates.redundancy_groups(names, panel, 0.9).where("group_size = 1").count() == 24
    rows = spark.read.parquet(*[f for block in seen[0].files for f in block.values()])
    assert {(x.g, x.n) for x in rows.groupBy("g").agg(F.sum(F.octet_length("d")).alias("n")).collect()} == {("f0", 840), ("f1", 840)}
    assert len(seen[0].files) > 4 and len(set(seen[0].ends)) == 2


def test_tails_are_packed_as_bytes_and_not_shuffled(spark, small_blocks, monkeypatch):
    r = np.random.default_rng(35)
    x = r.normal(0, 0.02, (14, 80))
    df = spark.createDataFrame([(k, DAY(t), float(x[k, t])) for k in range(14) for t in range(80) if k < 13 or t < 50], "symbol int, date date, ret double")
    seen = []
    plain = pairs.packed
    monkeypatch.setattr(pairs, "packed", lambda *a, **k: seen.append(plain(*a, **k)) or seen[-1])
    got = pairs.tail_dependence(df, 0.1)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = spark.read.parquet(*[f for block in seen[0].files for f in block.values()])
    assert rows.agg(F.sum(F.octet_length("x"))).first()[0] == 2 * (13 * 80 + 50)
    u = x[:13].argsort(1).argsort(1) / 79
    want = {(a, b): (80, ((u[a] <= 0.1) & (u[b] <= 0.1)).sum() / 8, ((u[a] >= 0.9) & (u[b] >= 0.9)).sum() / 8) for a in range(13) for b in range(a + 1, 13)}
    assert {(v.a, v.b): (v.n, v.lower, v.upper) for v in got.collect()} == {k: pytest.approx(v) for k, v in want.items()}


def test_weighted_covariances_are_not_shuffled(spark, small_blocks):
    r = np.random.default_rng(36)
    x = r.normal(5, 0.02, (11, 70))  # a level that would cancel if series did not lie about 0
    df = spark.createDataFrame([(k, DAY(t), float(x[k, t])) for k in range(11) for t in range(70)], "candidate int, date date, x double")
    got = pairs.exponential_covariances(df, span=20)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    w = (1 - 2 / 21) ** np.arange(69, -1, -1)
    w /= w.sum()
    e = x.T - w @ x.T
    want = (e * w[:, None]).T @ e * 252 / (1 - (w**2).sum())
    found = {(v.a, v.b): v["cov"] for v in got.collect()}
    assert len(found) == 66 and all(v == pytest.approx(want[k], abs=1e-12) for k, v in found.items())


def test_pairs_leave_their_task_with_what_is_asked(spark, small_blocks, monkeypatch):
    r = np.random.default_rng(37)
    df = spark.createDataFrame([(k, DAY(t), float(r.normal(0, 0.02))) for k in range(12) for t in range(40) if k < 11 or t < 9], "symbol int, date date, ret double")
    seen = []
    plain = pairs.multiplied
    monkeypatch.setattr(pairs, "multiplied", lambda *a, **k: seen.append(plain(*a, **k)) or seen[-1])
    assert panels.pair_similarity(pairs.covariances(df), 0.05).count() == 55
    assert seen[0].columns == ["a", "b", "n", "c", "scale"] and seen[0].count() == 66  # none of too few dates
    seen.clear()
    x = df.where("symbol < 11").select(F.col("symbol").alias("candidate"), "date", F.col("ret").alias("x"))
    assert pairs.shrunk_covariances(x, "constant_correlation").count() == 66
    assert [v.columns for v in seen][2] == ["a", "b", "cov"] and all(len({"a", "b"} & set(v.columns)) == 0 for v in seen[:2])


def test_series_of_pairs_meet_whole_and_once(spark):
    r = np.random.default_rng(38)
    x = np.where(r.random((30, 50)) < 0.1, np.nan, r.normal(0, 1, (30, 50)).cumsum(0))
    x[4] = 0.1
    df = spark.createDataFrame([(k, DAY(t), None if np.isnan(x[k, t]) else float(x[k, t])) for k in range(30) for t in range(50) if (k, t % 2) != (9, 0)] + [(3, None, 1.0)], "candidate int, date date, ret double").repartition(5)
    pairs_ = spark.createDataFrame([(a, b) for a in range(30) for b in range(a + 1, 30)], "a int, b int")
    found = duplicates.correlated(pairs_, duplicates._series(df), 0.5, 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") == 2 and plan.count("Exchange") == 2  # pairs go to a, then with its series to b
    want = {}
    for a in range(30):
        for b in range(a + 1, 30):
            both = np.isfinite(x[a]) & np.isfinite(x[b]) & ((np.arange(50) % 2 == 1) | (9 not in (a, b)))
            if both.sum() >= 20 and 4 not in (a, b) and abs(c := np.corrcoef(x[a][both], x[b][both])[0, 1]) >= 0.5:
                want[a, b] = (both.sum(), pytest.approx(c))
    assert {(v.a, v.b): (v.n, v["corr"]) for v in found.collect()} == want and want
