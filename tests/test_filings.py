"""Filings and neighbours against brute force: ties, nulls, empty tables, hubs."""

import datetime as dt
import io
import json
import random
import zipfile
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import neighbours
from tidemark.sources import filings


def _company():
    entry = {"start": "2020-01-01", "end": "2020-12-31", "val": 12345678901234567.125, "accn": "a-1", "fy": 2020, "fp": "FY", "form": "10-K", "filed": "2021-02-01"}
    text = json.dumps({"cik": 7, "entityName": "Seven", "facts": {"us-gaap": {"Assets": {"label": "x", "units": {"USD": [entry, entry, {**entry, "val": "n/a"}, {**entry, "val": None}, {**entry, "end": ""}, {k: v for k, v in entry.items() if k != "accn"}], "EUR": []}}, "Empty": {"units": {}}}, "dei": {"Shares": {"units": {"shares": [{**entry, "val": 5, "accepted": "2021-02-01T10:00:00"}, {**entry, "val": 6}]}}}}})
    return text.replace("1.2345678901234568e+16", "12345678901234567.125")


def test_company_facts_keep_every_digit_and_say_what_is_wrong(spark):
    docs = spark.createDataFrame([(_company(),), ("{broken",), (None,), ('{"cik": 8, "entityName": "Eight", "facts": {}}',)], "json string")
    facts = filings.company_facts(docs)
    got = facts.collect()
    assert sorted(str(r.fault) for r in got) == ["None"] * 4 + ["accession", "end", "json", "json", "value", "value"]
    assert {r.value for r in got if r.tag == "Assets" and r.fault is None} == {Decimal("12345678901234567.1250000000")}
    good, bad = filings.normal_facts(facts)
    kept = {(r.tag, r.value) for r in good.collect()}
    assert kept == {("Assets", Decimal("12345678901234567.1250000000")), ("Shares", Decimal("5.0000000000"))}  # the later accepted one
    assert sorted(r.fault for r in bad.collect()) == ["accession", "conflict", "end", "json", "json", "repeated", "value", "value"]
    subs = spark.createDataFrame([("a-1", "2021-02-01T16:05:00", "2021-02-01", "10-K"), ("a-1", "2021-01-01T00:00:00", None, None)], "accession string, accepted string, filed string, form string")
    with_time = {(r.tag, str(r.value)[:1]): r.accepted for r in filings.with_acceptance(facts, subs).where("fault is null").collect()}
    assert with_time == {("Assets", "1"): "2021-02-01T16:05:00", ("Shares", "5"): "2021-02-01T10:00:00", ("Shares", "6"): "2021-02-01T16:05:00"}
    assert filings.company_facts(docs.limit(0)).count() == 0


def test_a_document_that_breaks_off_is_one_fault(spark):
    text = _company()
    docs = spark.createDataFrame([(text[:n],) for n in range(1, len(text))], "json string")
    got = filings.company_facts(docs).collect()
    assert [(r.fault, r.cik, r.entity, r.value) for r in got] == [("json", None, None, None)] * (len(text) - 1)


def _zip(tables, names=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for member, rows in tables.items():
            cols = list(rows[0])
            z.writestr((names or {}).get(member, f"2024q1/{member.lower()}.tsv"), "﻿" + "\n".join("\t".join(x) for x in [cols, *[[str(r[c]) for c in cols] for r in rows]]) + "\n")
    return out.getvalue()


def _tables(groups):
    sub, cover, info = [], [], []
    for manager, filed in groups.items():
        for n, (kind, day, held) in enumerate(filed):
            key = f"{manager}-{n}"
            sub.append({"ACCESSION_NUMBER": key, "FILING_DATE": day, "SUBMISSIONTYPE": "13F-HR" if kind == "first" else "13F-HR/A" if kind != "notice" else "13F-NT", "CIK": f"000{manager}", "PERIODOFREPORT": "31-MAR-2024"})
            cover.append({"ACCESSION_NUMBER": key, "AMENDMENTTYPE": {"restate": "RESTATEMENT", "add": "NEW HOLDINGS"}.get(kind, "")})
            info += [{"ACCESSION_NUMBER": key, "NAMEOFISSUER": "I", "TITLEOFCLASS": "COM", "CUSIP": c, "VALUE": n_ * 10, "SSHPRNAMT": n_, "SSHPRNAMTTYPE": k, "PUTCALL": o, "INVESTMENTDISCRETION": "SOLE"} for c, n_, k, o in held]
    return {"SUBMISSION": sub, "COVERPAGE": cover, "INFOTABLE": info}


def test_restatements_replace_and_new_holdings_add(spark, tmp_path):
    one = lambda c, n: (c * 9, n, "SH", "")
    groups = {
        11: [("first", "2024-05-01", [one("A", 5), one("A", 6), one("B", 7), ("C" * 9, 9, "PRN", ""), ("D" * 9, 9, "SH", "PUT"), ("E", 9, "SH", ""), one("F", 0)])],
        12: [("first", "2024-05-01", [one("A", 1)]), ("restate", "2024-05-09", [one("B", 2)])],
        13: [("first", "2024-05-01", [one("A", 1)]), ("add", "2024-05-09", [one("B", 2)])],
        14: [("first", "2024-05-01", [one("A", 1)]), ("restate", "2024-05-02", [one("C", 3)]), ("add", "2024-05-09", [one("B", 2)])],
        15: [("first", "2024-05-01", [one("A", 1)]), ("other", "2024-05-09", [one("B", 2)])],
        16: [("add", "2024-05-01", [one("A", 1)])],
        17: [("notice", "2024-05-01", [one("A", 1)])],
        18: [("first", "01-MAY-2024", [one("A", 1)]), ("first", "02-MAY-2024", [one("B", 4)])],
    }
    tables = _tables(groups)
    half = lambda keep: {m: [r for r in rows if keep(int(r["ACCESSION_NUMBER"][:2]))] for m, rows in tables.items()}
    (tmp_path / "a.zip").write_bytes(_zip(half(lambda m: m % 2)))
    (tmp_path / "b.zip").write_bytes(_zip(half(lambda m: m % 2 == 0), {"SUBMISSION": "SUBMISSION.txt"}))
    rows = filings.read_archives(spark, f"{tmp_path}/*.zip")
    held = lambda found: {(r.manager, r.cusip[0]): (r.shares, r.value) for r in found.collect()}
    filed, own, out = filings.holdings(rows)
    assert held(own) == {("11", "A"): (11.0, 110.0), ("11", "B"): (7.0, 70.0), ("12", "B"): (2.0, 20.0), ("18", "B"): (4.0, 40.0)}
    assert {r.accession for r in filed.collect()} == {"11-0", "12-1", "18-1"}
    assert {(r.manager, r.accession, r.amendment_type) for r in out.collect()} == {("13", "13-1", "NEW HOLDINGS"), ("14", "14-2", "NEW HOLDINGS"), ("15", "15-1", ""), ("16", "16-0", "NEW HOLDINGS")}
    filed, own, out = filings.holdings(rows, additions=True)
    assert held(own) == {("11", "A"): (11.0, 110.0), ("11", "B"): (7.0, 70.0), ("12", "B"): (2.0, 20.0), ("13", "A"): (1.0, 10.0), ("13", "B"): (2.0, 20.0), ("14", "C"): (3.0, 30.0), ("14", "B"): (2.0, 20.0), ("18", "B"): (4.0, 40.0)}
    assert {r.manager for r in out.collect()} == {"15", "16"}
    broken = spark.createDataFrame([("x.zip", bytearray(_zip({"SUBMISSION": [{"CIK": 1}]})))], "path string, content binary")
    with pytest.raises(Exception, match="x.zip: SUBMISSION lacks"):
        filings.archive_rows(broken).collect()


def test_nearest_takes_the_least_ids_of_ties(spark):
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(60, 0, -1)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = [r.id for r in neighbours.nearest(df.coalesce(1), df.where("id = 60"), 3).orderBy("id").collect()]
    assert got == [1, 2, 3]
    r = random.Random(1)
    rows = [(k, [float(r.randint(-2, 2)) for _ in range(3)]) for k in range(300)] + [(900, None), (901, [0.0] * 3)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(7)
    found = defaultdict(list)
    for x in neighbours.nearest(df, df.where("id % 10 = 0 or id = 901"), 5, block=13).orderBy("query", F.desc(F.round("cosine", 9)), "id").collect():
        found[x.query].append(x.id)
    full = {k: np.array(v) for k, v in rows if v}
    cos = lambda a, b: round(float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-300)), 9) + 0.0
    for q in [k for k in full if k % 10 == 0 or k == 901]:
        assert found[q] == sorted((k for k in full if k != q), key=lambda k: (-cos(full[q], full[k]), k))[:5]
    assert neighbours.nearest(df, df.limit(0), 5).count() == neighbours.nearest(df.limit(0), df, 5).count() == 0


def test_analogues_equal_a_walk_over_the_past(spark):
    r = np.random.default_rng(2)
    rows = []
    for key, n in (("a", 120), (None, 40), ("b", 3)):
        x = np.round(r.normal(0, 1, (n, 2)), 1)
        rows += [(key, t, float(x[t, 0]) if t % 17 else None, float(x[t, 1]), None if t > n - 4 else float(r.normal())) for t in range(n)]
    df = spark.createDataFrame(rows, "key string, t long, a double, b double, outcome double").repartition(3)
    got = {(x.key, x.t): x for x in neighbours.analogues(df, ["a", "b"], 5, 6, block=16).collect()}
    want = set()
    for key, t, a, b, _ in rows:
        past = sorted(((p[2] - a) ** 2 + (p[3] - b) ** 2, p[1], p[4]) for p in rows if a is not None and p[0] == key and p[2] is not None and p[4] is not None and p[1] <= t - 6)[:5]
        if len(past) == 5:
            y = [p[2] for p in past]
            want.add((key, t))
            x = got[key, t]
            assert (x.mean, x.median, x.up, x.deviation) == pytest.approx((np.mean(y), np.median(y), np.mean(np.array(y) > 0), np.std(y)))
    assert set(got) == want and len(want) > 100


def test_similar_nodes_with_a_hub(spark):
    r = random.Random(3)
    edges = {(n, 0): round(r.random(), 2) for n in range(400)} | {(n, r.randint(1, 60)): round(r.random(), 2) for n in range(400) for _ in range(2)}
    df = spark.createDataFrame([(n, f, w) for (n, f), w in edges.items()] + [(3, 0, 9.0), (None, 0, 0.0), (5, None, 0.0)], "node int, factor int, weight double")
    x = neighbours.similar(df, df.where("node % 50 = 0").select("node"), 4, salts=7, hub=100)
    got = defaultdict(dict)
    for row in x.collect():
        got[row.query][row.node] = (round(row.distance, 9), row.shared)
    by = defaultdict(list)
    for (n, f), w in edges.items():
        by[f].append((n, w))
    for q in range(0, 400, 50):
        met = defaultdict(list)
        for (n, f), w in edges.items():
            if n == q:
                for o, v in by[f]:
                    if o != q:
                        met[o].append(w + v)
        best = sorted(met, key=lambda o: (min(met[o]), -len(met[o]), o))[:4]
        assert got[q] == {o: (round(min(met[o]), 9), len(met[o])) for o in best}
    assert neighbours.similar(df, df.limit(0).select("node"), 4).count() == 0


def test_more_filings_make_more_archives(spark, monkeypatch):
    from tidemark.plans import filings as plan

    monkeypatch.setattr(plan, "FILINGS", 10)
    sizes = [len(r.content) for r in plan._archives(spark, "/root/testdata/sf0.001").collect()]
    assert len(sizes) > 100 and max(sizes) < 20_000


def test_no_candidate_of_an_analogue_is_shuffled(spark):
    rows = [(k, t, float(t % 7), None if t > 55 else float(t)) for k in (1, 2) for t in range(60)]
    df = spark.createDataFrame(rows, "key int, t long, a double, outcome double")
    x = neighbours.analogues(df, ["a"], 3, 2, block=8)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.find("MapInPandas") < plan.find("Exchange")  # nothing is dealt after the pairs are made
    near = lambda t: sorted(((p % 7 - t % 7) ** 2, p) for p in range(60) if p <= min(t - 2, 55))[:3]  # noqa: E731  many ties
    assert {(r.key, r.t): r.mean for r in x.collect()} == {(k, t): sum(p for _, p in near(t)) / 3 for k in (1, 2) for t in range(4, 60)}


def test_serial_structure_over_batches_gaps_and_flat_rows(spark):
    from tidemark.operators import lanes

    r = random.Random(5)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=t) for t in range(60)]
    rows = [(s, d, None if (s, t) in {("a", 0), ("b", 20)} else 0.1 if s == "flat" else r.gauss(0, 1)) for s in ("a", "b", "flat", None) for t, d in enumerate(days)] + [("short", days[0], 1.0)]
    df = spark.createDataFrame(rows, "symbol string, date date, ret double").orderBy(F.rand(3))
    n, k = 7, 3
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)  # windows span batches
        x = lanes.serial_structure(df, n, k)
        got = {(y.symbol, y.date): (y.rho, y.ratio) for y in x.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert "Window" not in x._jdf.queryExecution().executedPlan().toString() and len(got) == len(rows)
    found = 0
    for s in ("a", "b", "flat", None, "short"):
        own = [v for a, _, v in rows if a == s]
        for t, v in enumerate(own):
            span = own[max(0, t - n - k + 2) : t + 1]
            if len(span) < n + k - 1 or None in span:
                assert got[s, days[t]] == (None, None)
            elif s == "flat":
                assert got[s, days[t]] == (None, None)  # no variance
            else:
                a, p = np.array(own[t - n + 1 : t + 1]), np.array(own[t - n : t])
                sums = np.array([sum(own[i - k + 1 : i + 1]) for i in range(t - n + 1, t + 1)])
                assert got[s, days[t]] == pytest.approx((np.corrcoef(a, p)[0, 1], sums.var() / (k * a.var())))
                found += 1
    assert found > 100


def test_similar_nodes_deal_by_their_pairs(spark, monkeypatch):
    monkeypatch.setattr("tidemark.common.ROWS", 100)
    rows = [(n, n % 10, 1.0 + n % 3) for n in range(200)] + [(n, 10 + n % 7, 2.0) for n in range(200)] + [(3, 3, 0.5)]
    df = spark.createDataFrame(rows, "node int, factor int, weight double")
    x = neighbours.similar(df, df.where("node % 20 = 0").select("node"), 3, salts=4, hub=25)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # partitions grow with edges and pairs
    w = {}
    for n, f, v in rows:
        w[n, f] = min(v, w.get((n, f), v))
    got = defaultdict(list)
    for r in x.collect():
        got[r.query].append((r.distance, -r.shared, r.node))
    for q in range(0, 200, 20):
        met = defaultdict(list)
        for (n, f), v in w.items():
            if n != q and (q, f) in w:
                met[n].append(v + w[q, f])
        assert sorted(got[q]) == sorted((min(v), -len(v), n) for n, v in met.items())[:3]
