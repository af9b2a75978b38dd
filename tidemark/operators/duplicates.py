"""Duplicate strategies of a return panel (candidate, date, ret): candidate pairs by signs of random projections, then exact correlation."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.common import ROWS, place, written
from tidemark.operators.graph import components
from tidemark.operators.pairs import pair_moments

#: Bands of signs. Two series with correlation 0.95 meet in one with probability 0.9999, two without correlation with 0.0015.
#: More candidates take more signs, and bands in proportion, so that a band's buckets stay small.
BANDS, SIGNS, MOST = 48, 16, 24


def _mixed(x: np.ndarray) -> np.ndarray:
    """Whole numbers scrambled so that each bit depends on every bit."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _series(panel: DataFrame) -> DataFrame:
    """(candidate, d, r): the days of each candidate in order and its returns, as a table in buckets of candidates, so that joins by candidate move no series. Rows without a day are left out."""
    spark = panel.sparkSession
    n = max(-(-panel.count() // ROWS), min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = F.array_sort(F.collect_list(F.when(F.col("date").isNotNull(), F.struct(F.unix_date("date").alias("d"), F.col("ret").alias("r")))))
    x = panel.select("candidate", "date", F.col("ret").cast("double").alias("ret")).repartition(n, "candidate").groupBy("candidate").agg(rows.alias("rows"))
    name = f"tidemark_{uuid.uuid4().hex}"
    x.select("candidate", F.col("rows.d").alias("d"), F.col("rows.r").alias("r")).write.format("parquet").option("path", place(spark, "series")).bucketBy(n, "candidate").saveAsTable(name)
    series = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only its name: the files stay in the shared folder
    return series


def fingerprints(series: DataFrame, decimals: int) -> DataFrame:
    """(candidate, fingerprint): SHA-256 of the rounded returns by date; a missing return counts as 0 and so says nothing."""
    told = F.zip_with("d", "r", lambda d, r: F.struct(F.date_from_unix_date(d).alias("date"), F.round(r * 10**decimals).cast("long").alias("q")))
    return series.select("candidate", F.sha2(F.to_json(F.struct(F.filter(told, lambda x: x["q"] != 0).alias("r"))), 256).alias("fingerprint"))


def _signatures(series: DataFrame, signs: int) -> DataFrame:
    """(candidate, keys, marks): the key of each band from signs of projections of each centred series, a band and its opposite being one key, and BANDS * SIGNS signs as longs."""
    bands = BANDS * signs // SIGNS
    series = series.where(F.exists("r", lambda r: r.isNotNull()))
    kind = series.schema["candidate"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = np.uint64(1) << np.arange(signs, dtype=np.uint64)
        every = np.uint64((1 << signs) - 1)
        for f in frames:
            if not len(f):
                continue
            days = np.unique(np.concatenate(f["d"].to_list()))
            plane = _mixed(days[:, None].astype(np.int64) * 4099 + np.arange(bands * signs)[None])
            plane = np.where(plane & np.uint64(1), 1.0, -1.0).astype(np.float32)
            keys, marks = [], []
            for d, r in zip(f["d"], f["r"], strict=True):
                z, told = np.asarray(r, float), ~pd.isna(r)
                z = (z[told] - z[told].mean()).astype(np.float32)
                bits = z @ plane[np.searchsorted(days, d[told])] > 0
                marks.append(np.packbits(bits[: BANDS * SIGNS]).view(np.int64))
                key = (bits.reshape(bands, signs) * weight).sum(1).astype(np.uint64)
                keys.append(np.minimum(key, every ^ key).astype(np.int64))
            yield pd.DataFrame({"candidate": f["candidate"], "keys": keys, "marks": marks})

    return series.mapInPandas(run, f"candidate {kind}, keys array<long>, marks array<long>")


def signed_bands(panel: DataFrame, signs: int = SIGNS) -> DataFrame:
    """(candidate, band, key): a row for each band of `signs` signs."""
    return _signatures(_series(panel), signs).select("candidate", F.posexplode("keys").alias("band", "key"))


def _alike(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (a, b) of which a third of all signs at most differ, or as few agree. By chance half differ, of 768 signs 384 with a deviation of 14; at a correlation of 0.95 a tenth does."""
    side = lambda c: marks.select(F.col("candidate").alias(c), F.col("marks").alias(f"_{c}"))
    differ = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    third = BANDS * SIGNS // 3
    return pairs.join(side("a"), "a").join(side("b"), "b").where(~differ.between(third + 1, BANDS * SIGNS - third - 1)).select("a", "b")


def correlated(pairs: DataFrame, series: DataFrame, threshold: float, least: int) -> DataFrame:
    """Of pairs (a, b) those whose returns on common dates, `least` at least, have an absolute correlation of the threshold or more.

    Whole series meet, in the buckets of their table: of a pair only the series of a travels, once, as one row.
    """
    side = lambda c: series.select(F.col("candidate").alias(c), F.col("d").alias(f"d_{c}"), F.col("r").alias(f"r_{c}"))
    met = pairs.select("a", "b").hint("shuffle_hash").join(side("a"), "a").join(side("b").hint("shuffle_hash"), "b").select("a", "b", "d_a", "r_a", "d_b", "r_b")
    kind = series.schema["candidate"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, n, corr = [], [], []
            for k in range(batch.num_rows):
                d, x, e, y = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in range(2, 6))
                lo, hi = np.searchsorted(e, d, "left"), np.searchsorted(e, d, "right")
                at = np.repeat(np.arange(len(d)), hi - lo)
                x, y = x[at], y[lo[at] + np.arange(len(at)) - np.searchsorted(at, at, "left")]
                both = ~(np.isnan(x) | np.isnan(y))
                if not least <= both.sum() or not both.any():
                    continue
                x, y = x[both], y[both]
                x, y = x - x[0], y - y[0]  # a constant series is 0 then
                x, y = x - x.mean(), y - y.mean()
                s = np.sqrt((x * x).mean() * (y * y).mean())
                c = (x * y).mean() / s if s > 0 else 0.0
                if s > 0 and abs(c) >= threshold:
                    where.append(k)
                    n.append(len(x))
                    corr.append(c)
            at = pa.array(where, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(n, pa.int64()), pa.array(corr, pa.float64())], names=["a", "b", "n", "corr"])

    return met.mapInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}, n long, corr double")


def near_links(panel: DataFrame, threshold: float, least: int, series: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that join every two candidates of a class of near-duplicates by a path. `series` may stand for the panel, and `among` (candidate) says which are compared.

    Pairs that share a bucket are compared by their signs before their returns are joined.
    A bucket of equal signs first meets its least member, which is linear in its size. Where all
    its members come out in one component, nothing else is compared; only members of
    different components meet each other, so a large bucket of copies makes no square.
    """
    series = _series(panel) if series is None else series
    compared = series if among is None else series.join(among.hint("shuffle_hash"), "candidate", "left_semi")
    n = (series if among is None else among).agg(F.approx_count_distinct("candidate")).first()[0] or 1
    marked = written(_signatures(compared, min(MOST, max(SIGNS, int(np.ceil(np.log2(n)))))), "bands")
    keyed, marks = marked.select("candidate", F.posexplode("keys").alias("band", "key")), marked.select("candidate", "marks")
    w = Window.partitionBy("band", "key")
    met = keyed.withColumn("a", F.min("candidate").over(w)).where("a != candidate").select("a", F.col("candidate").alias("b")).distinct()
    first = written(correlated(written(_alike(met, marks), "met"), series, threshold, least).select("a", "b"), "near")
    roots = components(first)
    labelled = keyed.join(roots, keyed["candidate"] == roots["node"], "left").select("candidate", "band", "key", F.coalesce("root", "candidate").alias("root"))
    open_ = labelled.groupBy("band", "key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo != _hi").select("band", "key")
    rest = labelled.join(open_, ["band", "key"])
    other = rest.select("band", "key", F.col("candidate").alias("b"), F.col("root").alias("root_b"))
    pairs = rest.withColumnRenamed("candidate", "a").join(other, ["band", "key"]).where("a < b and root != root_b").select("a", "b").distinct()
    rest = written(_alike(pairs.join(met, ["a", "b"], "left_anti"), marks), "met")
    return first.unionByName(correlated(rest, series, threshold, least).select("a", "b"))


def duplicate_groups(panel: DataFrame, results: DataFrame, rank: list[Column], threshold: float = 0.98, decimals: int = 8, share: float = 0.5) -> DataFrame:
    """Every row of results (candidate, ...) with its group, the group's size, whether it stands for the group, and its fingerprint.

    Candidates are linked by equal rounded returns or by an absolute correlation of `threshold`
    or more over at least ten common dates and `share` of all; groups are connected components,
    named by their least candidate. Of a group the first by `rank`, then by candidate, stands
    for it. Only one candidate of each fingerprint is projected and compared. Candidates without returns stand alone. Signs find
    pairs that share their dates; the more dates one of two series lacks, the likelier they are missed (half of them: 3 of 10). The panel is read twice, so one that costs much to make should be written first.
    """
    panel = panel.where("candidate is not null")
    series = _series(panel)
    marks = written(fingerprints(series, decimals), "marks")
    dates = series.select(F.explode("d").alias("d")).agg(F.count_distinct("d")).first()[0]
    least = max(10, int(dates * share))
    first = marks.groupBy("fingerprint").agg(F.min("candidate").alias("a"))
    exact = marks.join(first, "fingerprint").select("a", F.col("candidate").alias("b")).where("a != b")
    near = near_links(panel, threshold, least, series, first.select(F.col("a").alias("candidate")))
    roots = components(exact.unionByName(near))
    x = results.join(roots, results["candidate"] == roots["node"], "left").drop("node")
    x = x.withColumn("grp", F.coalesce("root", "candidate")).drop("root").join(marks, "candidate", "left")
    size = F.count("*").over(Window.partitionBy("grp"))
    stands = F.row_number().over(Window.partitionBy("grp").orderBy(*rank, "candidate")) == 1
    return x.withColumns({"group_size": size, "representative": stands})


def redundancy_groups(signals: DataFrame, panel: DataFrame, threshold: float = 0.8, least: int = 60) -> DataFrame:
    """(signal, grp, group_size) of signals (signal, place, family, sign): each joins the first group of its family all of whose members it correlates with.

    Returns are turned by their sign, and only positive correlations of `threshold` or more over `least`
    dates count. Pairs meet within their family, by matrix products in blocks; a family's greedy pass over its links is one task, as each step depends on
    the one before. Groups are named by their first signal; a null family is one family.
    """
    one = F.coalesce(F.col("sign").cast("double"), F.lit(1.0))
    names = signals.select("signal", "place", F.coalesce("family", F.lit("unknown")).alias("family"), one.alias("sign"))
    x = panel.where("ret is not null").join(names, "signal").select("family", "date", "signal", (F.col("ret") * F.col("sign")).alias("ret"))

    g = pair_moments(x, "signal", F.col("family"), least, threshold)
    near = g.where(F.col("scale") > 1e-18)
    links = near.join(names.select(F.col("signal").alias("a"), F.col("family").alias("_family")), "a").select("_family", "a", "b")
    kind = signals.schema["signal"].dataType.simpleString()

    def greedy(own: pd.DataFrame, linked: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(linked["a"], linked["b"], strict=True):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        groups: list[list] = []
        home: dict = {}
        for s in own.sort_values(["place", "signal"])["signal"]:
            met = Counter(home[m] for m in near.get(s, ()) if m in home)  # only groups that hold a neighbour can take it
            at = min((g for g, n in met.items() if n == len(groups[g])), default=None)
            if at is None:
                at = len(groups)
                groups.append([])
            groups[at].append(s)
            home[s] = at
        return pd.DataFrame([(s, g[0], len(g)) for g in groups for s in g], columns=["signal", "grp", "group_size"])

    return names.groupBy("family").cogroup(links.groupBy("_family")).applyInPandas(greedy, f"signal {kind}, grp {kind}, group_size long")
