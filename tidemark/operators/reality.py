"""Reality check and test of superior predictive ability over a panel of differentials (candidate, date, x)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.common import written

_PRIME, _SPREAD, _TWIST, _TOP = 2147483647, 48271, 69621, 16807


def drawn(path: np.ndarray, place: np.ndarray, seed: int, which: int) -> np.ndarray:
    """A number in (0, 1) for each path and place, by whole-number arithmetic that SQL can repeat."""
    h = (path * 1000003 + place * 7919 + seed * 104729 + which * 15485863) % _PRIME
    h = h * _SPREAD % _PRIME
    h = (h ^ (h >> 13)) * _TWIST % _PRIME
    h = (h ^ (h >> 11)) * _TOP % _PRIME
    return (h + 0.5) / _PRIME


def stationary_weights(n: int, samples: int, length: int, seed: int) -> np.ndarray:
    """samples x n: how often each of n rows is in each path of a circular stationary bootstrap with blocks of mean length `length`."""
    out = np.empty((samples, n), np.float32)
    place = np.arange(n, dtype=np.int64)
    for p in range(samples):
        path = np.full(n, p, np.int64)
        fresh = (drawn(path, place, seed, 1) * length < 1) | (place == 0)
        begin = np.maximum.accumulate(np.where(fresh, place, 0))
        at = (np.floor(drawn(path, begin, seed, 2) * n).astype(np.int64) + place - begin) % n
        out[p] = np.bincount(at, minlength=n)
    return out


def complete(panel: DataFrame) -> DataFrame:
    """(candidate, t, x): rows of the dates on which every candidate with a value has one, dates numbered from 0."""
    x = panel.where("x is not null and not isnan(x)").select("candidate", "date", F.col("x").cast("double").alias("x"))
    every = x.agg(F.count_distinct("candidate")).first()[0]
    dates = x.groupBy("date").agg(F.count_distinct("candidate").alias("c")).where(F.col("c") == every)
    numbered = dates.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("t"))  # a row for each date
    return x.join(numbered, "date").select("candidate", "t", "x")


def _paths(x: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(means, t-values) of centred series (rows of x) on every path: two products, no copy of a row."""
    n = x.shape[1]
    x = x - x.mean(1, keepdims=True)
    s1, s2 = x @ weights.T.astype(float), (x * x) @ weights.T.astype(float)
    mean = s1 / n
    var = np.maximum(s2 - n * mean * mean, 0) / (n - 1)
    return mean, np.divide(mean, np.sqrt(var / n), out=np.zeros_like(mean), where=var > 1e-24)


def _observed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, var = x.mean(1), x.var(1, ddof=1)
    return mean, np.divide(mean, np.sqrt(var / x.shape[1]), out=np.zeros_like(mean), where=var > 1e-24)


def reality_check(panel: DataFrame, seed: int = 7, samples: int = 1000, lengths: tuple[int, ...] = (5, 10, 20, 60), least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(by block length: length, white_p, spa_p), (by candidate: mean, t, spa_p, raw_p, q, low, high, deviation).

    All candidates are drawn by the same paths. Each task takes the greatest mean and t-value of its
    candidates on every path, the shuffle those of all tasks; what comes to the driver is one number for each path
    and length. The candidate table is for the automatic length, the cube root of the dates, the first of the lengths. Its raw
    p-values are adjusted by Benjamini and Hochberg over their distinct values, of which there are at most samples + 1.
    Dates that lack a candidate's value are left out; under `least` dates all p-values are null.
    """
    spark = panel.sparkSession
    x = written(complete(panel), "differentials")
    n = x.agg(F.count_distinct("t")).first()[0]
    kind = panel.schema["candidate"].dataType.simpleString()
    if n < least:
        none = lambda c: F.lit(None).cast("double").alias(c)
        rows = spark.range(0).select(F.col("id").cast("int").alias("length"), none("white_p"), none("spa_p"))
        return rows, x.select("candidate").distinct().select("candidate", *map(none, ("mean", "t", "spa_p", "raw_p", "q", "low", "high", "deviation")))
    automatic = max(2, round(n ** (1 / 3)))
    every = tuple(dict.fromkeys((automatic, *lengths)))
    series = x.groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("r")).select("candidate", F.col("r.x").alias("x"))
    series = written(series, "series")

    def greatest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, np.ndarray] = {}
        weights = {}
        for f in frames:
            if not len(f):
                continue
            rows = np.vstack(f["x"].to_list())
            mean, t = _observed(rows)
            for b in every:
                if b not in weights:
                    weights[b] = stationary_weights(n, samples, b, seed + b)
                means, ts = _paths(rows, weights[b])
                found = np.vstack([np.r_[means.max(0), mean.max()], np.r_[ts.max(0), t.max()]])
                best[b] = np.maximum(best[b], found) if b in best else found
        for b, found in best.items():
            yield pd.DataFrame({"length": b, "path": np.arange(samples + 1), "mean": found[0], "t": found[1]})

    top = series.mapInPandas(greatest, "length int, path int, mean double, t double").groupBy("length", "path").agg(F.max("mean").alias("mean"), F.max("t").alias("t"))
    top = written(top, "greatest")  # path number `samples` holds what was observed
    seen = top.where(F.col("path") == samples).select("length", F.col("mean").alias("_m"), F.col("t").alias("_t"))
    share = lambda c: (1 + F.count_if(c)) / (samples + 1)
    overall = top.where(F.col("path") < samples).join(F.broadcast(seen), "length").groupBy("length").agg(share(F.col("mean") >= F.col("_m")).alias("white_p"), share(F.col("t") >= F.col("_t")).alias("spa_p"))
    maxima = np.sort([r["t"] for r in top.where((F.col("path") < samples) & (F.col("length") == automatic)).select("t").collect()])  # one for each path

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = None
        for f in frames:
            if not len(f):
                continue
            weights = stationary_weights(n, samples, automatic, seed + automatic) if weights is None else weights
            rows = np.vstack(f["x"].to_list())
            mean, t = _observed(rows)
            means, ts = _paths(rows, weights)
            own = means + mean[:, None]
            low, high = np.quantile(own, [0.025, 0.975], axis=1)
            over = samples - np.searchsorted(maxima, t, "left")
            yield pd.DataFrame({"candidate": f["candidate"], "mean": mean, "t": t, "spa_p": (1 + over) / (samples + 1), "raw": 1 + (ts >= t[:, None]).sum(1), "low": low, "high": high, "deviation": own.std(1, ddof=1)})

    found = written(series.mapInPandas(each, f"candidate {kind}, mean double, t double, spa_p double, raw long, low double, high double, deviation double"), "candidates")
    counts = found.groupBy("raw").agg(F.count("*").alias("c"))  # at most samples + 1 rows
    upto = counts.withColumn("_k", F.sum("c").over(Window.orderBy("raw"))).withColumn("_m", F.sum("c").over(Window.partitionBy()))
    p = F.col("raw") / (samples + 1)
    after = Window.orderBy("raw").rowsBetween(0, Window.unboundedFollowing)
    q = upto.select("raw", F.least(F.lit(1.0), F.min(p * F.col("_m") / F.col("_k")).over(after)).alias("q"))
    return overall, found.join(F.broadcast(q), "raw").select("candidate", "mean", "t", "spa_p", p.alias("raw_p"), "q", "low", "high", "deviation")
