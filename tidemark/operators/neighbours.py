"""Exact nearest rows: by cosine, by distance among a key's past, and by shared neighbours in a bipartite graph."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.common import dealt, written

#: Rows of a block of queries or candidates.
BLOCK = 1000


def _packed(df: DataFrame, block: int) -> DataFrame:
    """A row for each block of at most `block` rows of a task: its columns as arrays, without a shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), block):
                yield pd.DataFrame({c: [f[c].iloc[at : at + block].to_numpy()] for c in f.columns})

    return df.mapInPandas(run, ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in df.schema.fields))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query, id, cosine): the k nearest other rows (id, v) of each query (id, v) by exact cosine, ties by id.

    Queries are packed in blocks, vectors stay where they are: each task keeps the best k of each query
    over its vectors, sorted by (cosine to nine places, id), so that ties fall alike wherever rows lie.
    Blocks of queries are broadcast where they are few, else each meets each part of the vectors in turn
    through a join, so nothing passes the driver. Null vectors are left out; vectors of zeros are at cosine 0.
    Empty queries or vectors give an empty result; a repeated id counts as often as it stands.
    """
    spark = vectors.sparkSession
    q = queries.where("v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    q = written(_packed(q, block), "queries")
    if not q.limit(1).count():
        return spark.createDataFrame([], "query long, id long, cosine double")
    x = vectors.where("v is not null").select(F.col("id").cast("long").alias("i"), F.col("v").cast("array<double>").alias("x"))
    x = written(_packed(x, block), "vectors")
    # each block of vectors meets each block of queries: blocks squared, not rows; the smaller side of blocks is copied
    meets = x.select("i", "x").join(F.broadcast(q) if q.count() <= 50 else q, F.lit(True)).select("i", "x", "id", "v")

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for ids, rows, names, own in zip(f["i"], f["x"], f["id"], f["v"], strict=True):
                ids, names = np.asarray(ids), np.asarray(names)
                s = _unit(np.vstack(own)) @ _unit(np.vstack(rows)).T
                s[names[:, None] == ids[None, :]] = -np.inf
                shown = np.round(s, 9)
                top = np.array([np.lexsort((ids, -row))[:k] for row in shown])
                cosine = np.take_along_axis(s, top, 1).ravel()
                yield pd.DataFrame({"query": np.repeat(names, top.shape[1]), "id": ids[top].ravel(), "cosine": cosine})[np.isfinite(cosine)]

    found = meets.mapInPandas(best, "query long, id long, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "id")  # k rows of each block of vectors
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("query", "id", "cosine")


def analogues(states: DataFrame, features: list[str], k: int, embargo: int, key: str = "key", ts: str = "t", block: int = 500) -> DataFrame:
    """(key, t, n, mean, median, up, deviation) of the outcomes that followed the k states of the key's past nearest to that of t.

    states: (key, t, features, outcome), t a row number. A state's past ends `embargo` rows before it, which must reach over
    the rows that outcomes look ahead. Past states without an outcome or with a missing feature do not count; a
    state with a missing feature, or with fewer than k in its past, has no row. Ties go to the earlier t.

    A key's states are cut into blocks of `block` rows, and a block and the copies of those before it come to one task in turn, newest
    first, which keeps the k best of each state. So a long key spreads over tasks, a task holds two blocks, and no candidate is shuffled.
    """
    whole = states
    for c in features:
        whole = whole.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    vec = F.array(*[F.col(c).cast("double") for c in features])
    own = Window.partitionBy(key)
    at = lambda n: F.floor((n - 1) / block)
    rows = whole.select(F.struct(key).alias("key"), F.col(ts).cast("long").alias("t"), vec.alias("v"), F.col("outcome").cast("double").alias("y"), at(F.row_number().over(own.orderBy(ts))).alias("b"), at(F.count("*").over(own)).alias("last"))
    packed = rows.groupBy("key", "b").agg(F.collect_list("t").alias("t"), F.flatten(F.collect_list("v")).alias("v"), F.collect_list(F.coalesce("y", F.lit(math.nan))).alias("y"), F.first("last").alias("last"))
    copies = packed.withColumn("to", F.explode(F.sequence("b", "last"))).drop("last").repartition("key", "to").sortWithinPartitions("key", "to", F.desc("b"))

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, t, v, kept = None, None, None, None
        for f in frames:
            out = []
            for name, b, to, *found in zip(f["key"], f["b"], f["to"], f["t"], f["v"], f["y"], strict=True):
                pt, pv, py = np.asarray(found[0]), np.asarray(found[1]).reshape(-1, len(features)), np.asarray(found[2], float)
                if b == to:  # its own block comes first
                    out += _outcomes(group, t, kept, k)
                    group, t, v, kept = name, pt, pv, None
                past = ~np.isnan(py)
                kept = _closest(t, v, pt[past], pv[past], py[past], k, embargo, kept)
            yield pd.DataFrame(out, columns=["key", "t", "mean", "median", "up", "deviation"])
        yield pd.DataFrame(_outcomes(group, t, kept, k), columns=["key", "t", "mean", "median", "up", "deviation"])

    measures = ["mean", "median", "up", "deviation"]
    found = copies.mapInPandas(best, f"key {rows.schema['key'].dataType.simpleString()}, t array<long>, " + ", ".join(f"{m} array<double>" for m in measures))
    one = found.select(F.col(f"key.{key}").alias("_key"), F.inline(F.arrays_zip("t", *measures)))
    return one.select(F.col("_key").alias(key), "t", F.lit(k).cast("long").alias("n"), *measures)


def _closest(t, v, pt, pv, py, k: int, embargo: int, kept):
    """(distance, t, outcome) of the k nearest of each state, in order of distance and t, among those `kept` and the past given."""
    d = np.zeros((len(t), len(pt)))
    for c in range(v.shape[1]):
        d += (v[:, c, None] - pv[None, :, c]) ** 2
    d[pt[None, :] > t[:, None] - embargo] = np.inf
    if d.shape[1] > k:
        top = np.argpartition(d, k - 1, axis=1)[:, :k]
        far = np.take_along_axis(d, top, 1).max(axis=1)
        for i in np.flatnonzero(np.isfinite(far) & ((d <= far[:, None]).sum(axis=1) > k)):  # ties at the k-th
            top[i] = np.lexsort((pt, d[i]))[:k]
    else:
        top = np.broadcast_to(np.arange(d.shape[1]), d.shape)
    new = np.take_along_axis(d, top, 1), pt[top], py[top]
    if kept is not None:
        new = tuple(np.concatenate(pair, axis=1) for pair in zip(kept, new, strict=True))
    order = np.lexsort((new[1], new[0]), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in new)


def _outcomes(group, t, kept, k: int) -> list:
    """One row for a block: its states with k in their past, and the mean, median, share above 0 and deviation of the outcomes."""
    if kept is None or kept[0].shape[1] < k:
        return []
    full = np.isfinite(kept[0][:, k - 1])
    y = kept[2][full]
    return [(group, t[full], y.mean(axis=1), np.median(y, axis=1), (y > 0).mean(axis=1), y.std(axis=1))] if len(y) else []


def similar(edges: DataFrame, queries: DataFrame, k: int, salts: int = 16, hub: int = 10_000) -> DataFrame:
    """(query, node, distance, shared): the k nodes nearest to each query node over one factor: the least sum of the two weights, then most factors, then least node.

    edges: (node, factor, weight); of repeated edges the lightest counts. queries: (node). Only a query's own edges meet those of
    a factor. A factor of more than `hub` edges is a hub: its edges are dealt over `salts` keys and the
    queries' edges to it repeated for each, so its rows spread; pairs are combined in two stages, first by
    (pair, salt) within tasks, then by pair. Nodes that share no factor are not similar; null ends and weights are left out.
    Edges are dealt over partitions that grow with them, and pairs over ones that grow with the pairs, which the factors' counts tell.
    """
    held = edges.where("node is not null and factor is not null and weight is not null").select("node", "factor", F.col("weight").cast("double").alias("w"))
    rows = edges.count()
    e = dealt(held, rows, "node", "factor").groupBy("node", "factor").agg(F.min("w").alias("w"))
    asked = written(queries.select("node").distinct().withColumn("_own", F.lit(1)), "queries")
    e = written(e.join(asked, "node", "left"), "edges")
    counts = written(e.groupBy("factor").agg(F.count("*").alias("_n"), F.count("_own").alias("_q")), "factors")
    many = counts.agg(F.coalesce(F.sum(F.col("_n") * F.col("_q")), F.lit(0))).first()[0]  # one number: pairs, a node with itself included
    hubs = counts.where(F.col("_n") > hub).select("factor", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("cell"), F.lit(salts).alias("_s"))

    def salted(x: DataFrame) -> DataFrame:
        x = x.withColumn("cell", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
        return dealt(x, rows, "factor", "cell").join(dealt(hubs, rows, "factor", "cell"), ["factor", "cell"], "left")

    every = salted(e.select("node", "factor", "w")).select("factor", F.when(F.col("_s").isNotNull(), F.col("cell")).otherwise(0).alias("salt"), "node", "w")
    own = salted(e.where("_own is not null").drop("_own")).select("factor", F.explode(F.sequence(F.lit(0), F.coalesce("_s", F.lit(1)) - 1)).alias("salt"), F.col("node").alias("query"), F.col("w").alias("w_q"))
    most = max(rows, many)
    pairs = dealt(own, most, "factor", "salt").join(dealt(every, most, "factor", "salt"), ["factor", "salt"]).where("node != query")
    met = dealt(pairs, many, "query", "node").groupBy("query", "node").agg(F.min(F.col("w_q") + F.col("w")).alias("distance"), F.count("*").alias("shared"))
    w = Window.partitionBy("query").orderBy("distance", F.desc("shared"), "node")
    return met.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
