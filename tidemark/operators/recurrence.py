"""Linear recurrences y = a * y_before + b as a scan in blocks, so that the rows of one key spread over many tasks.

Rows are dealt in ranges of (key, order). Each range folds its own rows into prefixes of
(a, b) pairs, which compose; the last prefix of a range is a row of a small table, whose
fold gives what each range starts from; a row's value is then its prefix applied to that.
Within a range the fold is done by doubling over arrays, not row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType
from pyspark.sql.window import Window

from tidemark.common import written
from tidemark.operators import sequential


def prefixes(a: np.ndarray, b: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A, B) of each row: the composition of all pairs of its segment up to it. Equal segments stand together."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a):
        same = np.flatnonzero(segment[step:] == segment[:-step])
        if not len(same):
            break
        to = same + step
        new_a, new_b = a[to] * a[same], a[to] * b[same] + b[to]
        a[to], b[to] = new_a, new_b
        step *= 2
    return a, b


class _Fold:
    """Prefixes of runs of equal keys over the batches of a task. A row without effect has NaN for a."""

    def __init__(self):
        self.key, self.began, self.rows = None, False, 0

    def __call__(self, keys: pa.Array, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        """A, B: from a value that comes in; C: without one; A0, B0, C0: the same for the row before; k: place in the run."""
        n = len(a)
        code = keys.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        segment = np.cumsum(np.r_[0, code[1:] != code[:-1]])
        first = np.r_[0, np.flatnonzero(np.diff(segment)) + 1]
        goes_on = self.began and keys[0].as_py() == self.key
        none = np.isnan(a)
        a, b = np.where(none, 1.0, a), np.where(none, 0.0, b)
        effect = np.where(none, n, np.arange(n))
        begin = np.minimum.reduceat(effect, first)  # the first row of each run with an effect
        if goes_on and not np.isnan(self.C):
            begin = begin[1:]
        begin = begin[begin < n]
        ca, cb = a.copy(), b.copy()
        ca[begin], cb[begin] = 0.0, start[begin]
        A, B = prefixes(a, b, segment)
        CA, C = prefixes(ca, cb, segment)
        seen = np.maximum.accumulate(np.where(np.isin(np.arange(n), begin), np.arange(n), -1))
        live = seen >= first[segment]
        k = np.arange(n) - first[segment]
        if goes_on:
            head = segment == 0
            k[head] += self.rows
            if not np.isnan(self.C):
                C[head] += CA[head] * self.C
                live |= head
            B[head] += A[head] * self.B
            A[head] *= self.A
        C = np.where(live, C, np.nan)
        out = {"A": A, "B": B, "C": C}
        held = {"A": self.A, "B": self.B, "C": self.C} if goes_on else {}
        for name, fresh in (("A", 1.0), ("B", 0.0), ("C", np.nan)):
            shifted = np.r_[fresh, out[name][:-1]]
            shifted[first] = fresh
            if goes_on:
                shifted[0] = held[name]
            out[f"{name}0"] = shifted
        self.key, self.began, self.rows = keys[n - 1].as_py(), True, int(k[-1]) + 1
        self.A, self.B, self.C = A[-1], B[-1], C[-1]
        return out | {"k": k}


def linear_scan(df: DataFrame, key: str, order: list[str], name: str, a: Column, b: Column, start: Column) -> DataFrame:
    """`df` with `name`, the recurrence's value on each row, and `name`_before, that on the key's row before.

    The first row on which a and b are known gets `start`, a later one a * before + b; others
    repeat the value before, null before the first. Null keys are one key; an empty table gives none.
    """
    fields = df.columns
    rows = df.withColumns({"_a": F.when(b.isNotNull(), a.cast("double")), "_b": b.cast("double"), "_s": start.cast("double")})
    rows = rows.repartitionByRange(*[F.col(c) for c in (key, *order)]).sortWithinPartitions(key, *order)
    at = fields.index(key)
    names = ["A", "B", "C", "A0", "B0", "C0"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _Fold()
        for batch in batches:
            if not batch.num_rows:
                continue
            found = fold(batch.column(at), *(batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_a", "_b", "_s")))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], *(pa.array(found[c], from_pandas=True) for c in names), pa.array(found["k"])], names=[*fields, *(f"_{c}" for c in names), "_k"])

    kind = StructType([*df.schema.fields])
    for c in names:
        kind = kind.add(f"_{c}", DoubleType())
    dealt = written(rows.mapInArrow(run, kind.add("_k", LongType())).withColumn("_part", F.spark_partition_id()), "scan")
    dealt = dealt.withColumn("_key", F.struct(F.col(key)))  # a struct is never null, so a null key meets itself
    # only a key that goes on from one range into the next is left here: at most two rows for each range
    ends = dealt.groupBy("_key", "_part").agg(F.max_by(F.struct("_A", "_B", "_C"), "_k").alias("e"))
    ends = ends.withColumn("_n", F.count("*").over(Window.partitionBy("_key"))).where("_n > 1")
    starts = _carried(ends).select("_key", "_part", "_y")
    found = dealt.join(F.broadcast(starts), ["_key", "_part"], "left")
    value = lambda i: F.when(F.col("_y").isNotNull(), F.col(f"_A{i}") * F.col("_y") + F.col(f"_B{i}")).otherwise(F.col(f"_C{i}"))
    return found.select(*fields, value("").alias(name), value("0").alias(f"{name}_before"))


def _carried(ends: DataFrame) -> DataFrame:
    """(_key, _part, _y): the value with which a key comes into a range, from the prefixes of the ranges before; null where there is none."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("_part", "e"))), lambda x: F.struct(x["_part"].alias("_part"), x["e"].alias("e")))
    zero = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<struct<_part:int,_y:double>>").alias("out"))

    def step(held: Column, x: Column) -> Column:
        e = x["e"]
        y = F.when(held["y"].isNotNull(), e["_A"] * held["y"] + e["_B"]).otherwise(e["_C"])
        return F.struct(y.alias("y"), F.concat(held["out"], F.array(F.struct(x["_part"].alias("_part"), held["y"].alias("_y")))).alias("out"))

    folded = ends.groupBy("_key").agg(rows.alias("rows")).select("_key", F.aggregate("rows", zero, step)["out"].alias("out"))  # an entry for each range
    return folded.select("_key", F.explode("out").alias("x")).select("_key", "x.*")


def with_history(df: DataFrame, key: str, order: list[str], n: int, fn: Callable[[pd.DataFrame], dict[str, np.ndarray]], outputs: str) -> DataFrame:
    """`df` with the columns `outputs` (DDL), which `fn` makes from consecutive rows of a key.

    What fn gets begins with the n rows before those that are kept, fewer only at the key's
    start, whatever range they are in, so a key's rows spread over tasks.
    """
    fields = df.columns
    at = fields.index(key)
    rows = df.repartitionByRange(*[F.col(c) for c in (key, *order)]).sortWithinPartitions(key, *order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _Fold()
        for batch in batches:
            if batch.num_rows:
                zero = np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fold(batch.column(at), zero, zero, zero)["k"])], names=[*fields, "_k"])

    dealt = written(rows.mapInArrow(count, StructType([*df.schema.fields]).add("_k", LongType())).withColumn("_part", F.spark_partition_id()), "history")
    dealt = dealt.withColumn("_key", F.struct(F.col(key)))
    ends = dealt.groupBy("_key", "_part").agg(F.count("*").alias("_c")).withColumn("_n", F.count("*").over(Window.partitionBy("_key"))).where("_n > 1").drop("_n")
    tails = dealt.join(F.broadcast(ends), ["_key", "_part"]).where(F.col("_k") >= F.col("_c") - n)  # at most two keys a range
    # for each range the last n rows before it: a row goes on to later ranges until n rows stand between
    past = Window.partitionBy("_key").orderBy("_part", "_k")
    tails = tails.withColumn("_i", F.row_number().over(past))
    begins = tails.groupBy("_key", "_part").agg(F.min("_i").alias("_from")).withColumnRenamed("_part", "_to")
    handed = tails.join(begins, "_key").where((F.col("_i") < F.col("_from")) & (F.col("_i") >= F.col("_from") - n))
    handed = handed.select(*fields, (F.col("_i") - F.col("_from")).cast("long").alias("_k"), F.col("_to").alias("_part"))
    both = dealt.select(*fields, "_k", "_part").unionByName(handed).repartition("_part").sortWithinPartitions("_part", key, "_k")
    made = [c.strip().split()[0] for c in outputs.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            whole = frame if held is None else pd.concat([held, frame], ignore_index=True)
            new = 0 if held is None else len(held)
            code = pd.factorize(whole[key], use_na_sentinel=False)[0]
            edge = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (whole["_part"].to_numpy()[1:] != whole["_part"].to_numpy()[:-1]), True])
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if e <= new:
                    continue
                run_ = whole.iloc[s:e].reset_index(drop=True)
                out = pd.concat([run_, pd.DataFrame(fn(run_), columns=made)], axis=1)
                keep = (run_["_k"].to_numpy() >= 0) & (np.arange(s, e) >= new)
                yield out[keep].drop(columns=["_k", "_part"])
            last = whole.iloc[edge[-2] :] if len(whole) else whole
            held = last.tail(n)
            held = held if len(held) else None

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return both.mapInPandas(run, f"{kind}, {outputs}")


def ema(df: DataFrame, key: str, order: list[str], name: str, x: Column, span: int) -> DataFrame:
    """Exponential average that starts at the first value; nulls repeat it."""
    alpha = 2 / (span + 1)
    return linear_scan(df, key, order, name, F.lit(1 - alpha), alpha * x, x).drop(f"{name}_before")


def macd(df: DataFrame, fast: int, slow: int, signal: int, col: str = "close", key: str = "symbol", ts: str = "date") -> DataFrame:
    """Exponential averages that start at the first value, their difference and its own average; nulls repeat the last state."""
    x = ema(ema(df, key, [ts], "fast", F.col(col), fast), key, [ts], "slow", F.col(col), slow)
    x = x.withColumn("macd", F.col("fast") - F.col("slow"))
    return ema(x, key, [ts], "signal", F.when(F.col(col).isNotNull(), F.col("macd")), signal).select(*df.columns, "fast", "slow", "signal", "macd")


def wilder_rsi(df: DataFrame, n: int, col: str = "close", key: str = "symbol", ts: str = "date") -> DataFrame:
    """`df` with `rsi`: rises and falls averaged over the first n changes, then smoothed by 1 / n; null before row n (from 0), 100 without falls. Rows without a price are left out.

    One sorted pass over a key carries the last price and the two averages, with the memory of one batch.
    """

    def step(state, rows):
        seen, last, up, down = state
        out = np.full(len(rows), np.nan)
        for i, x in enumerate(rows[col].to_numpy(float).tolist()):
            if seen:
                rise, fall = max(x - last, 0.0), max(last - x, 0.0)
                if seen <= n:
                    up, down = up + rise, down + fall
                    if seen == n:
                        up, down = up / n, down / n
                else:
                    up, down = (up * (n - 1) + rise) / n, (down * (n - 1) + fall) / n
                if seen >= n:
                    out[i] = 100.0 if down == 0 else 100 - 100 / (1 + up / down)
            seen, last = seen + 1, x
        return (seen, last, up, down), {"rsi": out}

    return sequential.scan(df.where(F.col(col).isNotNull()), key, [ts], [col], "rsi double", lambda: (0, 0.0, 0.0, 0.0), step)


def ewm_deviation(df: DataFrame, span: int, col: str = "ret", key: str = "symbol", ts: str = "date", least: int = 2) -> DataFrame:
    """`df` with `ewm_std`: the deviation with weights that fall by 1 - 2 / (span + 1) for each value, corrected for their number; null under `least` values. A null value repeats the last."""
    keep = 1 - 2 / (span + 1)
    x, one = F.col(col).cast("double"), F.when(F.col(col).isNotNull(), 1.0)
    y = linear_scan(df, key, [ts], "ew_n", F.lit(1.0), one, one)
    y = linear_scan(y.drop("ew_n_before"), key, [ts], "ew_s", F.lit(keep), x, x)
    y = linear_scan(y.drop("ew_s_before"), key, [ts], "ew_q", F.lit(keep), x * x, x * x)
    w, w2 = (1 - F.pow(F.lit(keep), "ew_n")) / (1 - keep), (1 - F.pow(F.lit(keep), 2 * F.col("ew_n"))) / (1 - keep**2)
    mean = F.col("ew_s") / w
    var = F.greatest(F.col("ew_q") / w - mean * mean, F.lit(0.0)) * w * w / F.nullif(w * w - w2, F.lit(0.0))
    return y.withColumn("ewm_std", F.when(F.col("ew_n") >= max(2, least), F.sqrt(var))).select(*df.columns, "ewm_std")


_EPSILON = 1e-12


def _alpha(kind: str, w: int) -> Callable[[np.ndarray], np.ndarray]:
    """The weight of the newest price from each window of w + 1 prices."""

    def kama(x):
        moved = np.abs(np.diff(x, axis=1)).sum(1)
        return (np.abs(x[:, -1] - x[:, 0]) / np.maximum(moved, _EPSILON) * (2 / 3 - 2 / 31) + 2 / 31) ** 2

    def vidya(x):
        d = np.diff(x, axis=1)
        up, down = np.clip(d, 0, None).sum(1), np.clip(-d, 0, None).sum(1)
        return 2 / (w + 1) * np.abs(up - down) / np.maximum(up + down, _EPSILON)

    def frama(x):
        h = w // 2
        span = lambda y: y.max(1) - y.min(1)
        n1, n2, n3 = span(x[:, -2 * h : -h]) / h, span(x[:, -h:]) / h, span(x[:, -2 * h :]) / (2 * h)
        flat = np.minimum(n1 + n2, n3) <= _EPSILON
        with np.errstate(divide="ignore", invalid="ignore"):
            dimension = np.where(flat, 1.0, (np.log(n1 + n2) - np.log(n3)) / np.log(2))
        return np.clip(np.exp(-4.6 * (dimension - 1)), 0.01, 1.0)

    return {"kama": kama, "vidya": vidya, "frama": frama}[kind]


def adaptive_average(df: DataFrame, kind: str, w: int, col: str = "close", key: str = "symbol", ts: str = "date") -> DataFrame:
    """`df` with `average`: an average whose weight follows the last w changes: kama (efficiency), vidya (balance of rises and falls) or frama (fractal dimension).

    It starts at the price of row w (from 0) of a key and is null before. Rows without a price are left out.
    """
    weigh = _alpha(kind, w)

    def weights(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        x, out = rows[col].to_numpy(float), np.full(len(rows), np.nan)
        if len(x) > w:
            out[w] = 1.0  # right for the key's row w; of later rows the history holds one row more
            out[w + 1 :] = weigh(np.lib.stride_tricks.sliding_window_view(x, w + 1)[1:])
        return {"alpha": out}

    if w < 2:
        raise ValueError("a window has two rows or more")
    found = with_history(df.where(F.col(col).isNotNull()), key, [ts], w + 1, weights, "alpha double")
    found = found.withColumn("alpha", F.when(~F.isnan("alpha"), F.col("alpha")))
    return linear_scan(found, key, [ts], "average", 1 - F.col("alpha"), F.col("alpha") * F.col(col), F.col(col)).drop("alpha", "average_before")


def average_cost(fills: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Fills (symbol, seq, side 1 or -1, qty, price) with the position, its average cost and the gain realised so far; `order` sorts a symbol's fills.

    A fill against the position realises the difference to the average cost; what goes beyond it opens a position at the fill's price.
    Sums fall on ties of short decimals, so they are taken fill by fill in the plain order: one sorted pass over a symbol, with the memory of
    one batch, in place of scans whose prefixes round otherwise. A fill without side or quantity repeats what was before.
    """

    def step(state, rows):
        position, cost, realised = state
        out = np.empty((3, len(rows)))
        signed = rows["side"].to_numpy(float, na_value=np.nan) * rows["qty"].to_numpy(float, na_value=np.nan)
        for i, (q, p) in enumerate(zip(signed.tolist(), rows["price"].to_numpy(float, na_value=np.nan).tolist(), strict=True)):
            if q == q:
                was = 0.0 if position != position else position
                position, known = was + q, p == p
                if was * q < 0:
                    if known:
                        gain = min(abs(q), abs(was)) * (p - (cost if cost == cost else 0.0))
                        realised = (realised if realised == realised else 0.0) + (gain if was > 0 else -gain)
                    if abs(q) > abs(was) and known:
                        cost = p
                else:
                    realised = realised if realised == realised else 0.0
                    if known and position != 0:
                        cost = p if cost != cost else (cost * abs(was) + p * abs(q)) / (abs(was) + abs(q))
                if position == 0:
                    cost = 0.0
            out[:, i] = position, cost, realised
        return (position, cost, realised), {"position": out[0], "cost": out[1], "realised": out[2]}

    nan = float("nan")
    return sequential.scan(fills, "symbol", order or ["seq"], ["side", "qty", "price"], "position double, cost double, realised double", lambda: (nan, nan, nan), step)
