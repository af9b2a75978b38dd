"""Recurrences: what a row gets depends on what the row before it got, so a key's rows pass one task in order.

Keys are sorted inside their partition and the state alone is carried from batch to batch, so a
key of any length takes the memory of one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan(df: DataFrame, key: str, order: list[str], inputs: list[str], outputs: str, start: Callable[[], object], step: Callable[[object, pd.DataFrame], tuple[object, dict]]) -> DataFrame:
    """`df` with the columns `outputs` (DDL): `step(state, rows)` gets a key's next rows in order and gives the new state and columns.

    Null keys are one key. An empty table gives an empty result.
    """
    sorted_ = df.repartition(F.col(key)).sortWithinPartitions(key, *order)
    names = [c.strip().split()[0] for c in outputs.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, began = None, None, False
        for t in batches:
            if not len(t):
                continue
            k = t[key].astype(object).where(t[key].notna(), None).to_numpy()
            edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
            parts = []
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if not began or k[s] != last:
                    last, state, began = k[s], start(), True
                state, found = step(state, t.iloc[s:e][inputs])
                parts.append(pd.DataFrame(found, columns=names))
            yield pd.concat([t.reset_index(drop=True), pd.concat(parts, ignore_index=True)], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return sorted_.mapInPandas(run, f"{fields}, {outputs}")


def threshold_bars(ticks: DataFrame, threshold: float, measure: str) -> DataFrame:
    """Ticks with the number of their bar: a bar ends on the tick at which `measure`, summed since the last end, reaches the threshold, and the sum restarts at 0."""

    def step(state, rows):
        total, bar = state
        out = np.empty(len(rows), np.int64)
        for i, x in enumerate(rows[measure].to_numpy(float)):
            out[i] = bar
            total += x if x == x else 0.0
            if total >= threshold:
                total, bar = 0.0, bar + 1
        return (total, bar), {"bar": out}

    return scan(ticks, "symbol", ["ts", "seq"], [measure], "bar long", lambda: (0.0, 0), step)
