"""Choices among many rows: rows that no other dominates, and the best rows that are unlike each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.common import written

#: Cells along each objective, and rows that a task compares at once.
CELLS, CHUNK = 8, 2048


def undominated(x: np.ndarray) -> np.ndarray:
    """Which rows of x no other row reaches in every column and passes in one; equal rows stay together."""
    order = np.lexsort([*(-x.T[::-1]), -x.sum(1)])  # what dominates a row has a greater sum, or an equal one by rounding and then greater columns
    keep = np.ones(len(x), bool)
    held = np.empty((0, x.shape[1]))
    for i in range(0, len(order), 256):
        own = order[i : i + 256]
        over = lambda a, b: (a[None] >= b[:, None]).all(2) & (a[None] > b[:, None]).any(2)
        bad = over(held, x[own]).any(1) | over(x[own], x[own]).any(1)
        keep[own[bad]] = False
        held = np.vstack([held, x[own[~bad]]])
    return keep


def _local(df: DataFrame, objectives: list[str]) -> DataFrame:
    """Each task's rows without those that rows of the same chunk dominate."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            f = f[undominated(f[objectives].to_numpy(float))] if len(f) else f
            if len(f) > CHUNK:
                yield f
                f = None
            held = f
        if held is not None and len(held):
            yield held

    return df.mapInPandas(run, df.schema)


def pruned(df: DataFrame, objectives: list[str]) -> DataFrame:
    """What is left of rows after their own task's comparison and a coarse grid, with `_cell`: few rows, and all of the frontier.

    A cell whose every coordinate is below those of a cell with a row holds dominated rows only.
    Rows with a null or NaN objective are left out.
    """
    ok = df
    for c in objectives:
        ok = ok.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    kept = written(_local(ok, objectives), "undominated")
    ends = kept.agg(*[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in objectives], *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in objectives]).first()
    place = []
    for c in objectives:
        lo, hi = ends[f"lo_{c}"], ends[f"hi_{c}"]
        place.append(F.lit(0) if lo is None or hi <= lo else F.least(F.lit(CELLS - 1), F.floor((F.col(c) - lo) / (hi - lo) * CELLS)).cast("int"))
    x = kept.withColumn("_cell", F.array(*place))
    cells = [tuple(r["_cell"]) for r in x.select("_cell").distinct().collect()]  # at most CELLS ** objectives
    below = [c for c in cells if any(all(d > e for d, e in zip(o, c, strict=True)) for o in cells)]
    return x.where(~F.col("_cell").isin([F.array(*map(F.lit, c)) for c in below])) if below else x


def frontier(df: DataFrame, objectives: list[str]) -> DataFrame:
    """The rows that no row dominates: reaches in every objective and passes in one. Equal rows all stay.

    What the grid leaves meets only rows of cells that reach its own in every coordinate.
    """
    x = written(pruned(df, objectives), "pruned")
    names = df.columns
    # all cells that could hold what dominates a row of a cell: those not below it in any coordinate
    up = {}
    cells = [tuple(r["_cell"]) for r in x.select("_cell").distinct().collect()]  # at most CELLS ** objectives
    for c in cells:
        up[c] = [o for o in cells if all(a >= b for a, b in zip(o, c, strict=True))]
    table = [(list(c), list(o)) for c in cells for o in up[c]]
    if not table:
        return x.select(*names)
    steps = df.sparkSession.createDataFrame(table, "_cell array<int>, _up array<int>")
    probe = x.withColumn("_row", F.monotonically_increasing_id())
    probe = written(probe, "probe")
    other = probe.select(F.col("_cell").alias("_up"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(objectives)])
    reach, passes = F.lit(True), F.lit(False)
    for i, c in enumerate(objectives):
        reach, passes = reach & (F.col(f"_o{i}") >= F.col(c)), passes | (F.col(f"_o{i}") > F.col(c))
    bad = probe.join(F.broadcast(steps), "_cell").join(other, "_up").where(reach & passes).select("_row").distinct()
    return probe.join(bad, "_row", "left_anti").select(*names)


def diverse(candidates: DataFrame, panel: DataFrame, size: int, most: float, block: int = 64) -> DataFrame:
    """(candidate, score, place) of the greedy choice: by falling score, each whose correlation with all chosen before is below `most`, up to `size`.

    Blocks of the best candidates left are compared in one task with each other and with those
    chosen, so the choice is the same as that of one pass over all, without a loss; a block holds
    `block` series and the chosen ones. Ties go by candidate. Candidates without returns or score are passed over; an
    undefined correlation, or one over fewer than two common dates, counts as 0.
    """
    spark = candidates.sparkSession
    have = panel.where("ret is not null").select("candidate").distinct()
    left = written(candidates.where("score is not null and not isnan(score)").select("candidate", F.col("score").cast("double").alias("score")).join(have, "candidate", "left_semi"), "left")
    rows = panel.where("ret is not null").select("candidate", "date", "ret")
    kind = candidates.schema["candidate"].dataType.simpleString()
    chosen: list[tuple] = []
    last = None
    while len(chosen) < size:
        rest = left if last is None else left.where((F.col("score") < last[1]) | ((F.col("score") == last[1]) & (F.col("candidate") > last[0])))
        best = rest.orderBy(F.desc("score"), "candidate").limit(block).collect()  # a block
        if not best:
            break
        names = [r["candidate"] for r in best]
        had = [c for c, _ in chosen]
        room = size - len(chosen)

        series = rows.where(F.col("candidate").isin(names + had))
        taken = {r["candidate"] for r in series.groupBy(F.isnull("candidate").alias("one")).applyInPandas(_picker(names, had, room, most), f"candidate {kind}").collect()}  # at most `size`
        chosen += [(r["candidate"], r["score"]) for r in best if r["candidate"] in taken]
        last = (best[-1]["candidate"], best[-1]["score"])
    return spark.createDataFrame([(c, s, i + 1) for i, (c, s) in enumerate(chosen)], f"candidate {kind}, score double, place int")


def _picker(names: list, had: list, room: int, most: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The greedy pass over the series of `names`, in turn, beside those of `had`."""

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot_table(index="date", columns="candidate", values="ret", aggfunc="first")
        own: list = []
        for c in names:
            if len(own) < room and all(_corr(wide[c].to_numpy(float), wide[o].to_numpy(float)) < most for o in [*had, *own]):
                own.append(c)
        return pd.DataFrame({"candidate": own})

    return pick


def _corr(x: np.ndarray, y: np.ndarray) -> float:
    both = np.isfinite(x) & np.isfinite(y)
    if both.sum() < 2:
        return 0.0
    x, y = x[both] - x[both].mean(), y[both] - y[both].mean()
    scale = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / scale) if scale > 0 else 0.0

