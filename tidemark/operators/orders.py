"""Order events to states and positions, alerts with a pause, and the Sharpe ratio corrected for the number of trials."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.distributions import normal_cdf
from tidemark.operators.sequential import scan

# The legal moves of an order, as (state, event, next state).
MOVES = (
    ("created", "submitted", "submitted"), ("created", "rejected", "rejected"),
    ("submitted", "acknowledged", "acknowledged"), ("submitted", "rejected", "rejected"), ("submitted", "expired", "expired"),
    ("acknowledged", "partially_filled", "partially_filled"), ("acknowledged", "filled", "filled"), ("acknowledged", "cancel_requested", "cancel_pending"),
    ("acknowledged", "replace_requested", "replace_pending"), ("acknowledged", "expired", "expired"), ("acknowledged", "rejected", "rejected"),
    ("partially_filled", "partially_filled", "partially_filled"), ("partially_filled", "filled", "filled"), ("partially_filled", "cancel_requested", "cancel_pending"),
    ("partially_filled", "replace_requested", "replace_pending"), ("partially_filled", "expired", "expired"),
    ("cancel_pending", "cancelled", "cancelled"), ("cancel_pending", "filled", "filled"), ("cancel_pending", "partially_filled", "partially_filled"), ("cancel_pending", "rejected", "rejected"),
    ("replace_pending", "replaced", "replaced"), ("replace_pending", "cancelled", "cancelled"), ("replace_pending", "rejected", "rejected"), ("replace_pending", "filled", "filled"),
    ("replaced", "partially_filled", "partially_filled"), ("replaced", "filled", "filled"), ("replaced", "cancel_requested", "cancel_pending"), ("replaced", "replace_requested", "replace_pending"), ("replaced", "expired", "expired"),
)
FILLS = ("partially_filled", "filled")


def order_states(events: DataFrame) -> DataFrame:
    """(order_id, state, events, illegal, filled, average): the last legal state of every order, which starts as created.

    `events` has (order_id, seq, kind, qty, price). Events that the state does not allow count as illegal and change nothing.
    An order's events, few by nature, are folded in one sorted array; orders spread over the tasks.
    """
    moves = F.create_map(*[F.lit(v) for s, e, n in MOVES for v in (f"{s}>{e}", n)])
    zero = F.struct(F.lit("created").alias("state"), F.lit(0).cast("long").alias("illegal"), F.lit(0.0).alias("filled"), F.lit(0.0).alias("paid"))

    def step(a: Column, e: Column) -> Column:
        to = F.element_at(moves, F.concat_ws(">", a["state"], e["kind"]))
        qty = F.when(to.isNotNull() & e["kind"].isin(*FILLS), F.coalesce(e["qty"], F.lit(0.0))).otherwise(0.0)
        return F.struct(
            F.coalesce(to, a["state"]).alias("state"), (a["illegal"] + to.isNull().cast("long")).alias("illegal"), (a["filled"] + qty).alias("filled"), (a["paid"] + qty * F.coalesce(e["price"], F.lit(0.0))).alias("paid")
        )

    g = events.groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", F.col("qty").cast("double").alias("qty"), F.col("price").cast("double").alias("price")))).alias("e"))
    g = g.select("order_id", F.size("e").cast("long").alias("events"), F.aggregate("e", zero, step).alias("a"))
    return g.select("order_id", "a.state", "events", "a.illegal", "a.filled", F.when(F.col("a.filled") > 0, F.col("a.paid") / F.col("a.filled")).alias("average"))


def alerts(df: DataFrame, rules: dict[str, Column], pause: int) -> DataFrame:
    """(symbol, rule, date) of the alerts: rows on which a rule holds, none of them within `pause` days after the rule's last alert for the symbol."""
    hit = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda v: v.isNotNull())
    hits = df.select("symbol", "date", F.explode(hit).alias("rule")).withColumn("key", F.concat_ws("/", "rule", F.col("symbol").cast("string"))).withColumn("day", F.unix_date("date"))

    def step(last, rows):
        day = rows["day"].to_numpy()
        fired = np.zeros(len(day), bool)
        at = 0 if last is None else int(np.searchsorted(day, last + pause))
        while at < len(day):
            fired[at], last = True, int(day[at])
            at = int(np.searchsorted(day, last + pause))
        return last, {"fired": fired}

    return scan(hits, "key", ["date"], ["day"], "fired boolean", lambda: None, step).where("fired").select("symbol", "rule", "date")


def deflated_sharpe(df: DataFrame, trials: int, periods: int = 252) -> DataFrame:
    """(symbol, n, sharpe, probabilistic, deflated): chance that the Sharpe ratio a year beats zero, and that it beats the best of `trials` ratios without skill.

    Shape corrects the ratio's variance. Under ten rows, without deviation, or with a variance of zero or less, both are 0; under two trials `deflated` is.
    """
    x = df.where("ret is not null").groupBy("symbol").agg(F.count("*").alias("n"), F.avg("ret").alias("m"), F.stddev_pop("ret").alias("s"), F.skewness("ret").alias("k3"), (F.kurtosis("ret") + 3).alias("k4"))
    x = x.withColumn("sharpe", F.when(F.col("s") > 1e-12, F.col("m") / F.col("s") * math.sqrt(periods)).otherwise(0.0))
    var = (1 - F.col("k3") * F.col("sharpe") + (F.col("k4") - 1) / 4 * F.col("sharpe") ** 2) / (F.col("n") - 1)
    x = x.withColumn("v", F.when((F.col("n") >= 10) & (F.col("s") > 1e-12), var))
    beyond = lambda level: F.coalesce(F.when(F.col("v") > 0, normal_cdf((F.col("sharpe") - level) / F.sqrt("v"))), F.lit(0.0))
    return x.select("symbol", "n", "sharpe", beyond(0.0).alias("probabilistic"), (beyond(best_of(trials)) if trials > 1 else F.lit(0.0)).alias("deflated"))


def best_of(trials: int) -> float:
    """Expected greatest of `trials` standard normals."""
    normal, gamma = NormalDist(), 0.5772156649015329
    return (1 - gamma) * normal.inv_cdf(1 - 1 / trials) + gamma * normal.inv_cdf(1 - 1 / (trials * math.e))
