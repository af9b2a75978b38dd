"""Point-in-time reads, calendars, identities, star tables and registries: joins that never look ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.tables import asof


def asof_checked(left: DataFrame, right: DataFrame, key: str, ts: str, available: str, values: list[str]) -> DataFrame:
    """As-of join that fails where a value was available only after the row that it meets."""
    both = asof(left, right, key, ts, [*values, available])
    late = F.col(available) > F.col(ts)
    return both.withColumn(available, F.when(F.assert_true(~F.coalesce(late, F.lit(False)), "a value from the future").isNull(), F.col(available)))


def feature_at(features: DataFrame, at: Column, key: str) -> DataFrame:
    """For each key the value known at `at`: decided by then where there is one, then the newest decision, then the newest availability."""
    known = features.where(F.col("available_time") <= at).withColumn("_in", F.col("decision_time") <= at)
    best = known.groupBy(key).agg(F.max_by(F.struct("decision_time", "available_time", "value"), F.struct("_in", "decision_time", "available_time", "value")).alias("m"))
    return best.select(key, "m.*")


def missingness(features: DataFrame, key: str) -> DataFrame:
    """Versions of each key and how many have no finite value."""
    v = F.col("value")
    return features.groupBy(key).agg(F.count("*").alias("n"), F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("missing"))


def known_facts(facts: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Facts accepted at or before each decision of their key; `decisions` (key, decision) has a row or few for each key."""
    d = decisions.select(F.col(key).alias("_k"), "decision")
    return facts.join(d, (F.col(key) == F.col("_k")) & (F.col("accepted") <= F.col("decision"))).drop("_k")


def latest_concepts(facts: DataFrame, as_of: Column, lags: int) -> DataFrame:
    """(symbol, concept, lag, value): the best fact of each of the newest `lags` periods; annual before quarterly, then the newest filing."""
    known = facts.where(F.col("accepted") <= as_of)
    order = Window.partitionBy("symbol", "concept", "period").orderBy(F.desc(F.col("form") == "annual"), F.desc("accepted"), F.desc("fact_id"))
    best = known.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    lag = F.row_number().over(Window.partitionBy("symbol", "concept").orderBy(F.desc("period"))) - 1
    return best.withColumn("lag", lag).where(F.col("lag") < lags).select("symbol", "concept", "lag", "period", "value")


def policy_target(observed: Column, policy: str) -> Column:
    """The day from which an observation may be used, before it is moved to a session."""
    day = F.to_date(observed)
    rules = {
        "next_day": F.date_add(day, 1),
        "friday_after": F.date_add(day, F.pmod(F.lit(4) - F.weekday(day), F.lit(7)).cast("int")),
        "next_month": F.trunc(F.add_months(day, 1), "month"),
        "quarter_end_60": F.date_add(F.last_day(F.add_months(F.trunc(day, "quarter"), 2)), 60),
        "thirteen_months": F.add_months(day, 13),
    }
    return rules[policy]


def next_session(rows: DataFrame, target: Column, sessions: DataFrame) -> DataFrame:
    """`rows` with `session`, the first of `sessions` (date) at or after the target; null beyond the last. Sessions are few."""
    s = sessions.select("date").distinct()
    days = s.select(F.col("date").alias("session"), F.lag("date").over(Window.orderBy("date")).alias("_p"))  # a row for each session
    spans = days.select("session", F.explode(F.sequence(F.coalesce(F.date_add("_p", 1), F.col("session")), F.col("session"))).alias("_day"))
    first = F.broadcast(s.agg(F.min("date").alias("_first")))  # one row
    # Earlier targets wait for the first session.
    dealt = rows.withColumn("_t", target).join(first, F.lit(True), "left").withColumn("_t", F.greatest("_t", "_first"))
    return dealt.join(spans, F.col("_t") == F.col("_day"), "left").drop("_t", "_day", "_first")


def latest_of(columns: list[str]) -> Column:
    """The latest of several availability columns; null where one is missing."""
    return F.when(~sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)).cast("boolean"), F.greatest(*columns))


def active_at(pairs: DataFrame, listings: DataFrame, key: str, ts: str) -> DataFrame:
    """`pairs` with `active`: was the key listed on that day?"""
    x = pairs.join(listings.select(F.col(key).alias("_k"), "start", "end"), F.col(key) == F.col("_k"), "left")
    inside = (F.col("start") <= F.col(ts)) & (F.col("end").isNull() | (F.col(ts) <= F.col("end")))
    return x.withColumn("active", F.coalesce(inside, F.lit(False))).drop("_k", "start", "end")


def universe_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys added or removed between two lists."""
    a, b = old.select(F.col(key).alias("_a")).distinct(), new.select(F.col(key).alias("_b")).distinct()
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), change.alias("change")).where("change is not null")


def affected(diff: DataFrame, consumers: DataFrame, key: str) -> DataFrame:
    """Consumers (consumer, keys array) that use a changed key, with the number of such keys."""
    return consumers.select("consumer", F.explode(F.array_distinct("keys")).alias(key)).join(diff, key).groupBy("consumer").agg(F.count("*").alias("touched"))


def resolved(symbols: DataFrame, records: DataFrame) -> DataFrame:
    """(symbol, canonical, status) by `records` (canonical, aliases); a canonical name wins over an alias, an alias of several is ambiguous."""
    names = records.select(F.col("canonical").alias("_n"), "canonical", F.lit(0).alias("_rank")).union(records.select(F.explode("aliases").alias("_n"), "canonical", F.lit(1)))
    own = names.groupBy("_n").agg(F.min("_rank").alias("_rank"), F.max(F.when(F.col("_rank") == 0, F.col("canonical"))).alias("_own"), F.count_distinct("canonical").alias("_k"), F.min("canonical").alias("_one"))
    x = symbols.join(own, F.col("symbol") == F.col("_n"), "left")
    status = F.when(F.col("_n").isNull(), "unknown").when(F.col("_rank") == 0, "canonical").when(F.col("_k") > 1, "ambiguous").otherwise("alias")
    found = F.coalesce("_own", F.when(F.col("_k") == 1, F.col("_one")))
    return x.select("symbol", found.alias("canonical"), status.alias("status"))


def normal_symbol(c: Column) -> Column:
    """Upper case, no blanks around, one separator of share classes."""
    return F.regexp_replace(F.upper(F.trim(c)), r"[./ _]+", "-")


def best_match(left: DataFrame, mapping: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Each left row with the best of the mapping's rows for its key."""
    w = Window.partitionBy(key).orderBy(*order)
    return left.join(mapping.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r"), key, "left")


def star(facts: DataFrame, symbol: str, ts: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts with keys, symbol dimension, date dimension): a symbol's key is the first 60 bits of its SHA-1, a date's is yyyymmdd. Two symbols of one key fail."""
    keyed = facts.withColumns({"symbol_key": F.conv(F.substring(F.sha1(F.col(symbol).cast("string")), 1, 15), 16, 10).cast("long"), "date_key": F.date_format(ts, "yyyyMMdd").cast("int")})
    symbols = keyed.select("symbol_key", symbol).distinct().groupBy("symbol_key").agg(F.count("*").alias("_n"), F.min(symbol).alias(symbol))
    symbols = symbols.select(F.when(F.col("_n") > 1, F.raise_error(F.lit("two symbols have one key"))).otherwise(F.col("symbol_key")).alias("symbol_key"), symbol)
    dates = keyed.select("date_key", F.to_date(ts).alias("date")).distinct().withColumns({"year": F.year("date"), "quarter": F.quarter("date"), "month": F.month("date"), "weekday": F.weekday("date") + 1})
    return keyed.drop(symbol), symbols, dates


def event_window(bars: DataFrame, events: DataFrame, reach: int) -> DataFrame:
    """(symbol, event, offset, close): the bars around each event; an event falls on the last bar at or before it. Both sides meet by symbol and bar number."""
    k = F.row_number().over(Window.partitionBy("symbol").orderBy("date"))
    numbered = bars.select("symbol", "date", "close", k.alias("k"))
    at = asof(events.select("symbol", F.col("event").alias("date")), numbered.select("symbol", "date", "k"), "symbol", "date", ["k"]).where("k is not null")
    near = at.select("symbol", F.col("date").alias("event"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset"), "k")
    near = near.withColumn("k", F.col("k") + F.col("offset"))
    return near.join(numbered.drop("date"), ["symbol", "k"]).select("symbol", "event", "offset", "close")


def on_spine(spine: DataFrame, feed: DataFrame, key: str, ts: str, values: list[str], keep_days: int | None = None) -> DataFrame:
    """The last known values of a feed on every session of a spine; older than `keep_days` they are void."""
    both = asof(spine, feed.withColumn("_seen", F.col(ts)), key, ts, [*values, "_seen"])
    if keep_days is not None:
        fresh = F.datediff(ts, "_seen") <= keep_days
        both = both.select(key, ts, *[F.when(fresh, F.col(v)).alias(v) for v in values])
    return both.select(key, ts, *values)


def blocked(rows: DataFrame, windows: DataFrame, key: str, ts: str) -> DataFrame:
    """`rows` with `blocked`: does the time lie in a window (key, start, end, ends included) of its scope? Starts and ends are events of one ordered pass, not a range join."""
    opens = windows.select(F.col(key), F.col("start").alias(ts), F.lit(1).alias("_d"), F.lit(0).alias("_o"))
    shuts = windows.select(F.col(key), F.col("end").alias(ts), F.lit(-1).alias("_d"), F.lit(2).alias("_o"))
    own = rows.select(F.col(key), F.col(ts), F.lit(0).alias("_d"), F.lit(1).alias("_o"), F.struct(*rows.columns).alias("_row"))
    none = F.lit(None).cast(own.schema["_row"].dataType)
    every = opens.withColumn("_row", none).unionByName(shuts.withColumn("_row", none)).unionByName(own)
    w = Window.partitionBy(key).orderBy(ts, "_o").rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn("blocked", F.sum("_d").over(w) > 0).where("_o = 1").select("_row.*", "blocked")


def with_prerequisites(rows: DataFrame, symbols: DataFrame, tags: DataFrame, at: Column) -> DataFrame:
    """Rows of chosen symbols and required tags that are available; both lists have few rows."""
    return rows.where(F.col("available") <= at).join(symbols, "symbol", "left_semi").join(tags, "tag", "left_semi")


def members_over_time(dates: DataFrame, listings: DataFrame) -> DataFrame:
    """Members on each date from listing events and a running sum: no range join."""
    ins = listings.groupBy(F.col("start").alias("date")).agg(F.count("*").alias("_d"))
    outs = listings.where("end is not null").groupBy(F.date_add("end", 1).alias("date")).agg((-F.count("*")).alias("_d"))
    steps = ins.unionByName(outs).groupBy("date").agg(F.sum("_d").alias("_d"))
    both = steps.join(dates.select("date").distinct().withColumn("_ask", F.lit(True)), "date", "full_outer")
    run = F.sum(F.coalesce("_d", F.lit(0))).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))  # a row for each date
    return both.withColumn("members", run).where("_ask and members > 0").select("date", "members")


def search_trials(trials: DataFrame, least: dict[str, float], tags: list[str], limit: int) -> DataFrame:
    """Trials whose JSON metrics are numbers of at least the given values and that have all tags; newest first, a report of `limit`."""
    for name, low in least.items():
        trials = trials.where(F.expr(f"try_cast(get_json_object(metrics, '$.{name}') AS double)") >= low)
    if tags:
        trials = trials.where(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), F.col("tags"))) == 0)
    return trials.orderBy(F.desc("ts"), F.desc("trial")).limit(limit)


def daily_cash(journal: DataFrame) -> DataFrame:
    """Cash of filled trades by day: minus notional, minus commission."""
    return journal.where("status = 'FILLED'").groupBy(F.to_date("ts").alias("date")).agg(F.sum(-F.col("notional") - F.col("commission")).alias("pnl"), F.count("*").alias("n_trades"))


def positions(journal: DataFrame) -> DataFrame:
    """Filled trades with the running signed quantity of their symbol; ties by id."""
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    w = Window.partitionBy("symbol").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return journal.where("status = 'FILLED'").withColumn("position", F.sum(signed).over(w))


def dashboard(journal: DataFrame, key: str, periods: int = 252) -> DataFrame:
    """By key over filled trades: total, days, share of winning days, Sharpe of daily cash, and the deepest fall of the cash curve."""
    daily = journal.where("status = 'FILLED'").groupBy(key, F.to_date("ts").alias("date")).agg(F.sum(-F.col("notional") - F.col("commission")).alias("pnl"))
    w = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.withColumn("_c", F.sum("pnl").over(w))
    daily = daily.withColumn("_dd", F.col("_c") - F.max("_c").over(w))
    sharpe = F.avg("pnl") / F.nullif(F.stddev("pnl"), F.lit(0.0)) * periods**0.5
    return daily.groupBy(key).agg(F.sum("pnl").alias("total"), F.count("*").alias("days"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), sharpe.alias("sharpe"), F.min("_dd").alias("drawdown"))


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Key-wise differences of two tables (name, value), nulls equal."""
    a, b = left.select(F.col("name").alias("_a"), F.col("value").alias("old")), right.select(F.col("name").alias("_b"), F.col("value").alias("new"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(F.coalesce("_a", "_b").alias("name"), "old", "new")


def canonical_rules(rules: DataFrame, payload: list[str], ref: str) -> DataFrame:
    """Distinct rules by a digest of their canonical payload, with the least and the number of their sources."""
    digest = F.sha2(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in payload]), 256)
    return rules.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min(ref).alias("first"), F.max(ref).alias("last"))


def merged_stages(stages: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """One row for each key over all stages, the first by order."""
    from functools import reduce

    rest = [c for c in stages[0].columns if c != key]
    return reduce(DataFrame.unionByName, stages).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("m")).select(key, "m.*")


def top_by(df: DataFrame, metric: str, n: int, key: str, ascending: bool = False) -> DataFrame:
    """A report of the n best rows by a metric; ties by key."""
    return df.where(F.col(metric).isNotNull()).orderBy(F.asc(metric) if ascending else F.desc(metric), key).limit(n)
