"""Contracts, data quality and versions of tables: checks as columns of one pass, diffs as one join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def field_checks(df: DataFrame, fields: dict[str, tuple[bool, bool]]) -> DataFrame:
    """(field, nulls, not_positive, passed) for {name: (nullable, positive only)}, in one pass; NaN counts as null."""
    kinds = dict(df.dtypes)
    void = {c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False)) for c in fields}
    sums = df.agg(*[F.count_if(void[c]).alias(f"n_{c}") for c in fields], *[F.count_if(F.col(c) <= 0).alias(f"p_{c}") for c, (_, pos) in fields.items() if pos])
    each = [F.struct(F.lit(c).alias("field"), F.col(f"n_{c}").alias("nulls"), (F.col(f"p_{c}") if pos else F.lit(0).cast("long")).alias("not_positive"), ((F.lit(null) | (F.col(f"n_{c}") == 0)) & ((F.col(f"p_{c}") == 0) if pos else F.lit(True))).alias("passed")) for c, (null, pos) in fields.items()]
    return sums.select(F.inline(F.array(*each)))


def price_jumps(df: DataFrame, warn: float = 0.5, impossible: float = 2.3, price: str = "close", key: str = "symbol", ts: str = "date") -> DataFrame:
    """Log returns beyond either limit by key: split-like ones warn, impossible ones are errors."""
    r = F.abs(F.log(F.col(price) / F.lag(price).over(Window.partitionBy(key).orderBy(ts))))
    return df.select(key, r.alias("_r")).groupBy(key).agg(F.count_if(F.col("_r") > impossible).alias("errors"), F.count_if((F.col("_r") > warn) & (F.col("_r") <= impossible)).alias("warnings"))


def leaks(df: DataFrame, decision: Column, available: str, key: str) -> DataFrame:
    """Rows that were not yet available at the decision, by key; unknown availability counts."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(available) > decision).alias("leaks"), F.count_if(F.col(available).isNull()).alias("unknown"))


def staleness(df: DataFrame, decision: Column, most_days: int, key: str = "symbol", ts: str = "date") -> DataFrame:
    """Days between each key's last row and the decision, and whether they are too many."""
    return df.groupBy(key).agg(F.max(ts).alias("last")).withColumn("days", F.datediff(decision, F.col("last"))).withColumn("stale", F.col("days") > most_days)


def sequence_faults(df: DataFrame, key: str, ts: str, seq: str) -> DataFrame:
    """Repeated timestamps, and steps that do not go forward in ingest order (ties by time), by key."""
    past = F.lag(ts).over(Window.partitionBy(key).orderBy(seq, ts))
    return df.withColumn("_back", F.col(ts) <= past).groupBy(key).agg((F.count(ts) - F.count_distinct(ts)).alias("repeated"), F.count_if("_back").alias("backward"))


def missing_sessions(df: DataFrame, holidays: DataFrame | None = None, key: str = "symbol", ts: str = "date") -> DataFrame:
    """(key, date): weekdays between a key's first and last row without a row, less holidays (a short list of dates)."""
    spans = df.groupBy(key).agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    days = spans.select(key, F.explode(F.sequence("a", "b")).alias(ts)).where(F.weekday(ts) < 5)
    if holidays is not None:
        days = days.join(holidays.select(ts).distinct(), ts, "left_anti")
    return days.join(df.select(key, ts).distinct(), [key, ts], "left_anti")


def unexpected_sessions(df: DataFrame, holidays: DataFrame | None = None, key: str = "symbol", ts: str = "date") -> DataFrame:
    """Rows on weekends or holidays by key."""
    if holidays is None:
        df = df.withColumn("_h", F.lit(False))
    else:
        df = df.join(holidays.select(F.col(ts).alias("_d")).distinct(), F.col(ts) == F.col("_d"), "left").withColumn("_h", F.col("_d").isNotNull())
    return df.groupBy(key).agg(F.count_if(F.weekday(ts) >= 5).alias("weekend"), F.count_if("_h").alias("holiday"))


def quality_scores(df: DataFrame, jump: float = 0.5, holidays: DataFrame | None = None) -> DataFrame:
    """Score from 1 down by penalties, and the decision; a repeated or backward date or an impossible bar rejects."""
    w = Window.partitionBy("symbol").orderBy("date")
    past = F.lag("close").over(w)
    bad = (F.col("high") < F.col("low")) | (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    low = F.least("open", "high", "low", "close") <= 0
    x = df.withColumns({"_r": F.abs(F.col("close") / past - 1), "_new": F.col("date").isNotNull() & ~F.col("date").eqNullSafe(F.lag("date").over(w))})
    free = F.array().cast("array<date>")
    if holidays is not None:
        x = x.join(F.broadcast(holidays.agg(F.collect_set(F.col("date").cast("date")).alias("_free"))), F.lit(True))  # a short list in one row
        free = F.col("_free")
    weekday = lambda d: F.weekday(d) < 5
    sums = x.groupBy("symbol").agg(
        F.count("*").alias("n"), (F.count("date") - F.count_if("_new")).alias("repeated"), F.count_if(bad).alias("impossible"),
        F.count_if(low).alias("not_positive"), F.count_if(F.col("_r") > jump).alias("extreme"),
        F.min("date").alias("_a"), F.max("date").alias("_b"), F.count_if(F.col("_new") & weekday("date") & ~F.array_contains(free, F.col("date"))).alias("_met"), F.first(free).alias("_free"),
    )
    # weekdays of the span less holidays and rows met: counted, not listed
    days, first = F.datediff("_b", "_a") + 1, F.weekday("_a")
    ends = F.greatest(F.least(first + days % 7, F.lit(7)) - F.greatest(first, F.lit(5)), F.lit(0))
    closed = F.size(F.filter("_free", lambda h: weekday(h) & h.between(F.col("_a"), F.col("_b"))))
    missing = days - 2 * F.floor(days / 7) - ends - closed - F.col("_met")
    x = sums.withColumn("missing", F.when(F.col("symbol").isNull(), 0).otherwise(F.coalesce(missing, F.lit(0))).cast("long")).drop("_a", "_b", "_met", "_free")
    one = lambda c, w: F.when(F.col(c) > 0, w).otherwise(0.0)
    score = 1.0 - one("repeated", 0.4) - one("impossible", 0.4) - one("not_positive", 0.2) - 0.05 * F.least(F.col("extreme"), F.lit(5)) - 0.01 * F.least(F.col("missing"), F.lit(30))
    x = x.withColumn("score", F.round(F.greatest(score, F.lit(0.0)), 4))
    hard = (F.col("repeated") > 0) | (F.col("impossible") > 0) | (F.col("score") <= 0)
    return x.withColumn("decision", F.when(hard, "rejected").when(F.col("score") < 0.5, "quarantined").when(F.col("score") < 0.85, "warning").otherwise("approved"))


def latest_state(ledger: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """The last state of each key of an append-only ledger, and how often it was written."""
    return ledger.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state), F.count("*").alias("n"))


def coverage(requested: DataFrame, reports: DataFrame, key: str, decision: str) -> DataFrame:
    """Requested keys by decision; those without a report are missing."""
    return requested.select(key).distinct().join(reports.select(key, decision), key, "left").groupBy(F.coalesce(F.col(decision), F.lit("missing")).alias(decision)).agg(F.count("*").alias("n"))


def content_hash(df: DataFrame, columns: list[str], key: str | None = None) -> DataFrame:
    """Digest of a set of rows that no order and no partitioning changes: count and the sum of the first 32 bits of each row's MD5. Values as text, nulls as a control character."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    part = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return df.select(*([key] if key else []), part.alias("_h")).groupBy(*([key] if key else [])).agg(F.count("*").alias("n"), F.sum("_h").alias("digest"))


def dataset_diff(old: DataFrame, new: DataFrame, key: str, group: str, values: list[str], rtol: float = 1e-6, atol: float = 1e-9) -> DataFrame:
    """By group: rows added, removed, and cells changed beyond the tolerance (nulls equal), and the group's state."""
    a = old.select(F.col(key).alias("_ka"), F.col(group).alias("_ga"), *[F.col(v).alias(f"a_{v}") for v in values])
    b = new.select(F.col(key).alias("_kb"), F.col(group).alias("_gb"), *[F.col(v).alias(f"b_{v}") for v in values])
    both = a.join(b, F.col("_ka") == F.col("_kb"), "full_outer")
    far = [F.when(F.col(f"a_{v}").isNull() | F.col(f"b_{v}").isNull(), ~F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}"))).otherwise(F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) > atol + rtol * F.abs(F.col(f"b_{v}"))) for v in values]
    cells = reduce(lambda x, y: x + y, [F.when(f, 1).otherwise(0) for f in far])
    there = F.col("_ka").isNotNull() & F.col("_kb").isNotNull()
    out = both.groupBy(F.coalesce("_gb", "_ga").alias(group)).agg(F.count_if(F.col("_ka").isNull()).alias("added"), F.count_if(F.col("_kb").isNull()).alias("removed"), F.sum(F.when(there, cells).otherwise(0)).alias("cells"), F.count("_ka").alias("_n"), F.count("_kb").alias("_m"))
    state = F.when(F.col("_n") == 0, "added").when(F.col("_m") == 0, "removed").when(F.col("added") + F.col("removed") + F.col("cells") > 0, "changed").otherwise("unchanged")
    return out.withColumn("state", state).drop("_n", "_m")


def stale_artefacts(diff: DataFrame, uses: DataFrame, group: str, artefact: str) -> DataFrame:
    """Artefacts that use a group which is not unchanged, with the number of such groups."""
    return uses.join(diff.where("state != 'unchanged'").select(group), group).groupBy(artefact).agg(F.count_distinct(group).alias("changed"))


def expectations(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """(rule, field, failed, passed) in one pass: ('not_null', c), ('unique', c), ('in_set', c, values), ('between', c, lo, hi), ('matches', c, pattern). Missing columns fail; nulls fail in_set and between, and equal each other in unique; a pattern stands at the start."""
    n, out = F.count("*"), []
    for k, (rule, c, *args) in enumerate(rules):
        if c not in df.columns:
            failed = n
        elif rule == "not_null":
            failed = F.count_if(F.col(c).isNull())
        elif rule == "unique":
            failed = n - F.count_distinct(F.col(c)) - F.when(F.count_if(F.col(c).isNull()) > 0, 1).otherwise(0)
        elif rule == "in_set":
            failed = F.count_if(~F.coalesce(F.col(c).isin(*args[0]), F.lit(False)))
        elif rule == "between":
            failed = F.count_if(~F.coalesce(F.col(c).between(*args), F.lit(False)))
        else:
            failed = F.count_if(~F.coalesce(F.col(c).cast("string"), F.lit("nan")).rlike(f"^(?:{args[0]})"))
        out.append(failed.cast("long").alias(f"f{k}"))
    each = [F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("field"), F.col(f"f{k}").alias("failed"), (F.col(f"f{k}") == 0).alias("passed")) for k, r in enumerate(rules)]
    return df.agg(*out).select(F.inline(F.array(*each)))


def table_audit(df: DataFrame, required: list[str], keys: list[str]) -> DataFrame:
    """Rows, nulls in required columns, and rows beyond the first of each key."""
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in required])
    by_key = df.withColumn("_n", nulls).groupBy(*keys).agg(F.count("*").alias("k"), F.sum("_n").alias("n"))
    return by_key.agg(F.sum("k").alias("rows"), F.sum("n").alias("nulls"), F.sum(F.col("k") - 1).alias("duplicates"), F.count_if(F.col("k") > 1).alias("duplicate_keys"))


def return_panel_faults(df: DataFrame, least: int, key: str = "symbol", ts: str = "date", ret: str = "ret") -> DataFrame:
    """By key: missing returns, losses beyond all, repeated times, active rows, and whether the panel can be used."""
    r = F.col(ret)
    x = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(r.isNull() | F.isnan(r)).alias("missing"), F.count_if(r < -1).alias("below"), (F.count(ts) - F.count_distinct(ts)).alias("repeated"), F.count_if(F.abs(r) > 1e-12).alias("active"))
    return x.withColumn("usable", (F.col("below") == 0) & (F.col("repeated") == 0) & (F.col("n") >= least) & (F.col("active") > 0))


def survivorship(universe: DataFrame, listings: DataFrame, start: Column, end: Column, key: str = "symbol") -> DataFrame:
    """Findings by key: no listing, not listed yet at the start, delisted before the end."""
    x = universe.select(key).distinct().join(listings.select(key, F.col("start").alias("_a"), F.col("end").alias("_b"), F.lit(True).alias("_in")), key, "left")
    found = F.when(F.col("_in").isNull(), "no_listing").when(F.col("_a") > start, "not_listed_yet").when(F.col("_b") < end, "delisted")
    return x.select(key, found.alias("finding")).where("finding is not null")


def closed_session_rows(df: DataFrame, ts: str, scope: str, holidays: DataFrame) -> DataFrame:
    """Rows on weekends or holidays of their scope; `holidays` (scope, date) is a short list."""
    h = holidays.select(F.col(scope).alias("_s"), F.col("date").alias("_d")).distinct()
    x = df.withColumn("_day", F.to_date(ts)).join(h, (F.col(scope) == F.col("_s")) & (F.col("_day") == F.col("_d")), "left")
    why = F.when(F.weekday("_day") >= 5, "weekend").when(F.col("_d").isNotNull(), "holiday")
    return x.groupBy(scope, why.alias("why")).agg(F.count("*").alias("n")).where("why is not null")


def by_priority(sources: list[DataFrame], key: list[str], value: str) -> DataFrame:
    """The value of the first source that has one for each key, the source's place, and how many sources had one."""
    each = [s.select(*key, F.col(value), F.lit(k).alias("source")) for k, s in enumerate(sources)]
    x = reduce(DataFrame.unionByName, each).where(F.col(value).isNotNull())
    return x.groupBy(*key).agg(F.min_by(value, "source").alias(value), F.min("source").alias("source"), F.count_distinct("source").alias("sources"))


def book_mismatches(ours: DataFrame, theirs: DataFrame, key: str, value: str, atol: float) -> DataFrame:
    """Keys that one book lacks or where values lie apart."""
    a, b = ours.select(F.col(key).alias("_a"), F.col(value).alias("ours")), theirs.select(F.col(key).alias("_b"), F.col(value).alias("theirs"))
    kind = F.when(F.col("_a").isNull(), "not_in_book").when(F.col("_b").isNull(), "not_at_broker").when(F.abs(F.col("ours") - F.col("theirs")) > atol, "differs")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), kind.alias("kind"), "ours", "theirs").where("kind is not null")


def attempts(expected: DataFrame, tried: DataFrame, key: str, accepted: str, order: list[str]) -> DataFrame:
    """One row for each expected unit: its first accepted attempt, how many more were accepted, and its state."""
    x = tried.where(F.col(accepted)).groupBy(key).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").otherwise("accepted")
    return expected.select(key).distinct().join(x, key, "left").select(key, *[F.col(f"first.{c}").alias(c) for c in order], (F.coalesce("n", F.lit(1)) - 1).alias("extra"), state.alias("state"))


def allowed(df: DataFrame, terms: DataFrame, provider: str, usage: str) -> DataFrame:
    """Rows whose provider permits the usage; `terms` (provider, usage) is a short list."""
    return df.join(terms.where(F.col("usage") == usage).select(F.col("provider").alias("_p")).distinct(), F.col(provider) == F.col("_p"), "left_semi")


#: Rounds of one edge each before paths are doubled.
STEPS = 32


def ancestors(edges: DataFrame, name, most: int = 64) -> DataFrame:
    """(node, ancestor) of a lineage table (child, parent), to the fixpoint; `name(df)` writes a round. A node that is its own ancestor lies on a cycle.

    A round follows one edge from the pairs of the round before alone, so a pair is made once for each length of its paths and the edge that ends them, not for each
    node between. What is deeper than STEPS, or has a cycle, goes on by paths that double.
    """
    edges = name(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct())
    up = edges.select(F.col("node").alias("_n"), F.col("ancestor").alias("_a"))
    rounds = [edges]
    for _ in range(STEPS):
        last = name(rounds[-1].join(up, F.col("ancestor") == F.col("_n")).select("node", F.col("_a").alias("ancestor")).distinct())
        if last.isEmpty():
            return reduce(DataFrame.unionByName, rounds).distinct()
        rounds.append(last)
    found = name(reduce(DataFrame.unionByName, rounds).distinct())
    n = found.count()
    for _ in range(most):
        up = found.select(F.col("node").alias("_n"), F.col("ancestor").alias("_a"))
        wider = name(found.unionByName(found.join(up, F.col("ancestor") == F.col("_n")).select("node", F.col("_a").alias("ancestor"))).distinct())
        m = wider.count()
        found = wider
        if m == n:
            return found
        n = m
    raise ValueError("the lineage is deeper than can be followed")
