"""Predictor scores: a table of symbols by signals with eligibility, percentiles and buckets, composite scores under weight caps, and coverage."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.common import ROWS, dealt, written

#: Refresh periods in months, and the weight of a study's replication quality by its leading mark.
HORIZONS = (1, 3, 6, 12, 36)
QUALITY = {"1_good": 1.0, "2_fair": 0.85, "3_distant": 0.65, "4_lack_data": 0.40}
OTHER_QUALITY, NO_STATISTIC, LARGEST_STATISTIC, LEAST_FACTOR = 0.70, 0.70, 8.0, 0.10
#: A definition travels to every symbol, so there may not be more of them.
MAX_SIGNALS = 10_000


def _number(c: Column) -> Column:
    """A double; NaN is no value."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def _clauses() -> dict[str, Column]:
    """The closed list of eligibility clauses as predicates over a security's columns."""
    common, exchange = F.coalesce(F.col("common"), F.lit(False)), F.col("exchange")
    return {
        "abs(prc)>1": F.abs("price") > 1,
        "abs(prc)>5": F.abs("price") > 5,
        "shrcd<=11": common,
        "shrcd%in%c(10,11)": common,
        "exchcd==1": exchange == 1,
        "exchcd%in%c(1,2)": exchange.isin(1, 2),
        "exchcd%in%c(1,2,3)": exchange.isin(1, 2, 3),
        "me>me_nyse20": F.col("cap") > F.col("_cap20"),
    }


def parsed_filters(definitions: DataFrame) -> DataFrame:
    """Definitions with `clauses` (array) and `filter_status`: none, applied, or unsupported with what is not in the closed list.

    Commas outside parentheses part clauses; blanks and case don't matter. Null, empty, nan, none and na are no filter. Unbalanced parentheses are unsupported.
    """
    text = F.regexp_replace(F.lower(F.coalesce("filters", F.lit(""))), r"\s+", "")
    steps = F.transform(F.split(text, ""), lambda c: F.when(c == "(", 1).when(c == ")", -1).otherwise(0))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")), lambda a, s: F.struct((a.now + s).alias("now"), F.least(a.low, a.now + s).alias("low")))
    x = definitions.withColumns({"_t": F.when(text.isin("nan", "none", "na"), "").otherwise(text), "_d": depth})
    x = x.withColumn("clauses", F.filter(F.split("_t", r",(?![^()]*\))"), lambda c: c != ""))
    unknown = F.array_sort(F.array_except("clauses", F.array(*[F.lit(c) for c in _clauses()])))
    status = F.when(F.col("_t") == "", "none").when((F.col("_d.now") != 0) | (F.col("_d.low") < 0), "unsupported:unbalanced_parentheses").when(F.size(unknown) > 0, F.concat(F.lit("unsupported:"), F.array_join(unknown, "|"))).otherwise("applied")
    return x.withColumn("filter_status", status).drop("_t", "_d")


def evidence(status: Column, exact: float, proxy: float) -> Column:
    """Weight of a signal: how strong its two statistics are, up to a bound, times its replication quality and what its source is worth."""
    held = lambda c: F.when(_number(F.col(c)).isNotNull(), F.least(F.abs(c), F.lit(LARGEST_STATISTIC)) / LARGEST_STATISTIC)
    again, first = F.coalesce(held("t_again"), F.lit(0.0)), F.coalesce(held("t_first"), F.lit(NO_STATISTIC))
    quality = F.lit(None).cast("double")
    for mark, worth in QUALITY.items():
        quality = F.coalesce(quality, F.when(F.lower("quality").contains(mark), worth))
    source = F.when(status == "exact", exact).when(status == "proxy", proxy).otherwise(0.0)
    return F.greatest(again, F.lit(LEAST_FACTOR)) * F.greatest(first, F.lit(LEAST_FACTOR)) * F.coalesce(quality, F.lit(OTHER_QUALITY)) * source


def ladder(df: DataFrame, keys: Sequence[str], value: str, counted: Column, rows: int) -> DataFrame:
    """One row for each of the keys' distinct values that aren't null: `_k` rows with it, `_r` of them `counted`, and `_upto` counted rows with it or less.

    Values are dealt in ranges of (keys, value), a range is summed by itself, and its keys' sums of the ranges before it are added: no key lies in one task.
    """
    x = df.where(F.col(value).isNotNull()).select(*keys, value, counted.cast("int").alias("_c"), F.xxhash64(value).alias("_h"))
    ranges = max(math.ceil(rows / ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = dealt(x, rows, *keys, "_h").groupBy(*keys, "_h", value).agg(F.count("*").alias("_k"), F.sum("_c").alias("_r")).drop("_h")
    x = written(x.repartitionByRange(ranges, *keys, value).withColumn("_range", F.spark_partition_id()), "ladder")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy(*keys, "_range").agg(F.sum("_r").alias("_all")).withColumn("_before", F.coalesce(F.sum("_all").over(before), F.lit(0))).drop("_all")  # a row for a range and a key in it
    within = F.sum("_r").over(Window.partitionBy("_range", *keys).orderBy(value))
    x = dealt(x, rows, "_range").withColumn("_within", within).join(sums, [*keys, "_range"])
    return written(x.select(*keys, value, "_k", "_r", (F.col("_before") + F.col("_within")).alias("_upto")), "ladder")


def on_ladder(df: DataFrame, steps: DataFrame, keys: Sequence[str], value: str, apart: Column, rows: int) -> DataFrame:
    """`df` with what `ladder` found for each row's value; rows without a value get nulls and are dealt by `apart`, so they don't meet in one task."""
    name = f"{value}_"
    a = df.withColumn("_h", F.when(F.col(value).isNotNull(), F.xxhash64(value)).otherwise(F.xxhash64(apart)))
    b = steps.withColumnRenamed(value, name).withColumn("_h", F.xxhash64(name))
    # doubles would be dealt anew by their normal form: their hash is the key, and the bounds settle equal hashes
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "_h")] + [F.col(value) <= F.col(name), F.col(value) >= F.col(name)]
    met = dealt(a, rows, *keys, "_h").alias("a").join(dealt(b, rows, *keys, "_h").alias("b"), on, "left")
    return met.select(*[f"a.{c}" for c in df.columns], "_k", "_r", "_upto")


def feature_table(values: DataFrame, definitions: DataFrame, context: DataFrame, exact: float = 1.0, proxy: float = 0.55, least_varied: float = 0.01, least_rows: int = 1, least_share: float = 0.0) -> DataFrame:
    """One row for every as_of and symbol of `context` and every signal of `definitions`.

    `values` holds (as_of, symbol, signal, raw, status, source, formula, available_at), `definitions` (signal, sign, horizon, family, grp, quality, t_again, t_first,
    q_cut, breakpoints, form, filters, absent_status, absent_source), `context` (as_of, symbol, exchange, price, common, cap). A null grp is a group of one signal, a null sign 1, a null q_cut 0.2, a null form continuous, a null horizon 1.

    Values that are null or NaN are missing; values of other symbols or signals are left out; of repeated keys one row is taken (the least by its columns). A filter with
    anything outside the closed list lets nothing through. `pct` is the mid-point distribution within an as_of and signal, over eligible values of exchange 1 alone where breakpoints
    is NYSE. Continuous signals are long or short beyond their quantiles and count 50 between; others count their `pct`. Cross-sections that are small or (nearly)
    constant give nothing. Ranks are taken by `ladder`, so no as_of and signal lies in one task, but for rows of one and the same value where they meet its rank.
    """
    own = ["signal", "sign", "horizon", "family", "grp", "quality", "t_again", "t_first", "q_cut", "breakpoints", "form", "filters", "absent_status", "absent_source"]
    d = parsed_filters(definitions.where("signal is not null").groupBy("signal").agg(F.min(F.struct(*own)).alias("d")).select("d.*"))
    signals = d.count()
    if signals > MAX_SIGNALS:
        raise ValueError(f"more than {MAX_SIGNALS} definitions")
    names, rows = d.agg(F.collect_list("signal").alias("_names")), context.count() * signals
    held = dealt(context.where("as_of is not null and symbol is not null"), rows, "as_of", "symbol").groupBy("as_of", "symbol").agg(F.min(F.struct("exchange", _number(F.col("price")).alias("price"), "common", _number(F.col("cap")).alias("cap"))).alias("c")).select("as_of", "symbol", "c.*")
    caps = held.where("exchange = 1").groupBy("as_of").agg(F.percentile("cap", F.lit(0.2)).alias("_cap20"))
    passed = F.lit(True)
    for clause, holds in _clauses().items():
        passed = passed & (~F.array_contains("clauses", clause) | F.coalesce(holds, F.lit(False)))
    given = values.join(F.broadcast(d.select("signal")), "signal", "left_semi").select("as_of", "symbol", "signal", F.struct(_number(F.col("raw")).alias("raw"), "status", "source", "formula", "available_at").alias("v"))
    given = dealt(given, rows, "as_of", "symbol").groupBy("as_of", "symbol", "signal").agg(F.min("v").alias("v"))
    given = given.groupBy("as_of", "symbol").agg(F.collect_list(F.struct("signal", "v")).alias("_v"))  # at most one value a definition
    kind = given.schema["_v"].dataType
    x = held.join(given, ["as_of", "symbol"], "left").join(F.broadcast(names), F.lit(True))  # one row of names
    had = F.coalesce("_v", F.array().cast(kind))
    gaps = F.transform(F.array_except("_names", had.getField("signal")), lambda n: F.struct(n.alias("signal"), F.lit(None).cast(kind.elementType["v"].dataType).alias("v")))
    x = x.select(*held.columns, F.explode(F.concat(had, gaps.cast(kind))).alias("_s")).select(*held.columns, "_s.*").join(F.broadcast(d), "signal").join(F.broadcast(caps), "as_of", "left")  # a row for an as_of
    x = x.withColumn("passed", ~F.col("filter_status").startswith("unsupported") & passed)
    near = F.element_at(F.array_sort(F.transform(F.array(*map(F.lit, HORIZONS)), lambda h: F.struct(F.abs(h - F.col("horizon")).alias("far"), h.alias("h")))), 1).h
    computed, raw = F.col("v").isNotNull(), F.col("v.raw")
    nyse = F.upper(F.trim(F.coalesce("breakpoints", F.lit("")))) == "NYSE"
    implementation = F.when(computed, F.col("v.status")).otherwise(F.coalesce("absent_status", F.lit("unavailable")))
    x = x.select(
        "as_of", "symbol", "signal", raw.alias("raw"), implementation.alias("implementation"),
        F.when(computed, F.col("v.source")).otherwise(F.coalesce("absent_source", F.lit("no_formula"))).alias("source"), F.coalesce("v.formula", F.lit("")).alias("formula"), F.col("v.available_at").alias("available_at"),
        evidence(F.when(raw.isNotNull(), implementation), exact, proxy).alias("potential"), "passed", (raw.isNotNull() & F.col("passed")).alias("_ok"),
        F.when(raw.isNotNull() & F.col("passed"), raw * F.coalesce("sign", F.lit(1.0))).alias("_v"), (nyse & F.coalesce(F.col("exchange") != 1, F.lit(True))).alias("_other"),
    )
    x = written(x.withColumn("_ref", F.col("_ok") & ~F.col("_other")).drop("_other"), "grid")
    g = ["as_of", "signal"]
    steps = ladder(x, g, "_v", F.col("_ref"), rows)
    one = lambda c: F.sum(F.col(c).cast("int"))
    groups = x.groupBy(*g).agg(one("_ok").alias("_n"), one("_ref").alias("_m"), F.greatest(F.lit(least_rows), F.ceil(F.count("*") * least_share)).alias("_need")).join(F.broadcast(d.select("signal", F.coalesce("q_cut", F.lit(0.2)).alias("q_cut"))), "signal")
    groups = written(groups.withColumns({"_lo": (F.col("_m") - 1) * F.col("q_cut"), "_hi": (F.col("_m") - 1) * (1 - F.col("q_cut"))}).drop("q_cut"), "groups")  # a row for an as_of and signal

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_r") <= place) & (place < F.col("_upto")), F.col("_v")))

    def between(place: str) -> Column:
        below = F.col(f"{place}_0")
        return below + (F.coalesce(f"{place}_1", below) - below) * (F.col(place) - F.floor(place))

    places = steps.join(groups, g).groupBy(*g).agg(F.max("_k").alias("_most"), *[at(F.floor(p) + k).alias(f"{p}_{k}") for p in ("_lo", "_hi") for k in (0, 1)])
    groups = groups.join(places, g, "left").select(*g, "_n", "_m", "_need", "_most", between("_lo").alias("_low"), between("_hi").alias("_high"), ((F.col("_n") < F.col("_need")) | (F.col("_m") < F.col("_need"))).alias("_few"))
    groups = written(groups, "groups")
    fixed = d.select(
        "signal", F.coalesce("sign", F.lit(1.0)).cast("double").alias("sign"), F.when(F.col("horizon").isNull(), 1).otherwise(near).alias("horizon"), "family", F.coalesce("grp", F.concat(F.lit("single_"), "signal")).alias("grp"),
        "filter_status", F.lower(F.trim(F.coalesce("form", F.lit("continuous")))).alias("form"),
    )
    x = on_ladder(x, steps, g, "_v", F.col("symbol"), rows).join(groups, g).join(F.broadcast(fixed), "signal").withColumn("age_days", F.datediff("as_of", "available_at"))
    n = F.nullif(F.col("_n"), F.lit(0))
    dull = ~F.col("_few") & (F.col("_n") >= 3) & ((F.col("_most") == n) | (1 - F.col("_most") / n < F.greatest(F.lit(least_varied), 2 / n)))
    apart, line = F.coalesce(F.col("_low") < F.col("_high"), F.lit(False)), F.col("form") == "continuous"
    x = x.withColumns({"_dull": dull, "_use": F.col("_ok") & ~F.col("_few") & ~dull, "_short": apart & (F.col("_v") <= F.col("_low")), "_long": apart & (F.col("_v") >= F.col("_high"))})
    pct = 100 * (2 * F.col("_upto") - F.col("_r")) / (2 * F.nullif(F.col("_m"), F.lit(0)))
    state = F.when(F.col("raw").isNull(), "missing").when(~F.col("passed"), "filtered_out").when(F.col("_few"), "few_values").when(F.col("_dull"), "uninformative").otherwise("available")
    bucket = F.when(~F.col("_ok") | F.col("_few"), "unavailable").when(F.col("_dull"), "uninformative").when(~line, "discrete").when(F.col("_long"), "long").when(F.col("_short"), "short").otherwise("neutral")
    x = x.withColumns({"value_status": state, "status": F.when(state == "available", F.col("implementation")).otherwise("unavailable"), "weight": F.when(state == "available", F.col("potential")).otherwise(0.0), "pct": F.when(F.col("_use"), pct), "bucket": bucket})
    x = x.withColumns({"score_pct": F.when(line & F.col("_use") & (F.col("bucket") == "neutral"), 50.0).otherwise(F.col("pct")), "filter_status": F.when(F.col("_few"), F.concat("filter_status", F.lit("|cross_section_below_"), F.col("_need").cast("string"))).otherwise(F.col("filter_status"))})
    return x.select("as_of", "symbol", "signal", "raw", "sign", "status", "implementation", "value_status", "source", "formula", "available_at", "age_days", "horizon", "family", "grp", "potential", "weight", "passed", "filter_status", "pct", "score_pct", "bucket")


def capped_shares(df: DataFrame, keys: Sequence[str], amount: str, cap: float) -> DataFrame:
    """`share` of each row in its keys' total, none above `cap`: what a capped row gives up goes to the others by amount.

    Capped rows are the largest: in falling order a row is capped if its part of what the rows before leave is above the cap, and once one isn't, none after it is. Where even
    caps for all don't add up to 1, rows with a positive amount share equally. Rows without a positive amount get 0.
    """
    if not 0 < cap <= 1:
        raise ValueError("cap must be above 0 and at most 1")
    x = df.withColumn("_a", F.greatest(F.coalesce(_number(F.col(amount)), F.lit(0.0)), F.lit(0.0)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_a"))
    whole = Window.partitionBy(*keys)
    x = x.withColumns({"_k": F.row_number().over(w), "_left": F.sum("_a").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)), "_n": F.sum((F.col("_a") > 0).cast("int")).over(whole)})
    x = x.withColumn("_over", (F.col("_a") > 0) & (F.col("_a") / F.nullif(F.col("_left"), F.lit(0.0)) * (1 - (F.col("_k") - 1) * cap) > cap + 1e-12))
    x = x.withColumn("_c", F.sum(F.col("_over").cast("int")).over(whole)).withColumn("_rest", F.sum(F.when(F.col("_k") > F.col("_c"), F.col("_a"))).over(whole))
    share = F.when(F.col("_a") <= 0, 0.0).when(F.col("_n") * cap < 1 - 1e-12, 1.0 / F.nullif(F.col("_n"), F.lit(0))).when(F.col("_k") <= F.col("_c"), cap).otherwise(F.col("_a") / F.nullif(F.col("_rest"), F.lit(0.0)) * (1 - F.col("_c") * cap))
    return x.withColumn("share", F.coalesce(share, F.lit(0.0))).drop("_a", "_k", "_left", "_n", "_over", "_c", "_rest")


def signal_weights(features: DataFrame, multiple: float = 2.0, family_cap: float = 0.15) -> DataFrame:
    """Weights of an as_of and horizon: (signal, grp, family of the group, within, group_weight, family_share, group_signals).

    A signal counts if some row of it has an exact or proxy formula and a positive potential. Its weight is held to `multiple` times the median of its horizon; a redundancy group
    has one vote, the mean weight of its signals, in the family with the most weight in it; families are held to `family_cap`. One row a signal: small beside the features.
    """
    counts = F.col("implementation").isin("exact", "proxy") & (F.col("potential") > 0)
    keys = ["as_of", "horizon"]
    some = F.max(F.when(counts, F.col("potential")))
    named = F.max((F.col("formula") != "").cast("int")) == 1
    m = written(features.groupBy(*keys, "signal", "grp", "family").agg(some.alias("_p"), named.alias("_f")).where("_f and _p is not null"), "strengths")
    m = m.join(m.groupBy(*keys).agg(F.percentile("_p", F.lit(0.5)).alias("_mid")), keys).withColumn("_p", F.least("_p", F.col("_mid") * multiple))
    of = [*keys, "grp"]
    families = m.groupBy(*of, F.coalesce("family", F.lit("")).alias("family")).agg(F.sum("_p").alias("_p"), F.count("*").alias("_n"))
    groups = families.groupBy(*of).agg(F.min_by("family", F.struct(-F.col("_p"), F.col("family"))).alias("group_family"), F.sum("_p").alias("_sum"), F.sum("_n").alias("group_signals")).withColumn("_mean", F.col("_sum") / F.col("group_signals"))
    shares = capped_shares(groups.groupBy(*keys, "group_family").agg(F.sum("_mean").alias("_fam")), keys, "_fam", family_cap)
    groups = groups.join(shares, [*keys, "group_family"]).withColumn("group_weight", F.coalesce(F.col("share") * F.col("_mean") / F.nullif(F.col("_fam"), F.lit(0.0)), F.lit(0.0)))
    x = m.select(*of, "signal", "_p").join(groups, of)
    return x.select(*keys, "signal", "grp", "group_family", (F.col("_p") / F.nullif(F.col("_sum"), F.lit(0.0))).alias("within"), "group_weight", F.col("share").alias("family_share"), "group_signals")


def _weighed(features: DataFrame, multiple: float, family_cap: float) -> DataFrame:
    """Rows of `features` with what they add, null where their signal has no weight; a symbol's rows of a date are together in a task."""
    w = written(signal_weights(features, multiple, family_cap), "weights")
    seen = F.col("status").isin("exact", "proxy") & F.col("score_pct").isNotNull() & (F.col("weight") > 0)
    x = features.select("as_of", "symbol", "horizon", "signal", "grp", seen.alias("observed"), F.when(seen, F.col("score_pct")).otherwise(50.0).alias("counted")).join(w, ["as_of", "horizon", "signal", "grp"], "left")
    x = dealt(x, features.count(), "as_of", "symbol")
    total = F.nullif(F.sum(F.col("within") * F.col("group_weight")).over(Window.partitionBy("as_of", "symbol", "horizon")), F.lit(0.0))
    x = x.withColumn("score_weight", F.col("within") * F.col("group_weight") / total)
    return x.withColumns({"added": F.col("counted") * F.col("score_weight"), "against_neutral": (F.col("counted") - 50) * F.col("score_weight"), "observed_weight": F.col("score_weight") * F.col("observed").cast("int")})


def contributions(features: DataFrame, multiple: float = 2.0, family_cap: float = 0.15) -> DataFrame:
    """What each signal adds to a symbol's raw score, and against a neutral 50; a signal that isn't observed counts 50 and takes confidence away."""
    return _weighed(features, multiple, family_cap).where("group_signals is not null")


def composite_scores(features: DataFrame, least_signals: int = 5, multiple: float = 2.0, family_cap: float = 0.15, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Raw score, its rank from 0 to 100 within an as_of and horizon, and confidence, for every symbol and all of `horizons` (others in the table come too).

    Symbols of a horizon share one set of weights. With fewer than `least_signals` observed there is no score and no confidence; a lone score is 50.
    """
    x = _weighed(features, multiple, family_cap)
    key, part = ["as_of", "symbol", "horizon"], ["as_of", "horizon"]
    used = F.when(F.col("group_signals").isNotNull(), F.col("observed").cast("int"))
    by_group = x.groupBy(*key, "grp").agg(F.sum("added").alias("added"), F.sum("observed_weight").alias("seen"), F.sum(used).alias("used"), F.max("group_signals").alias("expected"), F.max("family_share").alias("family_share"))
    s = by_group.groupBy(*key).agg(F.sum("added").alias("raw_score"), F.sum("seen").alias("_seen"), F.sum("used").alias("signals_used"), F.sum("expected").alias("signals_expected"), F.sum((F.col("used") > 0).cast("int")).alias("groups_used"), F.count("expected").alias("groups_expected"), F.max("family_share").alias("largest_family"))
    enough = F.col("signals_used") >= least_signals
    s = s.withColumns({"raw_score": F.when(enough, F.round("raw_score", 9)), "confidence": F.when(enough, F.least(100 * F.col("_seen"), F.lit(100.0))).otherwise(0.0)}).drop("_seen")
    # a symbol's horizons that its features lack are added where its rows are, without a join
    rest = [c for c in s.columns if c not in key]
    kind = s.schema
    gaps = F.transform(F.array_except(F.array(*map(F.lit, horizons)), F.col("_had.horizon")), lambda h: F.struct(h.alias("horizon"), *[F.lit(None).cast(kind[c].dataType).alias(c) for c in rest]))
    s = s.groupBy("as_of", "symbol").agg(F.collect_list(F.struct("horizon", *rest)).alias("_had")).select("as_of", "symbol", F.explode(F.concat("_had", gaps)).alias("_s")).select("as_of", "symbol", "_s.*")
    s = written(s.where((F.col("groups_expected") > 0) | F.col("horizon").isin(*horizons)), "composites")
    rows = s.count()
    steps = ladder(s, part, "raw_score", F.lit(True), rows)
    totals = written(steps.groupBy(*part).agg(F.sum("_k").alias("_n")), "totals")
    s = on_ladder(s, steps, part, "raw_score", F.col("symbol"), rows).join(totals, part, "left")
    below = F.col("_upto") - F.col("_k") + (F.col("_k") - 1) / 2
    s = s.withColumn("score", F.when(F.col("raw_score").isNotNull(), F.when(F.col("_n") == 1, 50.0).otherwise(100 * below / F.nullif(F.col("_n") - 1, F.lit(0)))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return s.select(*key, "raw_score", "score", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), *[zero(c) for c in ("signals_used", "signals_expected", "groups_used", "groups_expected")], F.coalesce(enough, F.lit(False)).alias("enough"), "largest_family")


def aggregate_scores(scores: DataFrame, required: Sequence[int], least_confidence: float = 30.0) -> DataFrame:
    """Scores over the required horizons by confidence; ranked only with all of them and enough confidence, else with the reason why not."""
    names = sorted(set(required))
    usable = F.col("horizon").isin(*names) & F.col("score").isNotNull() & (F.col("confidence") > 0)
    held = lambda c: F.sum(F.when(usable, F.col(c) * F.col("confidence") / 100)) / F.nullif(F.sum(F.when(usable, F.col("confidence") / 100)), F.lit(0.0))
    used = sum((F.coalesce(F.max(F.when(usable & (F.col("horizon") == h), 1)), F.lit(0)) for h in names), F.lit(0)).cast("long")
    x = scores.groupBy("as_of", "symbol").agg(held("raw_score").alias("raw_score"), held("score").alias("score"), F.coalesce(F.avg(F.when(usable, F.col("confidence"))) * used / len(names), F.lit(0.0)).alias("confidence"), used.alias("horizons_used"))
    reason = F.when(F.col("horizons_used") == 0, "no_usable_horizons").when(F.col("horizons_used") < len(names), "incomplete_horizons").when(F.col("confidence") < least_confidence, "confidence_too_low").otherwise("")
    return x.withColumn("reason", reason).withColumn("ranked", F.col("reason") == "")


def signal_coverage(features: DataFrame) -> DataFrame:
    """By as_of and signal: symbols with an exact or a proxy value, which kind prevails, the share of symbols, sources of values and of gaps."""
    has = F.col("raw").isNotNull()
    kind = lambda k: F.sum((has & (F.col("status") == k)).cast("int"))
    names = lambda where: F.array_join(F.array_sort(F.collect_set(F.when(where & (F.col("source") != ""), F.col("source")))), " | ")
    x = features.groupBy("as_of", "signal").agg(F.first("family").alias("family"), F.count("*").alias("symbols"), kind("exact").alias("exact_rows"), kind("proxy").alias("proxy_rows"), names(has).alias("value_sources"), names(~has).alias("gap_sources"))
    both = F.col("exact_rows") + F.col("proxy_rows")
    main = F.when((F.col("exact_rows") > 0) & (F.col("proxy_rows") > 0), "mixed").when(F.col("exact_rows") > 0, "exact").when(F.col("proxy_rows") > 0, "proxy").otherwise("unavailable")
    return x.withColumns({"coverage": main, "with_value": both, "without": F.col("symbols") - both, "coverage_pct": 100 * both / F.col("symbols")})
