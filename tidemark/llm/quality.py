"""Operator 4: quality rules with thresholds that adapt to language and source.

Four counts of each text give five metrics. A histogram of each metric for each
(lang, source) is its quantile sketch: buckets of a fixed width, so sketches merge
by adding counts and the result is the same in any order. The fence of a metric is
median + 3 (third - first quartile) + slack. The fence of a group of n documents is the mean of its own, weighing n, and
its language's, weighing 100; a language's is drawn to the corpus's in the same way. So small groups lean on
larger ones and no verdict jumps at a size. A document beyond a fence is rejected. DataFrame functions only.

Nulls and texts without words fail the base rule (under 50 words); null lang or
source are groups of their own; ties share a bucket; repeated rows count as often
as they occur; an empty table gives an empty result. `kept` gives back the columns it got, whatever their names;
`verdicts` has doc_id, lang and source beside its own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import narrow, written

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Buckets are integers up to this one, which also holds all beyond it.
TOP = 4000
#: Metric: the least distance between its median and its upper fence. Per 1,000 words, lines, words, characters; word length in hundredths.
SLACK = {"symbols": 100, "dup_lines": 500, "repeats": 250, "capitals": 200, "word_length": 150}
SPREAD = 3
#: Documents that the fence of the wider group weighs as.
PRIOR = 100.0


def _without(text: Column, drop: str) -> Column:
    return F.length(F.translate(text, drop, ""))


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the metrics, as columns prefixed `_` where they are not in the contract."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.size("_w")
    df = docs.withColumns({"_w": F.array_remove(F.split(text, r"[ \t-\r]+"), "")})
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, BLANKS) > 0)
    df = df.withColumns({
        "_h": F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))),
        "_l": lines,
    })
    twice = F.size("_h") > F.size(F.array_distinct("_h"))
    df = df.withColumn("_s", F.when(twice, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda x, k: F.coalesce(F.get("_s", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", near), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": _without(text, BLANKS).cast("long"),
        "n_symbols": (F.length(text) - _without(text, SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "_lines": F.size("_l").cast("long"),
        "_capitals": (F.length(text) - _without(text, CAPITALS)).cast("long"),
    })
    return df.drop("_w", "_h", "_s", "_p", "_l")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def metrics() -> dict[str, Column]:
    """Integer buckets of the five metrics."""
    per = lambda a, b, k: F.least(F.lit(TOP), F.expr(f"({k} * {a}) div greatest({b}, 1)"))
    return {
        "symbols": per("n_symbols", "n_words", 1000),
        "dup_lines": per("n_dup_lines", "_lines", 1000),
        "repeats": per("n_repeat_words", "n_words", 1000),
        "capitals": per("_capitals", "word_chars", 1000),
        "word_length": per("word_chars", "n_words", 100),
    }


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): histograms over the documents that pass the base rule."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("int").alias("bucket")) for k, v in metrics().items()]))
    return counted.where(~base_failed()).select("lang", "source", each.alias("m")).groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Upper and lower fence of each metric for each group of `keys`, from the merged sketches, as columns hi_, lo_ and n."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "all": F.sum("n").over(w)})
    at = lambda p: F.min(F.when(4 * F.col("upto") >= p * F.col("all"), F.col("bucket")))
    q = ranked.groupBy(*keys, "metric").agg(at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"), F.max("all").alias("n"))
    slack = F.coalesce(*[F.when(F.col("metric") == k, F.lit(v)) for k, v in SLACK.items()])
    reach = SPREAD * (F.col("q3") - F.col("q1")) + slack
    q = q.withColumns({"hi": F.col("q2") + reach, "lo": F.col("q2") - reach})
    pick = lambda c, k: F.max(F.when(F.col("metric") == k, F.col(c)))
    out = [pick("hi", k).alias(f"hi_{k}") for k in SLACK] + [pick("lo", "word_length").alias("lo_word_length")]
    return q.groupBy(*keys).agg(F.max("n").alias("n"), *out)


def thresholds(counted: DataFrame) -> DataFrame:
    """One row for each (lang, source) of the table: its fences, drawn to its language's and the corpus's."""
    sketch = sketches(counted)
    own, lang, top = fences(sketch, ["lang", "source"]), fences(sketch, ["lang"]), fences(sketch, [])
    cols = [c for c in own.columns if c not in ("lang", "source", "n")]
    pairs = counted.select("lang", "source").distinct().alias("p")
    same = lambda a, b, k: F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    joined = pairs.join(own.alias("o"), same("p", "o", "lang") & same("p", "o", "source"), "left").join(lang.alias("l"), same("p", "l", "lang"), "left").join(F.broadcast(top.alias("t")), F.lit(True), "left")  # top has one row
    blend = lambda s, c, wide: F.when(F.col(f"{s}.n").isNull(), wide).otherwise((F.col(f"{s}.n").cast("double") * F.col(f"{s}.{c}").cast("double") + PRIOR * wide) / (F.col(f"{s}.n").cast("double") + PRIOR))
    pick = lambda c: blend("o", c, blend("l", c, F.col(f"t.{c}").cast("double")))
    return joined.select(F.col("p.lang").alias("_lang"), F.col("p.source").alias("_source"), *[pick(c).alias(f"_{c}") for c in cols])


def judged(counted: DataFrame) -> DataFrame:
    """A written table of counts with base_failed and kept."""
    fence = narrow(thresholds(counted), "fences")
    df = counted.join(fence, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    m = metrics()
    inside = F.lit(True)
    for k in SLACK:
        inside = inside & F.coalesce(m[k] <= F.col(f"_hi_{k}"), F.lit(True))
    inside = inside & F.coalesce(m["word_length"] >= F.col("_lo_word_length"), F.lit(True))
    df = df.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & inside})
    return df.drop(*[c for c in df.columns if c.startswith("_") and c != "_row"])


def verdicts(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document."""
    return judged(written(counts(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality"))


def kept(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they had; these travel as one value, so that no name can clash."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text", "lang", "source")
    return judged(written(counts(rows).drop("text"), "quality")).where("kept").select("_row.*")


_METRIC_SQL = """
  LEAST(4000, (1000 * n_symbols) // GREATEST(n_words, 1)) AS m_symbols,
  LEAST(4000, (1000 * n_dup_lines) // GREATEST(n_lines, 1)) AS m_dup_lines,
  LEAST(4000, (1000 * n_repeat_words) // GREATEST(n_words, 1)) AS m_repeats,
  LEAST(4000, (1000 * capitals) // GREATEST(word_chars, 1)) AS m_capitals,
  LEAST(4000, (100 * word_chars) // GREATEST(n_words, 1)) AS m_word_length"""


def sql_ctes(table: str = "documents") -> str:
    """CTEs that end in `verdict`: every column of `table`, the counts, base_failed and kept."""
    level = lambda keys: f"""
 SELECT {keys + ',' if keys else ''} metric, max(n) AS n, max(CASE WHEN upto * 4 >= n * 2 AND (upto - c) * 4 < n * 2 THEN bucket END) AS q2,
   min(CASE WHEN upto * 4 >= n THEN bucket END) AS q1, min(CASE WHEN upto * 4 >= n * 3 THEN bucket END) AS q3
 FROM (SELECT {keys + ',' if keys else ''} metric, bucket, count(*) AS c, sum(count(*)) OVER (PARTITION BY {keys + ',' if keys else ''} metric ORDER BY bucket) AS upto,
   sum(count(*)) OVER (PARTITION BY {keys + ',' if keys else ''} metric) AS n FROM points GROUP BY {keys + ',' if keys else ''} metric, bucket)
 GROUP BY {keys + ',' if keys else ''} metric"""  # noqa: E731
    slack = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SLACK.items())
    reach = f"({SPREAD} * (q3 - q1) + CASE metric {slack} END)"
    fenced = lambda table, keys: f"SELECT {keys} metric, CAST(n AS DOUBLE) AS n, CAST(q2 + {reach} AS DOUBLE) AS hi, CAST(q2 - {reach} AS DOUBLE) AS lo FROM {table}"
    prior = f"CAST({PRIOR} AS DOUBLE)"
    wide = lambda c: f"CASE WHEN g.n IS NULL THEN t.{c} ELSE (g.n * g.{c} + {prior} * t.{c}) / (g.n + {prior}) END"
    blended = lambda c: f"CASE WHEN o.n IS NULL THEN {wide(c)} ELSE (o.n * o.{c} + {prior} * ({wide(c)})) / (o.n + {prior}) END"
    return rf"""
src AS (SELECT *, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM {table}),
each AS (SELECT rid, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM src),
threes AS (SELECT rid, i, a, lead(a) OVER d AS b, lead(a, 2) OVER d AS c FROM each WINDOW d AS (PARTITION BY rid ORDER BY i)),
grams AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS c FROM threes WHERE c IS NOT NULL),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM grams, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY rid),
counted AS (SELECT src.* EXCLUDE (w, l), CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS BIGINT) AS capitals
  FROM src LEFT JOIN covered USING (rid)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,{_METRIC_SQL} FROM counted),
points AS (SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'capitals', 'word_length']) AS metric,
  unnest([m_symbols, m_dup_lines, m_repeats, m_capitals, m_word_length]) AS bucket FROM based WHERE NOT base_failed),
own AS ({level('lang, source')}), langs AS ({level('lang')}), tops AS ({level('')}),
own_f AS ({fenced('own', 'lang, source,')}), langs_f AS ({fenced('langs', 'lang,')}), tops_f AS ({fenced('tops', '')}),
metric_names AS (SELECT DISTINCT metric FROM points),
chosen AS (SELECT p.lang, p.source, m.metric, {blended('hi')} AS hi, {blended('lo')} AS lo
  FROM (SELECT DISTINCT lang, source FROM based) p CROSS JOIN metric_names m
  LEFT JOIN own_f o ON o.lang IS NOT DISTINCT FROM p.lang AND o.source IS NOT DISTINCT FROM p.source AND o.metric = m.metric
  LEFT JOIN langs_f g ON g.lang IS NOT DISTINCT FROM p.lang AND g.metric = m.metric LEFT JOIN tops_f t ON t.metric = m.metric),
fence AS (SELECT lang, source, {', '.join(f"max(CASE WHEN metric = '{k}' THEN hi END) AS hi_{k}" for k in SLACK)},
  max(CASE WHEN metric = 'word_length' THEN lo END) AS lo_word_length FROM chosen GROUP BY lang, source),
verdict AS (SELECT b.*, NOT base_failed AND {' AND '.join(f"coalesce(m_{k} <= hi_{k}, true)" for k in SLACK)} AND coalesce(m_word_length >= lo_word_length, true) AS kept
  FROM based b LEFT JOIN fence f ON f.lang IS NOT DISTINCT FROM b.lang AND f.source IS NOT DISTINCT FROM b.source)"""


ORACLE = f"WITH {sql_ctes()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdict"
