"""Operator 8: mix sources to target weights by capped water-filling.

Targets share a multiple of all words by weight; a source stops at `epochs` times
its own size, and what it leaves is shared by the weights of the others until none
is above its cap. With sources in order of cap over weight that level has a closed
form, found by running sums over one row for each source. A source then takes each
of its documents floor(target / size) times, and once more those whose seeded hash
falls into the first bins of 4,096, as many bins as fit into the rest, and into the
one bin after them whose words come nearest to what is then left.
DataFrame functions only.

Nulls and empty texts have size 0 and are taken as often as their source says; a
null source is the last source; rows with equal doc_id are taken alike; an empty
table gives an empty result. `sample` gives back the columns it got, whatever their names; in `mixed` its own
columns (`RESULTS`) stand in place of columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import narrow

WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), (3, 2), 2, "mix-1"
BINS = 4096
RESULTS = ("size", "source_size", "target", "taken", "times")


def sized(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, source, _size, _bin): each row of `docs` as one value, its words and 0 to 4,095 from a seeded MD5 of the id."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.select(F.struct(*docs.columns).alias("_row"), "source", size.alias("_size"), F.conv(F.substring(F.md5(key), 1, 3), 16, 10).cast("int").alias("_bin"))


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(_source, source_size, target, _whole, _cut, _one): what each source takes, from sized documents."""
    bins = sizes.groupBy("source", "_bin").agg(F.sum("_size").alias("s"))  # at most 4,096 rows a source
    sums = bins.groupBy("source").agg(F.sum("s").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # a row for each source
    of = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank - 1) % len(weights) + 1)
    sums = sums.withColumn("w", of.cast("long"))
    num, den = share
    unit = 1
    for w in weights:
        unit *= w
    cap = epochs * F.col("source_size")
    order = Window.orderBy(F.expr(f"source_size * ({unit} div w)"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.withColumns({"left": num * F.sum("source_size").over(every) - den * F.coalesce(F.sum(cap).over(before), F.lit(0)), "open": F.sum("w").over(after), "at": F.row_number().over(order)})
    free = den * cap * F.col("open") > F.col("left") * F.col("w")
    level = F.min(F.when(free, F.struct("at", "left", "open"))).over(every)
    sums = sums.withColumn("level", level)
    fill = F.col("level.left") * F.col("w") / (den * F.col("level.open"))
    sums = sums.withColumn("target", F.coalesce(F.least(cap.cast("double"), fill), cap.cast("double")))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(0)
    sums = sums.withColumn("_whole", whole).withColumn("need", F.col("target") - F.col("_whole") * F.col("source_size"))
    w = Window.partitionBy("source").orderBy("_bin")
    rest = bins.withColumn("upto", F.sum("s").over(w)).join(sums.select(F.col("source").alias("_source"), "need"), F.col("source").eqNullSafe(F.col("_source")))
    fits = F.col("upto") <= F.col("need")
    cut = rest.where("need > 0").groupBy(F.col("source").alias("c")).agg(
        F.coalesce(F.max(F.when(fits, F.col("_bin") + 1)), F.lit(0)).alias("_cut"),
        F.max("need").alias("need"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("got"), F.collect_list(F.when(~fits, F.struct("s", F.col("_bin").alias("b")))).alias("others"),
    )
    gap = F.col("need") - F.col("got")
    best = F.array_min(F.transform("others", lambda x: F.struct(F.abs(x["s"] - gap).alias("off"), x["b"].alias("b"))))
    cut = cut.withColumn("best", best).select("c", "_cut", F.when(F.col("best.off") < gap, F.col("best.b")).alias("_one"))
    done = sums.join(cut, F.col("source").eqNullSafe(F.col("c")), "left")
    return done.select(F.col("source").alias("_source"), "source_size", "target", F.col("_whole").cast("int").alias("_whole"), F.coalesce("_cut", F.lit(0)).alias("_cut"), F.coalesce("_one", F.lit(-1)).alias("_one"))


def _times() -> Column:
    return F.col("_whole") + F.when((F.col("_bin") < F.col("_cut")) | (F.col("_bin") == F.col("_one")), 1).otherwise(0)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """`docs` with size, source_size, target, taken and times."""
    sizes = sized(docs)
    done = sizes.join(narrow(plan(sizes, **options), "plan"), F.col("source").eqNullSafe(F.col("_source")))
    own = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in RESULTS]
    return done.select(*own, F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * _times()).alias("taken"), _times().alias("times"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns it had."""
    sizes = sized(docs)
    done = sizes.join(narrow(plan(sizes, **options), "plan"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("_times", _times())
    return done.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


def sql_ctes(table: str = "documents") -> str:
    """CTEs that end in `mix`: every column of `table`, size, source_size, target, times and taken."""
    digit = lambda k: f"(instr('0123456789abcdef', substr(m, {k}, 1)) - 1)"
    return rf"""
hashed AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS m FROM {table}),
sized AS (SELECT * EXCLUDE (m), 256 * {digit(1)} + 16 * {digit(2)} + {digit(3)} AS bin FROM hashed),
bins AS (SELECT source, bin, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source, bin),
sums AS (SELECT source, CAST(sum(s) AS BIGINT) AS source_size, [3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM bins GROUP BY source),
steps AS (SELECT *, 3 * sum(source_size) OVER () - 2 * coalesce(sum(2 * source_size) OVER (ORDER BY source_size * (6 // w), source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
  sum(w) OVER (ORDER BY source_size * (6 // w), source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
  row_number() OVER (ORDER BY source_size * (6 // w), source ASC NULLS LAST) AS pos FROM sums),
lev AS (SELECT room, open FROM steps WHERE 2 * 2 * source_size * open > room * w ORDER BY pos LIMIT 1),
targets AS (SELECT source, source_size, coalesce(least(CAST(2 * source_size AS DOUBLE), CAST((SELECT room FROM lev) AS DOUBLE) * w / (2 * (SELECT open FROM lev))), CAST(2 * source_size AS DOUBLE)) AS target FROM steps),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 2) ELSE 0 END AS k FROM targets),
past AS (SELECT b.*, sum(s) OVER (PARTITION BY b.source ORDER BY bin) AS upto, target - k * source_size AS need FROM bins b JOIN whole h ON h.source IS NOT DISTINCT FROM b.source),
cuts AS (SELECT source, coalesce(max(CASE WHEN upto <= need THEN bin + 1 END), 0) AS cut, max(need) - coalesce(max(CASE WHEN upto <= need THEN upto END), 0) AS gap FROM past WHERE need > 0 GROUP BY source),
ones AS (SELECT p.source, bin AS one FROM past p JOIN cuts c ON c.source IS NOT DISTINCT FROM p.source WHERE upto > need AND abs(s - gap) < gap
  QUALIFY row_number() OVER (PARTITION BY p.source ORDER BY abs(s - gap), bin) = 1),
mix AS (SELECT z.* EXCLUDE (bin), h.source_size, h.target, h.k + CASE WHEN bin < coalesce(c.cut, 0) OR bin = o.one THEN 1 ELSE 0 END AS times,
  size * (h.k + CASE WHEN bin < coalesce(c.cut, 0) OR bin = o.one THEN 1 ELSE 0 END) AS taken
  FROM sized z JOIN whole h ON h.source IS NOT DISTINCT FROM z.source LEFT JOIN cuts c ON c.source IS NOT DISTINCT FROM z.source LEFT JOIN ones o ON o.source IS NOT DISTINCT FROM z.source)"""


ORACLE = f"WITH {sql_ctes()} SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken FROM mix"
