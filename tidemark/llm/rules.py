"""Operator 10: a quality classifier that is a sparse ensemble of rules.

A shallow random forest on text statistics gives its paths as conjunctions of
thresholds; a lasso logistic regression over these rules keeps a few; the kept
rules, their weights and the intercept are compiled into one column expression, so
scoring is a map in the JVM. Inputs are statistics of the text alone.

At most `SAMPLE` labelled rows are fitted, those with the least seeded hash; all
documents are scored. Without labels, or with one class, every score is the share
of label 1 (0.5 without any). Null and empty texts have statistics of 0 and are
scored too; null labels are left out; repeated rows count as often as they occur.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.quality import counts
from tidemark.llm.shared import written

SAMPLE, TREES, DEPTH, PENALTY, SEED = 20_000, 24, 3, 0.002, 7
CUT = 0.7
#: Statistic: numerator, denominator. Denominators below 1 count as 1.
RATIOS = {
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("_capitals", "word_chars"),
    "distinct": ("_distinct", "n_words"),
    "points": ("_points", "n_words"),
    "bangs": ("_bangs", "n_words"),
    "digits": ("_digits", "word_chars"),
    "line_words": ("n_words", "_lines"),
}
NAMES = ["words", *RATIOS]


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the statistics as columns prefixed `x_`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = lambda drop: F.length(text) - F.length(F.translate(text, drop, ""))
    own = docs.columns
    df = counts(docs, text_col).withColumns({
        "_distinct": F.size(F.array_distinct(F.array_remove(F.split(text, r"[ \t-\r]+"), ""))),
        "_points": n(".,;:?"), "_bangs": n("!"), "_digits": n("0123456789"),
    })
    df = df.withColumns({"x_words": F.log1p(F.col("n_words").cast("double"))} | {f"x_{k}": F.col(a) / F.greatest(F.col(b), F.lit(1)) for k, (a, b) in RATIOS.items()})
    return df.select(*own, *[f"x_{k}" for k in NAMES])


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def paths(tree: str) -> list[tuple[tuple[int, bool, float], ...]]:
    """Conjunctions (feature, at most?, threshold) on the way to every node of a tree's description."""
    out, stack = [], []
    for line in tree.splitlines():
        m = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line)
        if m:
            depth = len(m[1])
            stack = [x for x in stack if x[0] < depth]
            stack.append((depth, (int(m[3]), m[4] == "<=", float(m[5]))))
            out.append(tuple(x[1] for x in stack))
    return out


def tightened(rule: tuple[tuple[int, bool, float], ...]) -> tuple[tuple[int, bool, float], ...]:
    """The same conjunction with one bound for each feature and side, in order."""
    best: dict[tuple[int, bool], float] = {}
    for k, low, t in rule:
        best[k, low] = (min if low else max)(best.get((k, low), t), t)
    return tuple(sorted((k, low, t) for (k, low), t in best.items()))


def condition(rule: tuple[tuple[int, bool, float], ...]) -> Column:
    out = F.lit(True)
    for k, low, t in rule:
        x = F.col(f"x_{NAMES[k]}")
        out = out & ((x <= t) if low else (x > t))
    return out


class RuleModel:
    """An intercept and weighted rules."""

    def __init__(self, intercept: float, rules: list[tuple[float, tuple]]):
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for w, rule in self.rules:
            total = total + F.when(condition(rule), w).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{NAMES[k]} {'<=' if low else '>'} {t:.4g}" for k, low, t in rule) for w, rule in self.rules]


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id") -> RuleModel:
    """Fit on labelled rows that are not held out, at most SAMPLE of them."""
    import math

    some = labels.where(F.col(target).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    some = some.orderBy(F.xxhash64(F.lit(SEED), F.col(id_col)), id_col).limit(SAMPLE).select(F.col(id_col).alias("_id"), F.col(target).cast("double").alias("label"))
    # at most SAMPLE rows of two numbers: its size is bounded
    rows = statistics(docs.select(id_col, "text").join(F.broadcast(some), F.col(id_col) == F.col("_id")).select(id_col, "text", "label"))
    rows = VectorAssembler(inputCols=[f"x_{k}" for k in NAMES], outputCol="features").transform(written(rows.drop("text").repartition(4), "rules")).select("label", "features", *[f"x_{k}" for k in NAMES])
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if n == 0 or ones in (0, n):
        share = 0.5 if n == 0 else min(max(ones / n, 1e-6), 1 - 1e-6)
        return RuleModel(math.log(share / (1 - share)), [])
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(rows)
    rules = sorted({tightened(r) for tree in forest.trees for r in paths(tree.toDebugString)})
    fired = [F.when(condition(r), 1.0).otherwise(0.0).alias(f"r{k}") for k, r in enumerate(rules)]
    table = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="fired").transform(rows.select("label", *fired)).select("label", "fired").cache()
    lasso = LogisticRegression(featuresCol="fired", elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60).fit(table)
    table.unpersist()
    kept = [(float(w), r) for w, r in zip(lasso.coefficients, rules, strict=True) if w]
    return RuleModel(float(lasso.intercept), kept)


def scored(docs: DataFrame, model: RuleModel, id_col: str = "doc_id") -> DataFrame:
    """`docs` with held_out, score and predicted in place of columns of these names."""
    own = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    df = statistics(docs.select(F.struct(*docs.columns).alias("row"), "text")).withColumn("score", model.score())
    return df.select(*[F.col(f"row.`{c}`") for c in own], held_out(f"row.`{id_col}`").alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
