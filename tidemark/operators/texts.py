"""Texts by group: lexicon sentiment and word entropy; and two sources of one figure against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hits(text: Column, words: list[str]) -> Column:
    """Occurrences of the words as substrings, those of one word not overlapping."""
    return sum(((F.length(text) - F.length(F.replace(text, F.lit(w)))) / len(w) for w in words), F.lit(0.0))


def sentiment(docs: DataFrame, positive: list[str], negative: list[str], text: str = "text") -> DataFrame:
    """`docs` with (positive - negative) / (positive + negative) hits in the lower-cased text; 0 without hits or text."""
    low = F.lower(text)
    p, n = _hits(low, positive), _hits(low, negative)
    return docs.withColumn("sentiment", F.coalesce((p - n) / F.nullif(p + n, F.lit(0.0)), F.lit(0.0)))


def word_entropy(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Shannon entropy in bits of the words of each group. Counts by group and word are partly summed before they are shuffled."""
    words = docs.select(by, F.explode(F.split(F.lower(text), "[^a-z]+")).alias("word")).where("word != ''")
    counts = words.groupBy(by, "word").agg(F.count("*").cast("double").alias("c"))
    total = F.sum("c")
    return counts.groupBy(by).agg(total.cast("long").alias("n"), F.count("*").alias("distinct"), (F.log2(total) - F.sum(F.col("c") * F.log2("c")) / total).alias("entropy"))


def reconciled(first: DataFrame, second: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """(key, status, gap, value): the sources match within an absolute tolerance, differ, or one alone has the key; the first one's value wins."""
    a, b = first.select(key, F.col(value).alias("_a")), second.select(key, F.col(value).alias("_b"))
    gap = F.abs(F.col("_a") - F.col("_b"))
    status = F.when(F.col("_a").isNull(), "second_only").when(F.col("_b").isNull(), "first_only").when(gap <= tolerance, "match").otherwise("differs")
    return a.join(b, key, "full_outer").select(key, status.alias("status"), gap.alias("gap"), F.coalesce("_a", "_b").alias(value))
