"""Text and reconciliation queries and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import texts as t
from tidemark.plans.market import _r
from tidemark.sources.derived import read

UP, DOWN = ["the", "tion"], ["der", "les"]


def _priced(s, d):
    x = lambda c: F.col(c).cast("double")
    return read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(x("l_extendedprice") * (1 - x("l_discount")) * (1 + x("l_tax"))).alias("price"))


def _booked(s, d):
    return read(s, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"))


QUERIES = {
    "lexicon_sentiment": lambda s, d: _r(t.sentiment(read(s, d, "documents"), UP, DOWN), "doc_id", sentiment="sentiment"),
    "word_entropy": lambda s, d: _r(t.word_entropy(read(s, d, "documents"), "source"), "source", "n", "distinct", entropy="entropy"),
    "reconciled_orders": lambda s, d: t.reconciled(_booked(s, d), _priced(s, d), "o_orderkey", "price", 1.0).select("o_orderkey", "status", F.round("gap", 3).alias("gap"), F.round("price", 3).alias("price")),
}

_COUNT = lambda words: " + ".join(f"(length(x) - length(replace(x, '{w}', ''))) / {len(w)}.0" for w in words)

ORACLE = {
    "lexicon_sentiment": f"WITH l AS (SELECT doc_id, lower(text) AS x FROM documents), c AS (SELECT doc_id, {_COUNT(UP)} AS p, {_COUNT(DOWN)} AS n FROM l) SELECT doc_id, round(coalesce((p - n) / nullif(p + n, 0), 0), 6) AS sentiment FROM c",
    "word_entropy": "WITH w AS (SELECT source, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents), c AS (SELECT source, word, CAST(count(*) AS DOUBLE) AS c FROM w WHERE word <> '' GROUP BY ALL) SELECT source, CAST(sum(c) AS BIGINT) AS n, count(*) AS \"distinct\", round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM c GROUP BY source",
    "reconciled_orders": "WITH b AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS DOUBLE)) * (1 + CAST(l_tax AS DOUBLE))) AS p FROM lineitem GROUP BY 1), j AS (SELECT coalesce(o_orderkey, k) AS o_orderkey, CAST(o_totalprice AS DOUBLE) AS a, p FROM orders FULL JOIN b ON o_orderkey = k) SELECT o_orderkey, CASE WHEN a IS NULL THEN 'second_only' WHEN p IS NULL THEN 'first_only' WHEN abs(a - p) <= 1 THEN 'match' ELSE 'differs' END AS status, round(abs(a - p), 3) AS gap, round(coalesce(a, p), 3) AS price FROM j",
}
