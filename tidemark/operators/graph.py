"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of the links (a, b) and the least node that it is connected to.

    Rounds of large and small stars: each node's greater neighbours go to its least one, then
    each node and its smaller neighbours do; the number of rounds grows with the logarithm of a
    component's size. A node's least neighbour is a partial aggregate, so a hub is combined
    before the shuffle. Links to itself and repeated links count once; null ends are left out.
    """
    pair = lambda df: df.where("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = written(pair(links.select("a", "b")), "links")
    size = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = None
    while before != (held := size(now)):
        before = held
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = pair(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")))
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        now = written(pair(small), "links")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
