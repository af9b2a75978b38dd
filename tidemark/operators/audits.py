"""Logs whose entries carry the hash of the entry before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the first entry of a chain has in place of a hash before it.
GENESIS = "0" * 64


def entry_hash(prior: Column, payload: list[Column]) -> Column:
    """SHA-256 over the hash before and the fields, each with its length, so that no two entries read alike; a null is a dash."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in payload]
    return F.sha2(F.concat(F.coalesce(prior, F.lit("")), *told), 256)


def checked_chain(entries: DataFrame, chain: str, seq: str, payload: list[str]) -> DataFrame:
    """Every entry (chain, seq, payload, prior_hash, this_hash) with what is wrong with it: payload, link, or null.

    Entries are recomputed where they lie and meet their predecessor by (chain, seq - 1), so a chain
    is not walked and its length does not matter. An entry whose predecessor is missing, or
    hashes to something else, has a broken link; entry 0 follows GENESIS. Of entries of one number
    all are compared with all of the number before; each but the first is wrong too (repeated). Null chains are one chain.
    """
    key = F.struct(F.col(chain).alias("c"))
    own = entries.withColumn("_at", F.struct(key.alias("k"), F.col(seq).cast("long").alias("s")))
    before = entries.groupBy(F.struct(key.alias("k"), (F.col(seq).cast("long") + 1).alias("s")).alias("_at")).agg(F.collect_set("this_hash").alias("_before"), F.count("*").alias("_n"))
    twice = entries.groupBy(F.struct(key.alias("k"), F.col(seq).cast("long").alias("s")).alias("_at")).agg(F.count("*").alias("_own"))
    found = own.join(before, "_at", "left").join(twice, "_at")
    follows = F.when(F.col(seq) == 0, F.col("prior_hash") == GENESIS).otherwise(F.array_contains("_before", F.col("prior_hash")))
    fault = F.when(~F.coalesce(follows, F.lit(False)), "link").when(~F.col("this_hash").eqNullSafe(entry_hash(F.col("prior_hash"), [F.col(c) for c in payload])), "payload").when(F.col("_own") > 1, "repeated")
    return found.select(*entries.columns, fault.alias("fault"))


def verified_chains(entries: DataFrame, chain: str, seq: str, payload: list[str]) -> DataFrame:
    """(chain, n_events, ok, broken, fault): the first entry of each chain that is wrong, as the least number of one."""
    x = checked_chain(entries, chain, seq, payload)
    first = F.min(F.when(F.col("fault").isNotNull(), F.struct(F.col(seq).cast("long").alias("s"), F.col("fault").alias("f"))))
    return x.groupBy(chain).agg(F.count("*").alias("n_events"), first.alias("b")).select(chain, "n_events", F.col("b").isNull().alias("ok"), F.col("b.s").alias("broken"), F.col("b.f").alias("fault"))


def chained(rows: DataFrame, chain: str, order: list[str], payload: list[str]) -> DataFrame:
    """(chain, seq, payload, prior_hash, this_hash) of rows in order: a chain is written one entry after the other, so each is one array."""
    fields = F.struct(*order, *[F.col(c).alias(f"_p{i}") for i, c in enumerate(payload)])
    kinds = ", ".join(f"{c}: {rows.schema[c].dataType.simpleString()}" for c in payload)
    zero = F.struct(F.lit(GENESIS).alias("h"), F.array().cast(f"array<struct<p: struct<{kinds}>, prior_hash: string, this_hash: string>>").alias("out"))

    def step(held: Column, x: Column) -> Column:
        own = [x[f"_p{i}"] for i in range(len(payload))]
        new = entry_hash(held["h"], own)
        entry = F.struct(F.struct(*[c.alias(n) for c, n in zip(own, payload, strict=True)]).alias("p"), held["h"].alias("prior_hash"), new.alias("this_hash"))
        return F.struct(new.alias("h"), F.concat(held["out"], F.array(entry)).alias("out"))

    g = rows.groupBy(chain).agg(F.array_sort(F.collect_list(fields)).alias("rows"))
    return g.select(chain, F.posexplode(F.aggregate("rows", zero, step)["out"]).alias("seq", "e")).select(chain, F.col("seq").cast("long").alias("seq"), "e.p.*", "e.prior_hash", "e.this_hash")
