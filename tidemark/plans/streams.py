"""Stream queries, each fed in parts with a restart from its checkpoint after each, and the SQL of the table that they must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.common import place, written
from tidemark.sources.derived import TICKS_SQL, ticks
from tidemark.streaming import keyed

PARTS, LAST, GAP = 3, 20, 6 * 3600


def _arrivals(s, d):
    """Ticks as they come in: every fifth late, every ninth twice."""
    at = F.col("seq") * 8 + F.when(F.col("seq") % 5 == 0, 57).otherwise(0)
    x = ticks(s, d).select("symbol", "seq", F.col("ts").cast("timestamp").alias("ts"), "size")
    return x.select("symbol", F.explode(F.when(F.col("seq") % 9 == 0, F.array(at, at + 30)).otherwise(F.array(at))).alias("arrival"), "seq", "ts", "size")


def _fed(s, d, fn):
    """What a stream over the arrivals gives when it is stopped and started again between parts of them."""
    x = written(_arrivals(s, d), "arrivals")
    top = x.agg(F.max("arrival")).first()[0] or 0
    source, out, state = place(s, "source"), place(s, "found"), place(s, "state")
    for p in range(PARTS):
        x.where(F.floor(F.col("arrival") * PARTS / (top + 1)) == p).write.mode("append").parquet(source)
        found = fn(s.readStream.schema(x.schema).parquet(source))
        keyed.run_now(found, out, state)
    return keyed.collected(s, out, found.schema)


def _newer(s, d):
    return _fed(s, d, keyed.newer_rows).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"), F.max("arrival").alias("last"))


def _sessions(s, d):
    x = _fed(s, d, lambda q: keyed.sessions(q, "2 hours", "1 day"))
    return x.select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), "n", "volume")


QUERIES = {
    "stream_newer": _newer,
    "stream_last": lambda s, d: keyed.newest_buffer(_fed(s, d, lambda q: keyed.last_buffer(q, LAST))).select("symbol", "arrival", "seq", "size"),
    "stream_silences": lambda s, d: _fed(s, d, lambda q: keyed.silences(q, GAP, "1 day")).select("symbol", F.unix_millis("last").alias("last")),
    "stream_sessions": _sessions,
}

_ARRIVALS = f"""{TICKS_SQL}, t0 AS (SELECT symbol, seq, ts, size, seq * 8 + CASE WHEN seq % 5 = 0 THEN 57 ELSE 0 END AS a FROM ticks),
ar AS (SELECT symbol, a AS arrival, seq, ts, size FROM t0 UNION ALL SELECT symbol, a + 30, seq, ts, size FROM t0 WHERE seq % 9 = 0), wm AS (SELECT epoch_us(max(ts)) // 1000 - 86400000 AS ms FROM ar)"""

ORACLE = {
    "stream_newer": f"WITH {_ARRIVALS}, p AS (SELECT *, max(ts) OVER (PARTITION BY symbol ORDER BY arrival, ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM ar) SELECT symbol, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs, max(arrival) AS last FROM p WHERE past IS NULL OR ts > past GROUP BY symbol",
    "stream_last": f"WITH {_ARRIVALS} SELECT symbol, arrival, seq, size FROM ar QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, arrival DESC) <= {LAST}",
    "stream_silences": f"WITH {_ARRIVALS}, m AS (SELECT DISTINCT symbol, epoch_us(ts) // 1000 AS ms FROM ar), n AS (SELECT *, lead(ms) OVER (PARTITION BY symbol ORDER BY ms) AS next FROM m) SELECT symbol, n.ms AS last FROM n, wm WHERE (next IS NULL OR next - n.ms > {GAP * 1000}) AND n.ms + {GAP * 1000} <= wm.ms",
    "stream_sessions": f"""WITH {_ARRIVALS}, u AS (SELECT DISTINCT symbol, seq, ts, size FROM ar), g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 7200000000 THEN 1 ELSE 0 END AS n FROM u WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
k AS (SELECT *, sum(n) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT symbol, min(ts) AS start, count(*) AS n, CAST(sum(size) AS BIGINT) AS volume FROM k, wm GROUP BY symbol, k.k, wm.ms HAVING epoch_us(max(ts)) + 7200000000 <= wm.ms * 1000""",
}
