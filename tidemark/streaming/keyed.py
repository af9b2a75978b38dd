"""State by key on streams: rows newer than all before, the last rows, silences and sessions.

Streams are rows (symbol, arrival, ts, ...). Within a micro-batch a key's rows are taken by
arrival, so what comes out does not depend on where batches are cut. State is in RocksDB, so a key's state may be larger
than memory is, and is read again from the checkpoint after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _by_arrival(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(["arrival", "ts"], kind="stable").reset_index(drop=True)


class _Newer(StatefulProcessor):
    """Passes the rows with a time above all times before them; its state is that time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        x = _by_arrival(rows)
        x = x[x["ts"].notna()]
        us = x["ts"].astype("datetime64[us]").astype("int64")
        before = self.last.get()[0] if self.last.exists() else None
        past = us.cummax().shift(1)
        if before is not None:
            past = past.fillna(before).clip(lower=before)
        new = past.isna() | (us > past)
        if new.any():
            self.last.update((int(us[new].max()),))
            yield x[new]

    def close(self) -> None:
        pass


def newer_rows(stream: DataFrame, key: str = "symbol") -> DataFrame:
    """Rows later than every row of their key that came before; late rows and repeats go, as do rows without a time."""
    return stream.groupBy(key).transformWithStateInPandas(_Newer(), stream.schema, "append", "none")


class _Last(StatefulProcessor):
    """Keeps the n rows of a key with the greatest (ts, arrival), one for each arrival, and gives them all when one of them is new."""

    def __init__(self, n: int, schema: str):
        self.n, self.schema = n, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.schema)
        self.version = handle.getValueState("version", "v long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        x = _by_arrival(rows)
        names = list(x.columns)
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        both = pd.concat([pd.DataFrame(held, columns=names), x], ignore_index=True) if held else x
        both = both[both["ts"].notna()].drop_duplicates("arrival").sort_values(["ts", "arrival"]).tail(self.n).reset_index(drop=True)
        if not len(both) or set(both["arrival"]) == {r[names.index("arrival")] for r in held}:
            return
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        self.rows.put([tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in both.astype(object).itertuples(index=False, name=None)])
        yield both.assign(version=version)

    def close(self) -> None:
        pass


def last_buffer(stream: DataFrame, n: int, key: str = "symbol") -> DataFrame:
    """(rows, version): a key's last n rows by time whenever they change; the greatest version of a key is what holds."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)
    return stream.groupBy(key).transformWithStateInPandas(_Last(n, kind), f"{kind}, version long", "append", "none")


class _Silence(StatefulProcessor):
    """Says once for each silence longer than a gap when it began, when the watermark has passed its gap, so that no late row can fill it.

    Its state: the last time that the watermark has passed, whether the silence after it was told, and the times that are still open.
    """

    def __init__(self, key: str, gap_ms: int):
        self.key, self.gap = key, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, told boolean")
        self.open = handle.getListState("open", "ms long")

    def _settled(self, key, times: list[int], now: int) -> pd.DataFrame:
        last, told = self.last.get() if self.last.exists() else (None, True)
        out, rest = [], []
        for t in sorted(times):
            if t > now:
                rest.append(t)
            elif last is None or t > last:
                if not told and t - last > self.gap:
                    out.append(last)
                last, told = t, False
        if not told and last + self.gap <= now:
            out.append(last)
            told = True
        if last is not None:
            self.last.update((last, told))
        if rest:
            self.open.put([(t,) for t in rest])
        else:
            self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        wait = rest[:1] + ([] if told else [last + self.gap])
        if wait:
            self.handle.registerTimer(min(wait))
        return pd.DataFrame({self.key: [key[0]] * len(out), "last": pd.to_datetime(out, unit="ms")})

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        ms = _by_arrival(rows)["ts"].dropna().astype("datetime64[ms]").astype("int64").tolist()
        held = [r[0] for r in self.open.get()] if self.open.exists() else []
        yield self._settled(key, held + ms, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        held = [r[0] for r in self.open.get()] if self.open.exists() else []
        yield self._settled(key, held, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def silences(stream: DataFrame, gap_s: int, late: str, key: str = "symbol") -> DataFrame:
    """(symbol, last): the last row before each silence of a key that is longer than the gap, in whole milliseconds.

    A key that falls idle is found by the watermark, which other keys drive. Rows must come in order of time to within `late`.
    """
    kind = stream.schema[key].dataType.simpleString()
    return stream.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(_Silence(key, gap_s * 1000), f"{key} {kind}, last timestamp", "append", "eventTime")


def sessions(stream: DataFrame, gap: str, late: str, key: str = "symbol", row: str = "seq") -> DataFrame:
    """(symbol, start, last, n, volume) of the sessions that the watermark has closed; rows that repeat within `late` count once."""
    x = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key, row])
    g = x.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.max("ts").alias("last"), F.count("*").alias("n"), F.sum("size").alias("volume"))
    return g.select(key, F.col("w.start").alias("start"), "last", "n", "volume")


def run_now(result: DataFrame, out: str, state: str) -> None:
    """Take a stream through what its source holds now, from the checkpoint `state` on; a batch that is run again overwrites its own folder."""

    def sink(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/k={k}")

    spark = result.sparkSession
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        result.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)


def collected(spark: SparkSession, out: str, schema) -> DataFrame:
    """All that `run_now` has written."""
    return spark.read.schema(schema).parquet(f"{out}/k=*")


def newest_buffer(rows: DataFrame, key: str = "symbol") -> DataFrame:
    """Of the buffers of `last_buffer` the last of each key."""
    return rows.withColumn("_v", F.max("version").over(Window.partitionBy(key))).where("version = _v").drop("_v", "version")
