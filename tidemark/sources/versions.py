"""Partitioned tables, cleaned prices, tiers, and versions of tables that are written once and read by version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.contracts import content_hash


def write_partitioned(df: DataFrame, path: str, ts: str, by: list[str]) -> None:
    """Hive partitions of the year (from the timestamp where the table has none) and other columns; a rerun replaces only the partitions it has."""
    if "year" not in df.columns:
        df = df.withColumn("year", F.year(ts))
    df.repartition("year", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", *by).parquet(path)


def read_partitioned(spark: SparkSession, path: str, **wanted: list) -> DataFrame:
    """Partitions whose values are among those wanted; the rest is never opened."""
    df = spark.read.parquet(path)
    for name, values in wanted.items():
        df = df.where(F.col(name).isin(values))
    return df


def partitions(df: DataFrame, by: list[str]) -> DataFrame:
    """One row for each combination of partition values."""
    return df.select(*by).distinct()


def normal_bars(df: DataFrame, ts: str) -> DataFrame:
    """Lower-case names, the six columns of a bar in order, numbers where the text is one."""
    df = df.toDF(*[c.lower() for c in df.columns])
    return df.select("symbol", F.to_timestamp(F.col(ts.lower()).cast("string")).alias("timestamp"), *[F.expr(f"try_cast({c} AS double)").alias(c) for c in ("open", "high", "low", "close")], F.expr("try_cast(try_cast(volume AS double) AS bigint)").alias("volume"))


def clean_prices(df: DataFrame, key: str, ts: str, order: str, value: str, start: str, end: str) -> DataFrame:
    """The last row of each key and time without a null value, within the dates."""
    rest = [c for c in df.columns if c not in (key, ts)]
    x = df.where(F.col(value).isNotNull() & F.col(ts).between(start, end))
    return x.groupBy(key, ts).agg(F.max_by(F.struct(*rest), F.struct(order, value)).alias("m")).select(key, ts, *[F.col(f"m.{c}").alias(c) for c in rest])


def tier(ts: Column, cuts: list[tuple[str, str]]) -> Column:
    """The name of the first (name, first day after it) that a day lies before; FORWARD beyond all. Times of a day share its tier."""
    day, out = F.to_date(ts), F.lit("FORWARD")
    for name, cut in reversed(cuts):
        out = F.when(day < cut, name).otherwise(out)
    return out


def upto_tier(df: DataFrame, ts: str, cuts: list[tuple[str, str]], most: str, locked: tuple[str, ...] = (), unlock: str | None = None) -> DataFrame:
    """Rows up to a tier; a locked tier needs an unlock tag, else it fails."""
    names = [n for n, _ in cuts] + ["FORWARD"]
    if any(n in locked for n in names[: names.index(most) + 1]) and not unlock:
        raise PermissionError(f"tier {most} is locked")
    return df.where(tier(F.col(ts), cuts).isin(names[: names.index(most) + 1]))


class Library:
    """Versions of named tables in a folder: data under data/<name>/v<k>, and an append-only log of what was done."""

    _LOG = "name string, version int, action string, seq long, n long, digest long, start date, end date, locked boolean"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(self._LOG).parquet(f"{self.root}/log")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self._LOG)

    def _note(self, *row) -> None:
        self.spark.createDataFrame([row], self._LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def put(self, name: str, df: DataFrame, version: int | None = None, replace: bool = False, ts: str = "date", locked: bool = False) -> int:
        """A new version, or the given one; one that is there is kept unless `replace`."""
        done = self.log()
        seq, last = done.agg(F.coalesce(F.max("seq"), F.lit(0)), F.coalesce(F.max(F.when(F.col("name") == name, F.col("version"))), F.lit(0))).first()
        version = version or last + 1
        if not replace and self.versions(name).where(F.col("version") == version).take(1):
            raise FileExistsError(f"{name} has a version {version}")
        path = f"{self.root}/data/{name}/v{version}-{seq + 1}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        h = content_hash(kept, sorted(kept.columns)).first()
        start, end = kept.agg(F.to_date(F.min(ts)), F.to_date(F.max(ts))).first()
        self._note(name, version, "put", seq + 1, h["n"] if h else 0, h["digest"] if h else 0, start, end, locked)
        return version

    def delete(self, name: str, version: int) -> None:
        """A tombstone; the data stays."""
        seq = self.log().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        self._note(name, version, "delete", seq + 1, None, None, None, None, None)

    def versions(self, name: str | None = None) -> DataFrame:
        """The last entry of each version that is not deleted."""
        x = self.log().withColumn("_r", F.row_number().over(Window.partitionBy("name", "version").orderBy(F.desc("seq")))).where("_r = 1 and action = 'put'").drop("_r", "action")
        return x if name is None else x.where(F.col("name") == name)

    def overlapping(self, name: str, start: str, end: str) -> DataFrame:
        """Versions of a name whose dates meet [start, end]."""
        return self.versions(name).where((F.col("start") <= end) & (F.col("end") >= start))

    def read(self, name: str, schema, version: int | None = None, start: str | None = None, end: str | None = None, ts: str = "date", verify: bool = False) -> DataFrame:
        """The newest version, or the given one, within the dates; `verify` compares its digest with the log and fails on a difference."""
        x = self.versions(name)
        row = (x if version is None else x.where(F.col("version") == version)).orderBy(F.desc("version")).first()
        if row is None:
            raise FileNotFoundError(f"{name} has no such version")
        df = self.spark.read.schema(schema).parquet(f"{self.root}/data/{name}/v{row['version']}-{row['seq']}")
        if verify:
            h = content_hash(df, sorted(df.columns)).first()
            if (h["n"], h["digest"]) != (row["n"], row["digest"]):
                raise ValueError(f"{name} version {row['version']} is not what was frozen")
        if start is not None:
            df = df.where(F.col(ts) >= start)
        return df if end is None else df.where(F.col(ts) <= end)


def freshness(manifest: DataFrame, now: Column, created: str, days: int = 90) -> DataFrame:
    """Age of each version and whether it is stale; dates that cannot be read are."""
    at = F.expr(f"try_to_timestamp({created})")
    age = F.datediff(now, at)
    return manifest.withColumn("age", age).withColumn("stale", F.coalesce(age > days, F.lit(True)))


def write_sized(df: DataFrame, path: str, keys: list[str], rows: int) -> DataFrame:
    """Files of at most `rows` rows, sorted and dealt by keys: (file, n) as read back."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
