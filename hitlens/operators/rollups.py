"""Rollups that are kept: hourly states per batch of requests, merged without reading the log again.

A batch (a day, a delivery of files) is reduced to one row per key and hour: sums and counts that add up.
It is written under its name, so a batch that comes again, whole or after a failure, replaces
itself; late requests are a batch of their own. ``compact`` adds the batches up into a snapshot that
lists their names; what is read is the newest complete snapshot and the batches it does not list. A
batch that is part of a snapshot is ignored when it comes again.

Every step writes a folder that Spark's commit makes visible as a whole, and a snapshot counts only with
its list of names, written last: a job that dies leaves the former state. One writer at a time.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from hitlens.functions.fields import day_hour
from hitlens.operators.timeseries import fill_gaps
from hitlens.session import delete_folder

# Sums kept of each measure, and their types.
SUMS = {"rows": "long", "requests": "long", "is_error": "long", "bytes": "double",
        "response_time_sum": "double", "response_time_count": "long"}


def hourly_states(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Requests -> one row per key and hour with everything rollups need, null for columns not there."""
    def total(name: str) -> Column:
        return F.sum(name) if name in df.columns else F.lit(None)

    timed = "response_time" in df.columns
    sums = {"rows": F.count("*"), "requests": F.count("ip"), "is_error": total("is_error"), "bytes": total("bytes"),
            "response_time_sum": total("response_time"),
            "response_time_count": F.count("response_time") if timed else F.lit(None)}
    return df.groupBy(*keys, F.to_date("datetime").alias("day"), F.hour("datetime").alias("hour")).agg(
        *[c.cast(SUMS[n]).alias(n) for n, c in sums.items()])


def _added(states: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    return states.groupBy(*by).agg(*[F.sum(n).alias(n) for n in SUMS])


def from_states(states: DataFrame, grain: str = "hour", metrics: Sequence[str] | None = None, *,
                keys: Sequence[str] = (), fill: bool = True) -> DataFrame:
    """As ``timeseries.rollup`` of the requests behind hourly states, which may repeat an hour."""
    if metrics is None:
        metrics = ["requests", "is_error", "bytes"] + (["response_time"] if grain == "hour" else [])
    start = day_hour(F.col("day"), F.col("hour") if grain == "hour" else F.lit(0))
    mean = F.try_divide(F.sum("response_time_sum"), F.sum("response_time_count"))
    buckets = states.groupBy(*keys, start.alias("datetime")).agg(*[
        (mean if m == "response_time" else F.sum(m)).alias(m) for m in metrics])
    return fill_gaps(buckets, grain, keys=keys) if fill else buckets


class RollupStore:
    """Hourly states in a folder all executors reach; ``keys`` are (name, type) pairs."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[tuple[str, str]] = ()):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), [k for k, _ in keys]
        fields = [*keys, ("day", "date"), ("hour", "int"), *SUMS.items()]
        self.schema = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields))

    def _exists(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _snapshot(self) -> int:
        """Number of the newest complete snapshot, 0 for none; they are numbered without gaps."""
        number = 0
        while self._exists(f"names-{number + 1}/_SUCCESS"):
            number += 1
        return number

    def _names(self) -> DataFrame:
        number = self._snapshot()
        if not number:
            return self.spark.createDataFrame([], "batch string")
        return self.spark.read.schema("batch string").parquet(f"{self.path}/names-{number}")

    def _pending(self) -> DataFrame:
        """States of the batches that no snapshot holds, with their names."""
        if not self._exists("batches"):
            return self.spark.createDataFrame([], T.StructType(self.schema.fields + [
                T.StructField("batch", T.StringType())]))
        rows = self.spark.read.schema(T.StructType(self.schema.fields + [
            T.StructField("batch", T.StringType())])).parquet(f"{self.path}/batches")
        return rows.join(self._names().withColumnRenamed("batch", "_known"),
                         F.col("batch") == F.col("_known"), "left_anti")

    def add(self, batch: str, requests: DataFrame) -> bool:
        """Take up a batch under its name; False if a snapshot holds it already."""
        if not batch or set(batch) & set("/=%\\"):
            raise ValueError(f"not a folder's name: {batch!r}")
        if not self._names().where(F.col("batch") == batch).isEmpty():
            return False
        states = hourly_states(requests, self.keys).select(*self.schema.names)
        states.write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch}")
        return True

    def states(self) -> DataFrame:
        """Hourly states of everything taken up: one scan of the snapshot and of pending batches."""
        return _added(self._parts(), [*self.keys, "day", "hour"])

    def _parts(self) -> DataFrame:
        rows, number = self._pending().drop("batch"), self._snapshot()
        if not number:
            return rows
        return rows.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.path}/states-{number}"))

    def compact(self) -> int:
        """Add pending batches up into a new snapshot; returns its number."""
        number = self._snapshot() + 1
        pending = self._pending().select("batch").distinct()
        self.states().write.mode("overwrite").parquet(f"{self.path}/states-{number}")
        self._names().unionByName(pending).write.mode("overwrite").parquet(f"{self.path}/names-{number}")
        return number

    def vacuum(self) -> None:
        """Remove batches and states that the newest snapshot has replaced; no reader may be at work."""
        number = self._snapshot()
        for older in range(1, number):
            delete_folder(self.spark, f"{self.path}/states-{older}")
        if number and self._exists("batches") and self._pending().isEmpty():
            delete_folder(self.spark, f"{self.path}/batches")

    def rollup(self, grain: str = "hour", metrics: Sequence[str] | None = None, *, fill: bool = True) -> DataFrame:
        """As ``timeseries.rollup`` of all requests taken up, from their states."""
        return from_states(self._parts(), grain, metrics, keys=self.keys, fill=fill)
