"""Streaming counterparts for logs that arrive continuously.

Times are cast to zoned timestamps, which watermarks require. In append mode a window
appears once the watermark has passed it; ``run_to_end`` also returns the windows still open.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hitlens.operators.security import attack_hits
from hitlens.sources.logs import _has_extension, parse_lines


def live_logs(spark: SparkSession, path: str, layout: str = "auto", *, quarantine: bool = False,
              extensions: Sequence[str] | None = ("log", "txt", "tsv")):
    """Log lines of files as they arrive in a folder, in the canonical table.

    With ``quarantine`` the result is ``(good, bad)``, two streams: ``bad`` holds file, layout
    and raw line of what cannot be read. Comma files have a header of their own each and
    are left to the batch reader, so their ending is not among the ``extensions``.
    """
    lines = spark.readStream.text(path).where(F.trim("value") != "")
    if extensions is not None:
        lines = lines.where(_has_extension(extensions))
    parsed = parse_lines(lines.select("value", F.col("_metadata.file_path").alias("source_file")),
                         layout)
    known = F.col("layout").isNotNull() & F.col("datetime").isNotNull()
    good = parsed.where(known).drop("layout", "raw_line", "source_file")
    if not quarantine:
        return good
    return good, parsed.where(~known).select("source_file", "layout", "raw_line")


def run_to_end(stream: DataFrame, folder: str, keys: Sequence[str]) -> DataFrame:
    """Run a windowed stream over all that has arrived, and return every window, also those
    that the watermark has not passed.

    Windows leave in update mode, one folder per batch, which a batch that runs again
    replaces; a window's last update counts.
    """
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    (stream.writeStream.foreachBatch(write).outputMode("update")
     .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
     .start().awaitTermination())
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = stream.sparkSession.read.schema(schema).parquet(f"{folder}/rows")
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, "_last.*").select(*stream.columns)


def _windowed(df: DataFrame, length: str, late: str):
    timed = df.withColumn("event_time", F.col("datetime").cast("timestamp"))
    return timed.withWatermark("event_time", late), F.window("event_time", length)


def _with_bounds(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").alias("window_start"),
                     F.col("window.end").alias("window_end"),
                     *[c for c in df.columns if c != "window"])


def live_traffic(df: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Requests and errors per tumbling window."""
    timed, window = _windowed(df, length, late)
    return _with_bounds(timed.groupBy(window).agg(
        F.count("*").alias("requests"), F.sum("is_error").alias("errors")))


def live_ip_profile(df: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Volume, error share and approximate distinct URIs per client and window (streams
    allow no exact distinct count)."""
    timed, window = _windowed(df.where(F.col("ip").isNotNull()), length, late)
    return _with_bounds(timed.groupBy(window, "ip").agg(
        F.count("*").alias("requests"), F.avg("is_error").alias("is_error_mean"),
        F.approx_count_distinct("uri").alias("uris")))


def live_attacks(df: DataFrame) -> DataFrame:
    """Requests matching an attack signature, as they arrive: stateless."""
    return attack_hits(df)
