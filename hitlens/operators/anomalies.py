"""Detector votes over a rolled-up series."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from hitlens.operators.isolation import isolation_forest_anomalies
from hitlens.operators.timeseries import moving_average_anomalies, zscore_anomalies

METHODS = ("isolation_forest", "zscore", "moving_average")


def detect_anomalies(df: DataFrame, methods: Sequence[str] = METHODS, *, column: str = "requests",
                     keys: Sequence[str] = (), compat: bool = False) -> DataFrame:
    """Number of detectors that flag each bucket, and whether any does.

    A series of fewer than two buckets gives no rows. With ``compat`` all detectors run but
    only the isolation forest has a vote.
    """
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown detectors: {sorted(unknown)}")
    length = F.count("*").over(W.partitionBy(*keys))
    out = df.withColumn("_length", length).where(F.col("_length") >= 2).drop("_length")
    if "zscore" in methods:
        out = zscore_anomalies(out, column=column, keys=keys).drop("z_score")
    if "moving_average" in methods:
        out = (moving_average_anomalies(out, column=column, keys=keys)
               .drop("rolling_mean", "rolling_std"))
    if "isolation_forest" in methods:
        out = isolation_forest_anomalies(out, [column], keys=keys).drop("isolation_score")
    voters = [m for m in methods if not compat or m == "isolation_forest"]
    score = F.lit(0).cast("long")
    for method in voters:
        score = score + F.col(f"is_{method}").cast("long")
    return (out.withColumn("anomaly_score", score)
            .withColumn("is_anomaly", F.col("anomaly_score") > 0))


def anomaly_summary(df: DataFrame, *, column: str = "requests", keys: Sequence[str] = ()) -> DataFrame:
    """Anomalous buckets, their share, and the peak and mean volume; zeros for no series."""
    flagged = F.col("is_anomaly").cast("long")
    return df.groupBy(*keys).agg(
        F.coalesce(F.sum(flagged), F.lit(0)).alias("total_anomalies"),
        F.coalesce(F.avg(flagged) * 100, F.lit(0.0)).alias("anomaly_rate"),
        F.coalesce(F.max(column), F.lit(0)).cast("long").alias(f"max_{column}"),
        F.coalesce(F.avg(column), F.lit(0.0)).alias(f"avg_{column}"))
