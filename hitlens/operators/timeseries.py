"""Regular time series rolled up from requests.

Raw requests are only ever aggregated by bucket, with map-side combining. Windows run on
the rolled-up series, whose length per key is bounded by the time span (8,760 hours a
year), never on requests.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hitlens.functions.fields import day_hour


def _aggregate(metric: str) -> Column:
    if metric == "rows":
        return F.count("*")
    if metric == "requests":
        return F.count("ip")
    return F.avg(metric) if metric == "response_time" else F.sum(metric)


def rollup(df: DataFrame, grain: str = "hour", metrics: Sequence[str] | None = None, *,
           keys: Sequence[str] = (), fill: bool = True) -> DataFrame:
    """Requests, errors, bytes and (hourly) mean response time per bucket, gaps filled by 0.

    The metric ``rows`` counts requests even without a client address.
    """
    if metrics is None:
        metrics = ["requests", "is_error", "bytes"] + (["response_time"] if grain == "hour" else [])
    # rows are grouped by plain numbers; bucket times are built from the few groups
    parts = {"hour": [F.to_date("datetime").alias("_day"), F.hour("datetime").alias("_hour")],
             "day": [F.to_date("datetime").alias("_day")]}[grain]
    start = day_hour(F.col("_day"), F.col("_hour") if grain == "hour" else F.lit(0))
    known = [m for m in metrics if m in ("rows", "requests") or m in df.columns]
    buckets = (df.groupBy(*keys, *parts).agg(*[_aggregate(m).alias(m) for m in known])
               .select(*keys, start.alias("datetime"), *known))
    return fill_gaps(buckets, grain, keys=keys) if fill else buckets


# Steps in one array: long gaps are exploded block by block.
_BLOCK = 4096


def steps_between(df: DataFrame, steps: Column, name: str = "_step") -> DataFrame:
    """Each row once for every number from 0 to ``steps``, as a column; no row holds them all."""
    return (df.withColumn("_steps", steps.cast("long"))
            .withColumn("_block", F.explode(F.sequence(
                F.lit(0).cast("long"), F.floor(F.col("_steps") / _BLOCK))))
            .withColumn(name, F.explode(F.sequence(
                F.col("_block") * _BLOCK,
                F.least(F.col("_steps"), F.col("_block") * _BLOCK + (_BLOCK - 1)))))
            .drop("_steps", "_block"))


def after(start: Column, step: Column, grain: str = "hour") -> Column:
    """Time ``step`` hours or days after ``start``."""
    days = step if grain == "day" else F.floor(step / 24)
    hours = F.lit(0) if grain == "day" else F.pmod(step, F.lit(24))
    return start + F.make_dt_interval(days.cast("int"), hours.cast("int"))


def fill_gaps(df: DataFrame, grain: str = "hour", *, keys: Sequence[str] = ()) -> DataFrame:
    """Regular calendar from the first to the last bucket; absent buckets and nulls are 0.

    Each bucket emits itself and the empty buckets up to its successor, so the series is
    read once and no calendar is joined.
    """
    unit = {"hour": "HOUR", "day": "DAY"}[grain]
    values = [c for c in df.columns if c not in (*keys, "datetime")]
    following = F.lead("datetime").over(W.partitionBy(*keys).orderBy("datetime"))
    empty = F.coalesce(F.timestamp_diff(unit, F.col("datetime"), F.col("_next")) - 1, F.lit(0))
    return (steps_between(df.withColumn("_next", following), empty)
            .withColumn("_bucket", after(F.col("datetime"), F.col("_step"), grain))
            .select(*keys, F.col("_bucket").alias("datetime"),
                    *[F.coalesce(F.when(F.col("_bucket") == F.col("datetime"), F.col(v)),
                                 F.lit(0)).alias(v) for v in values]))


def zscore_anomalies(df: DataFrame, threshold: float = 3, *, column: str = "requests",
                     keys: Sequence[str] = ()) -> DataFrame:
    """Absolute z-score with the population deviation; a constant series has no anomaly."""
    series = W.partitionBy(*keys)
    deviation = F.nullif(F.stddev_pop(column).over(series), F.lit(0.0))
    z = F.abs((F.col(column) - F.avg(column).over(series)) / deviation)
    return (df.withColumn("z_score", z)
            .withColumn("is_zscore", F.coalesce(F.col("z_score") > threshold, F.lit(False))))


# Longest trailing window, and the share of the series it may cover.
MAX_WINDOW, WINDOW_SHARE = 24, 4


def rolling_stats(df: DataFrame, window: int | None = None, *, column: str = "requests",
                  keys: Sequence[str] = ()) -> DataFrame:
    """Trailing mean and sample deviation, the current row included.

    Null until the window is full. By default the window is min(24, n // 4) rows of a
    series of n; without at least two rows in it, everything is null.
    """
    order = W.partitionBy(*keys).orderBy("datetime")
    if window is not None:
        frame = order.rowsBetween(-(window - 1), 0)
        full = (F.count("*").over(frame) == window) & F.lit(window > 1)
        return df.withColumns({
            "rolling_mean": F.when(full, F.avg(column).over(frame)),
            "rolling_std": F.when(full, F.stddev_samp(column).over(frame))})
    width = F.least(F.lit(MAX_WINDOW), F.floor(F.col("_n") / WINDOW_SHARE)).cast("int")
    # the width depends on the series: keep the longest frame, then cut its tail
    tail = F.slice("_recent", F.greatest(F.size("_recent") - F.col("_w") + 1, F.lit(1)), F.col("_w"))
    full = (F.col("_w") > 1) & (F.size("_recent") >= F.col("_w"))
    mean = F.aggregate("_tail", F.lit(0.0), lambda acc, x: acc + x) / F.col("_w")
    squares = F.aggregate("_tail", F.lit(0.0), lambda acc, x:
                          acc + (x - F.col("rolling_mean")) * (x - F.col("rolling_mean")))
    return (df.withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
            .withColumn("_w", F.greatest(width, F.lit(1)))
            .withColumn("_recent", F.collect_list(F.col(column).cast("double"))
                        .over(order.rowsBetween(-(MAX_WINDOW - 1), 0)))
            .withColumn("_tail", tail)
            .withColumn("rolling_mean", F.when(full, mean))
            .withColumn("rolling_std", F.when(full, F.sqrt(squares / (F.col("_w") - 1))))
            .drop("_n", "_w", "_recent", "_tail"))


def moving_average_anomalies(df: DataFrame, k: float = 2, window: int | None = None, *,
                             column: str = "requests", keys: Sequence[str] = ()) -> DataFrame:
    """Values further than ``k`` deviations from their trailing mean."""
    off = F.abs(F.col(column) - F.col("rolling_mean")) > k * F.col("rolling_std")
    return (rolling_stats(df, window, column=column, keys=keys)
            .withColumn("is_moving_average", F.coalesce(off, F.lit(False))))


def error_rate_series(df: DataFrame) -> DataFrame:
    """Errors per hundred requests of each bucket; 0 where there are none."""
    rate = F.coalesce(F.try_divide(F.col("is_error"), F.col("requests")), F.lit(0.0)) * 100
    return df.withColumn("error_rate", rate)
