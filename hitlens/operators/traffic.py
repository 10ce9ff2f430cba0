"""Traffic statistics, top-k and per-client profiles over the feature table.

Global figures that can share a scan are one aggregate each; ``overview`` merges them all.
With ``keys`` every operator reports one row (or one ranking) per key.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from hitlens.functions.fields import seconds_between
from hitlens.operators.grouping import attach_per_group
from hitlens.operators.quantiles import exact_quantile

_GIB = 1024.0 ** 3


def _percent(name: str) -> Column:
    return F.avg(name) * 100


def _traffic_aggregates(approx: bool) -> list[Column]:
    distinct = F.approx_count_distinct if approx else F.count_distinct
    return [F.count("*").alias("total_requests"),
            distinct(F.col("ip")).alias("unique_ips"),
            F.min("datetime").alias("first_request"),
            F.max("datetime").alias("last_request"),
            _percent("is_error").alias("error_rate_pct"),
            _percent("is_server_error").alias("server_error_rate_pct"),
            _percent("is_client_error").alias("client_error_rate_pct"),
            _percent("is_weekend").alias("weekend_traffic_pct")]


def _with_duration(df: DataFrame) -> DataFrame:
    hours = F.coalesce(seconds_between(F.col("first_request"), F.col("last_request")) / 3600,
                       F.lit(0.0))
    return df.withColumns({
        "duration_hours": hours,
        "requests_per_hour": F.col("total_requests") / F.greatest(F.lit(1.0), hours)})


def _bandwidth_aggregates() -> list[Column]:
    total = F.sum("bytes")
    any_bytes = total > 0
    return [F.when(any_bytes, total.cast("long")).alias("total_bytes"),
            F.when(any_bytes, F.avg("bytes")).alias("avg_response_size"),
            F.when(any_bytes, total / F.lit(_GIB)).alias("total_bandwidth_gb")]


def _response_aggregates() -> list[Column]:
    any_time = F.sum("response_time") > 0
    return [F.when(any_time, F.avg("response_time")).alias("avg_response_time"),
            F.when(any_time, F.max("response_time")).alias("max_response_time")]


def _device_aggregates(df: DataFrame) -> list[Column]:
    bots = _percent("is_bot") if "is_bot" in df.columns else F.lit(0.0)
    return [_percent("is_mobile").alias("mobile_traffic_pct"), bots.alias("bot_traffic_pct")]


def traffic_summary(df: DataFrame, *, keys: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Volume, clients, time span and error shares."""
    return _with_duration(df.groupBy(*keys).agg(*_traffic_aggregates(approx)))


def bandwidth_stats(df: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Bytes served; all null when nothing was served."""
    return df.groupBy(*keys).agg(*_bandwidth_aggregates())


def response_time_stats(df: DataFrame, *, keys: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Mean, maximum and 95th percentile; all null when the times sum to zero."""
    p95 = "response_time_95th"
    if not exact:
        any_time = F.sum("response_time") > 0
        return df.groupBy(*keys).agg(
            *_response_aggregates(),
            F.when(any_time, F.percentile_approx("response_time", 0.95)).alias(p95))
    stats = df.groupBy(*keys).agg(*_response_aggregates())
    ranked = exact_quantile(df, "response_time", 0.95, keys=keys, name=p95)
    return (attach_per_group(stats, ranked, keys)
            .withColumn(p95, F.when(F.col("avg_response_time").isNotNull(), F.col(p95))))


def device_mix(df: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Mobile and bot share of the requests."""
    return df.groupBy(*keys).agg(*_device_aggregates(df))


def overview(df: DataFrame, *, keys: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Traffic, bandwidth, response time and device figures in a single scan, leaving out
    those whose source column is absent. The percentile needs its own passes: see
    ``response_time_stats``."""
    aggregates = _traffic_aggregates(approx)
    if "bytes" in df.columns:
        aggregates += _bandwidth_aggregates()
    if "response_time" in df.columns:
        aggregates += _response_aggregates()
    if "is_mobile" in df.columns:
        aggregates += _device_aggregates(df)
    return _with_duration(df.groupBy(*keys).agg(*aggregates))


def top_values(df: DataFrame, column: str, k: int = 10, *, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent values with their counts, nulls excluded; ties go to the smaller value."""
    counts = (df.where(F.col(column).isNotNull())
              .groupBy(*keys, column).agg(F.count("*").alias("requests")))
    order = [F.col("requests").desc(), F.col(column).asc()]
    if not keys:
        return counts.orderBy(*order).limit(k)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return counts.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def peak_period(df: DataFrame, column: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Busiest value of ``hour`` or ``dayofweek``; the smallest wins ties."""
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("requests"))
    best = F.max_by(column, F.struct("requests", -F.col(column)))
    return counts.groupBy(*keys).agg(best.alias(f"peak_{column}"),
                                     F.max("requests").alias("requests"))


def ranked_dimensions(df: DataFrame, most: dict[str, int]) -> DataFrame:
    """The most frequent values of several columns, in one scan: (dimension, number, text, requests, rank).

    A request becomes one (dimension, value) pair per column, counted map-side; nulls are left out. Ranks
    are as in ``top_values``, up to ``most[column]``, and every task sends on only so many counts per
    column. A numeric or boolean column's value is in ``number``, another one's in ``text``.
    """
    pairs = []
    for name in most:
        kind, value = df.schema[name].dataType, F.col(name)
        number = isinstance(kind, (T.NumericType, T.BooleanType))
        pairs.append(F.struct(
            F.lit(name).alias("dimension"), (value if number else F.lit(None)).cast("double").alias("number"),
            (F.lit(None) if number else value).cast("string").alias("text")))
    counts = (df.select(F.explode(F.array(*pairs)).alias("pair")).select("pair.*")
              .where("number is not null or text is not null")
              .groupBy("dimension", "number", "text").agg(F.count("*").alias("requests")))
    rank = F.row_number().over(W.partitionBy("dimension").orderBy(
        F.desc("requests"), F.asc("number"), F.asc("text")))
    kept = F.col("rank") <= F.create_map(*[F.lit(x) for item in most.items() for x in item])[F.col("dimension")]
    # the greatest limit first, as a constant it reaches the tasks before the shuffle
    return counts.withColumn("rank", rank).where(F.col("rank") <= max(most.values())).where(kept)


def top_of(ranked: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """``top_values`` of one column from the ranked values of several."""
    kind = df.schema[column].dataType
    source = "number" if isinstance(kind, (T.NumericType, T.BooleanType)) else "text"
    return ranked.where(F.col("dimension") == column).orderBy("rank").select(
        F.col(source).cast(kind).alias(column), "requests")


def peak_of(ranked: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """``peak_period`` of one column from the ranked values of several."""
    best = top_of(ranked.where("rank = 1"), df, column)
    return best.agg(F.first(column).alias(f"peak_{column}"), F.max("requests").alias("requests"))


def hour_profile(df: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Requests per hour of day."""
    return df.groupBy(*keys, "hour").agg(F.count("*").alias("requests"))


def peak_ratio(df: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Busiest over mean hour of day, over the hours present."""
    return (hour_profile(df, keys=keys).groupBy(*keys)
            .agg((F.max("requests") / F.avg("requests")).alias("peak_ratio")))


# Behaviour features per client, in report order.
PROFILE = (
    ("hour", ("mean", "std", "min", "max")),
    ("dayofweek", ("mean", "std")),
    ("is_error", ("mean", "sum")),
    ("is_success", ("sum",)),
    ("bytes", ("mean", "sum")),
    ("response_time", ("mean", "max")),
    ("uri_length", ("mean",)),
    ("is_mobile", ("mean",)),
    ("is_bot", ("mean",)),
)
_AGGREGATES = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}


def profile_columns(df: DataFrame) -> list[str]:
    """Names of the profile features ``df`` can provide."""
    return [f"{c}_{how}" for c, hows in PROFILE if c in df.columns for how in hows]


def ip_profile(df: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Behaviour profile per client; the deviation of a single request is 0.

    Every aggregate combines map-side, so a client holding a third of the log costs one
    partial row per task.
    """
    aggregates = [
        F.coalesce(_AGGREGATES[how](c).cast("double"), F.lit(0.0)).alias(f"{c}_{how}")
        for c, hows in PROFILE if c in df.columns for how in hows]
    return df.where(F.col("ip").isNotNull()).groupBy(*keys, "ip").agg(*aggregates)
