"""Slow requests, performance score and the advice derived from it."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hitlens.operators.grouping import attach, attach_per_group
from hitlens.operators.rules import messages

_GIB = 1024.0 ** 3

# Thresholds and penalties of the score.
BASE_SCORE = 85
SLOW_FACTOR = 2
SLOW_MEAN_MS, SLOW_MEAN_PENALTY = 2000, 20
SLOW_SHARE, SLOW_SHARE_PENALTY = 0.1, 15
ERROR_SHARE, ERROR_PENALTY = 0.05, 25
PEAK_RATIO, PEAK_PENALTY = 3, 10
HEAVY_GB = 100


def slow_requests(df: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Requests slower than twice the mean of the log (or of their key)."""
    mean = df.groupBy(*keys).agg(F.avg("response_time").alias("_mean"))
    return (attach(df, mean, keys)
            .where(F.col("response_time") > F.col("_mean") * SLOW_FACTOR).drop("_mean"))


def slow_request_stats(df: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Count and share of slow requests.

    Without keys the mean is a scalar and the count a filtered scan. With keys the rows are
    first reduced to counts per response time, so no raw row is shuffled to meet its mean.
    """
    if keys:
        rows = df.groupBy(*keys, "response_time").agg(F.count("*").alias("_n"))
        mean = rows.groupBy(*keys).agg(
            (F.sum(F.col("response_time") * F.col("_n")) / F.sum("_n")).alias("_mean"))
    else:
        rows = df.select("response_time", F.lit(1).cast("long").alias("_n"))
        mean = df.agg(F.avg("response_time").alias("_mean"))
    slow = F.col("response_time") > F.col("_mean") * SLOW_FACTOR
    counted = attach(rows, mean, keys).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(slow, F.col("_n"))), F.lit(0)).alias("slow_requests"),
        F.sum("_n").alias("_total"))
    return counted.select(
        *keys, "slow_requests",
        F.coalesce(F.try_divide("slow_requests", "_total"), F.lit(0.0)).alias("slow_share"))


def performance_state(df: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """The figures the rules look at: one pass by hour of day, plus the slow requests."""
    has_time, has_bytes = "response_time" in df.columns, "bytes" in df.columns
    sums = [F.count("*").alias("_n"), F.sum("is_error").alias("_errors")]
    if has_time:
        sums.append(F.sum("response_time").alias("_time"))
    if has_bytes:
        sums.append(F.sum("bytes").alias("_bytes"))
    no_time, no_bytes = F.lit(None).cast("double"), F.lit(None).cast("double")
    state = df.groupBy(*keys, "hour").agg(*sums).groupBy(*keys).agg(
        (F.sum("_time") / F.sum("_n") if has_time else no_time).alias("mean_response"),
        (F.sum("_errors") / F.sum("_n")).alias("error_share"),
        (F.max("_n") / F.avg("_n")).alias("peak_ratio"),
        (F.sum("_bytes") / F.lit(_GIB) if has_bytes else no_bytes).alias("bandwidth_gb"))
    if has_time:
        return attach_per_group(state, slow_request_stats(df, keys=keys), keys)
    return state.withColumns({"slow_requests": F.lit(None).cast("long"),
                              "slow_share": F.lit(None).cast("double")})


def _conditions() -> dict[str, Column]:
    # times are never negative in sum unless broken, and then no time rule applies
    timed = F.col("mean_response") > 0
    conditions = {
        "slow_mean": timed & (F.col("mean_response") > SLOW_MEAN_MS),
        "slow_share": timed & (F.col("slow_share") > SLOW_SHARE),
        "errors": F.col("error_share") > ERROR_SHARE,
        "peak": F.col("peak_ratio") > PEAK_RATIO,
    }
    return {name: F.coalesce(c, F.lit(False)) for name, c in conditions.items()}


def score_from_state(state: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    c = _conditions()
    score = (F.lit(BASE_SCORE)
             - F.when(c["slow_mean"], SLOW_MEAN_PENALTY).otherwise(0)
             - F.when(c["slow_share"], SLOW_SHARE_PENALTY).otherwise(0)
             - F.when(c["errors"], ERROR_PENALTY).otherwise(0)
             - F.when(c["peak"], PEAK_PENALTY).otherwise(0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long")
    band = F.when(score >= 80, "excellent").when(score >= 60, "good").otherwise("poor")
    return state.select(*keys, score.alias("performance_score"), band.alias("score_band"))


# The messages, word for word.
BOTTLENECKS = {
    "slow_mean": "Slow average response time: %.0fms",
    "slow_share": "High number of slow requests: %d",
    "errors": "High error rate: %.1f%%",
    "peak": "Uneven traffic distribution - consider load balancing",
}
TIPS = {
    "bandwidth": "High bandwidth usage - optimize content delivery",
    "errors": "Reduce error rates by fixing broken links and server issues",
    "caching": "Implement caching to improve response times",
    "watch": "Monitor traffic patterns for capacity planning",
}


def bottlenecks_from_state(state: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    c = _conditions()
    # banker's rounding first: Java's format rounds halves up
    mean = F.format_string(BOTTLENECKS["slow_mean"], F.bround("mean_response", 0))
    rate = F.format_string(BOTTLENECKS["errors"], F.bround(F.col("error_share") * 100, 1))
    return messages(state, "bottleneck", [
        (c["slow_mean"], mean),
        (c["slow_share"],
         F.format_string(BOTTLENECKS["slow_share"], F.col("slow_requests"))),
        (c["errors"], rate),
        (c["peak"], F.lit(BOTTLENECKS["peak"])),
    ], keys=keys)


def tips_from_state(state: DataFrame, has_response_time: bool, *,
                    keys: Sequence[str] = ()) -> DataFrame:
    heavy = F.coalesce(F.col("bandwidth_gb") > HEAVY_GB, F.lit(False))
    return messages(state, "tip", [
        (heavy, F.lit(TIPS["bandwidth"])),
        (~heavy & (F.col("error_share") > 0),
         F.lit(TIPS["errors"])),
        (~heavy & F.lit(has_response_time),
         F.lit(TIPS["caching"])),
        (~heavy, F.lit(TIPS["watch"])),
    ], keys=keys)


def performance_score(df: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Score from 0 to 100 with its band."""
    return score_from_state(performance_state(df, keys=keys), keys=keys)


def bottlenecks(df: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """One message per broken threshold."""
    return bottlenecks_from_state(performance_state(df, keys=keys), keys=keys)


def resource_usage(df: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Bandwidth in GB to two places."""
    return df.groupBy(*keys).agg(
        F.bround(F.sum("bytes") / F.lit(_GIB), 2).alias("bandwidth_gb"))


def optimization_tips(df: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Advice rows, in report order."""
    return tips_from_state(performance_state(df, keys=keys), "response_time" in df.columns,
                           keys=keys)
