"""Additive forecast of hourly series: piecewise-linear trend, daily and weekly seasonality.

The design is one Spark expression shared by fitting and prediction. Fitting needs only
sums over it: blocks of a series give partial Gram matrices, whose total per key is solved
for the most probable coefficients (normal priors on level, slope and seasonality, a
Laplace prior on the slope changes). Many series are fitted in parallel, and a long one
block by block. Differences from the model it stands for: a single daily block (the extra
one-day seasonality would be collinear), and a direct solve instead of a general optimiser. The
interval beyond the history comes from simulated trend changes, a bounded number of draws per
series from a generator seeded by its keys; a closed form is an option.
"""

import zlib
from collections.abc import Sequence
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from hitlens.functions.fields import seconds_between
from hitlens.operators.grouping import attach
from hitlens.operators.timeseries import after, steps_between
from hitlens.session import checkpoint

# Fixed values of the model.
HORIZON, SHOWN, MIN_HOURS = 48, 24, 48
CHANGEPOINTS, HISTORY_SHARE = 25, 0.8
DAILY_ORDER, WEEKLY_ORDER = 4, 3
TREND_SCALE, CHANGE_SCALE, SEASONAL_SCALE, NOISE_SCALE = 5.0, 0.05, 10.0, 0.5
INTERVAL, INTERVAL_Z = 0.95, 1.959964
DRAWS, SEED = 1000, 42
SIMULATED, CLOSED = "simulated", "closed"

_BLOCK = 4096



def _fourier(days: Column, period: int, order: int) -> list[Column]:
    return [f(days * (2 * np.pi * i / period)) for i in range(1, order + 1) for f in (F.sin, F.cos)]


def _design() -> Column:
    """Level, slope, slope changes, daily and weekly terms at ``_hour`` of a series of ``_n``.

    Slope changes sit evenly on the first 80 % of the series; a short series has fewer of
    them, and the places left over hold zeros.
    """
    span = F.col("_n") - 1
    t = F.col("_hour") / span
    history = F.floor(F.col("_n") * HISTORY_SHARE)
    count = F.least(F.lit(CHANGEPOINTS), history - 1)
    changes = []
    for j in range(1, CHANGEPOINTS + 1):
        at = F.rint((history - 1) * F.lit(float(j)) / count) / span
        changes.append(F.when(F.lit(j) <= count, F.greatest(F.lit(0.0), t - at)).otherwise(0.0))
    days = F.col("_epoch_hour") / 24.0
    return F.array(F.lit(1.0), t, *changes,
                   *_fourier(days, 1, DAILY_ORDER), *_fourier(days, 7, WEEKLY_ORDER))


def _epoch_hours(ds: Column) -> Column:
    return seconds_between(F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ds) / 3600


def _posterior_mode(gram: np.ndarray, xy: np.ndarray, yy: float, n: int):
    """Coefficients and noise, from sums alone.

    Alternates a ridge solve with updates of the noise and of the weights that make the
    quadratic penalty on slope changes act like an absolute one.
    """
    p = len(xy)
    change = slice(2, 2 + CHANGEPOINTS)
    penalty = np.full(p, 1 / SEASONAL_SCALE ** 2)
    penalty[:2] = 1 / TREND_SCALE ** 2
    noise = max(yy / n, 1e-12)
    beta = np.zeros(p)
    size = np.full(CHANGEPOINTS, CHANGE_SCALE)
    for _ in range(200):
        penalty[change] = 1 / (CHANGE_SCALE * np.maximum(size, 1e-7))
        new = np.linalg.solve(gram / noise + np.diag(penalty), xy / noise)
        rest = max(yy - 2 * new @ xy + new @ gram @ new, 0.0)
        noise = max(rest / (n + noise / NOISE_SCALE ** 2), 1e-12)
        size = np.abs(new[change])
        if np.max(np.abs(new - beta)) < 1e-9:
            beta = new
            break
        beta = new
    return beta, float(np.sqrt(noise))


def _designed(series: DataFrame, time: str, value: str, keys: list[str]) -> DataFrame:
    """Scaled values and design rows of the series of at least 48 hours.

    The time columns are found with windows over the rolled-up series, so its source is read once.
    """
    whole = W.partitionBy(*keys)
    return (series.select(*keys, F.col(time).alias("_ds"), F.col(value).cast("double").alias("_y"))
            .withColumns({"_n": F.count("*").over(whole), "_start": F.min("_ds").over(whole),
                          "_end": F.max("_ds").over(whole),
                          "_scale": F.max(F.abs("_y")).over(whole)})
            .where(F.col("_n") >= MIN_HOURS)
            .withColumn("_epoch_hour", _epoch_hours(F.col("_ds")))
            .withColumn("_hour", F.rint(F.col("_epoch_hour") - _epoch_hours(F.col("_start"))))
            .withColumn("_scale", F.when(F.col("_scale") > 0, F.col("_scale")).otherwise(1.0))
            .select(*keys, "_n", "_start", "_end", "_scale",
                    (F.col("_y") / F.col("_scale")).alias("_y"), _design().alias("_x"),
                    F.floor(F.col("_hour") / _BLOCK).alias("_block")))


def fit_forecast(series: DataFrame, *, time: str = "datetime", value: str = "requests",
                 keys: Sequence[str] = ()) -> DataFrame:
    """Fit a regular hourly series (per key): one row of parameters each.

    A series of fewer than 48 hours gives no row.
    """
    keys = list(keys)
    rows = _designed(series, time, value, keys)
    key_fields = [series.schema[k] for k in keys]
    facts = ["_n", "_start", "_end", "_scale"]
    fact_fields = [rows.schema[f] for f in facts]

    def gram(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(pdf["_x"].to_numpy()), pdf["_y"].to_numpy()
        out = pdf[[*keys, *facts]].head(1).copy()
        out["gram"], out["xy"], out["yy"] = [(x.T @ x).ravel()], [x.T @ y], float(y @ y)
        return out

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = np.sum(np.stack(pdf["xy"].to_numpy()), axis=0)
        total = np.sum(np.stack(pdf["gram"].to_numpy()), axis=0).reshape(len(xy), len(xy))
        beta, noise = _posterior_mode(total, xy, pdf["yy"].sum(), int(pdf["_n"].iloc[0]))
        out = pdf[[*keys, *facts]].head(1).copy()
        out["beta"], out["noise"] = [beta], noise
        return out

    doubles = T.ArrayType(T.DoubleType())
    gram_schema = T.StructType([*key_fields, *fact_fields, T.StructField("gram", doubles),
                                T.StructField("xy", doubles), T.StructField("yy", T.DoubleType())])
    fit_schema = T.StructType([*key_fields, *fact_fields, T.StructField("beta", doubles),
                               T.StructField("noise", T.DoubleType())])
    partial = rows.groupBy(*keys, "_block").applyInPandas(gram, gram_schema)
    # one small matrix per block of a series
    return partial.groupBy(*keys).applyInPandas(solve, fit_schema)


# A slope change below this counts as none in a certificate.
_NO_CHANGE = 1e-5


def certificate(series: DataFrame, model: DataFrame, *, time: str = "datetime", value: str = "requests",
                keys: Sequence[str] = ()) -> DataFrame:
    """Whether fitted coefficients are the most probable ones, told from the series alone.

    One row per (key and) term: ``beta``, ``gradient`` of the fit (design times residuals over the noise), the
    ``penalty`` it has to balance, and by how much it does not, as a share of the gradient of zero
    coefficients and the Laplace prior. A slope change of zero may have any gradient up to the prior's. The
    objective is convex for a given noise, so violations near zero prove the optimum, however it was found.
    """
    keys = list(keys)
    fitted = model.select(*keys, "beta", "noise")
    rows = attach(_designed(series, time, value, keys).select(*keys, "_y", "_x"), fitted, keys)
    inner = F.aggregate(F.zip_with("_x", "beta", lambda x, b: x * b), F.lit(0.0), lambda acc, v: acc + v)
    each = rows.withColumn("_rest", F.col("_y") - inner).select(
        *keys, "_y", "_rest", "noise", F.posexplode(F.arrays_zip("_x", "beta")))
    sums = each.groupBy(*keys, F.col("pos").cast("long").alias("term")).agg(
        F.first("col.beta").alias("beta"), (F.sum(F.col("col._x") * F.col("_rest")) / F.first("noise") ** 2).alias("gradient"),
        (F.abs(F.sum(F.col("col._x") * F.col("_y"))) / F.first("noise") ** 2).alias("_size"))
    change = F.col("term").between(2, 1 + CHANGEPOINTS)
    laplace = F.when(F.abs("beta") > _NO_CHANGE, F.signum("beta") / CHANGE_SCALE).otherwise(
        F.greatest(F.lit(-1 / CHANGE_SCALE), F.least(F.lit(1 / CHANGE_SCALE), F.col("gradient"))))
    normal = F.col("beta") / F.when(F.col("term") < 2, TREND_SCALE ** 2).otherwise(SEASONAL_SCALE ** 2)
    return sums.withColumn("penalty", F.when(change, laplace).otherwise(normal)).withColumn(
        "violation", F.abs(F.col("gradient") - F.col("penalty")) / (F.col("_size") + 1 / CHANGE_SCALE)).drop("_size")


def future_frame(series: DataFrame, periods: int = HORIZON, *, time: str = "datetime",
                 keys: Sequence[str] = ()) -> DataFrame:
    """History of a regular hourly series followed by ``periods`` further hours."""
    ends = series.groupBy(*keys).agg(F.min(time).alias("_start"), F.max(time).alias("_end"))
    hours = F.timestamp_diff("HOUR", F.col("_start"), F.col("_end")) + periods
    return (steps_between(ends.where(F.col("_start").isNotNull()), hours)
            .select(*keys, "_end", after(F.col("_start"), F.col("_step")).alias("ds"))
            .select(*keys, "ds", (F.col("ds") > F.col("_end")).alias("is_future")))


def _dot(first: int, width: int) -> Column:
    pairs = F.zip_with(F.slice("_x", first + 1, width), F.slice("beta", first + 1, width),
                       lambda x, b: x * b)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v) * F.col("_scale")


def _used_changes() -> Column:
    return F.least(F.lit(CHANGEPOINTS), F.floor(F.col("_n") * HISTORY_SHARE) - 1)


def _paths(rng: np.random.Generator, ahead: np.ndarray, rate: float, size: float, draws: int) -> np.ndarray:
    """Changes of the trend at the times ``ahead`` of the end: draws x times.

    As many slope changes as the history had in the same time, on average, at uniform times and of Laplace size.
    """
    counts = rng.poisson(rate * ahead[-1], draws)
    width = max(int(counts.max()), 1)
    at = rng.uniform(0, ahead[-1], (draws, width))
    change = rng.laplace(0, size, (draws, width)) * (np.arange(width) < counts[:, None])
    out = np.zeros((draws, len(ahead)))
    for place, slope in zip(at.T, change.T):  # one change of every draw at a time
        out += slope[:, None] * np.maximum(ahead[None] - place[:, None], 0)
    return out


@lru_cache(maxsize=1)
def _normal_table() -> tuple[np.ndarray, np.ndarray]:
    """The normal distribution function on a fine grid, linear in between."""
    at = np.linspace(-8, 8, 8001)
    return at, np.array([NormalDist().cdf(v) for v in at.tolist()])


def _half_widths(paths: np.ndarray, noise: float) -> np.ndarray:
    """For each hour, how far around zero the interval reaches for paths that may go either way, with normal
    noise on top: the noise is not drawn, its share of the mixture is exact."""
    grid, share = _normal_table()
    low, high = np.full(paths.shape[1], INTERVAL_Z * noise), np.abs(paths).max(axis=0) + 8 * noise
    for _ in range(50):
        middle = (low + high) / 2
        below = sum(np.interp((middle + sign * paths) / noise, grid, share).mean(axis=0) for sign in (-1, 1)) / 2
        wide = below >= (1 + INTERVAL) / 2
        low, high = np.where(wide, low, middle), np.where(wide, middle, high)
    return (low + high) / 2


def simulated_offsets(model: DataFrame, periods: int = HORIZON, *, keys: Sequence[str] = (), draws: int = DRAWS,
                      seed: int = SEED) -> DataFrame:
    """(keys, _ahead, _width): how far the interval reaches around yhat in each hour after the history, in shares
    of the series' scale, from ``draws`` simulated paths and their mirror images."""
    keys = list(keys)
    schema = T.StructType([model.schema[k] for k in keys] + T._parse_datatype_string(
        "_ahead long, _width double").fields)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        rng = np.random.default_rng([seed, zlib.crc32("|".join(str(row[k]) for k in keys).encode())])
        beta, used = np.asarray(row["beta"]), int(row["_used"])
        size = np.abs(beta[2:2 + CHANGEPOINTS]).sum() / used
        ahead = np.arange(1, periods + 1) / (row["_n"] - 1)
        width = _half_widths(_paths(rng, ahead, used, size, draws), row["noise"])
        return pd.DataFrame({k: row[k] for k in keys} | {"_ahead": np.arange(1, periods + 1), "_width": width})

    rows = model.select(*keys, "_n", "beta", "noise", _used_changes().alias("_used"))
    return rows.groupBy(*keys).applyInPandas(draw, schema)


def predict(model: DataFrame, periods: int = HORIZON, *, keys: Sequence[str] = (), interval: str = SIMULATED,
            draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """Fitted history and the next hours: yhat with a 95 % interval, and its components.

    Hours are generated from the parameters, so the series itself is not read again. The
    interval holds the noise and, beyond the history, slope changes as frequent and as
    large on average as those fitted: ``simulated`` mixes drawn paths with the noise, ``closed`` takes the
    normal distribution of the same variance.
    """
    if interval not in (SIMULATED, CLOSED):
        raise ValueError(f"interval must be {SIMULATED!r} or {CLOSED!r}, not {interval!r}")
    width = 2 + CHANGEPOINTS
    changes = F.slice("beta", 3, CHANGEPOINTS)
    used = _used_changes()
    mean_change = F.aggregate(changes, F.lit(0.0), lambda acc, v: acc + F.abs(v)) / used
    hours = F.timestamp_diff("HOUR", F.col("_start"), F.col("_end")) + periods
    rows = (steps_between(model.withColumn("_change", mean_change).withColumn("_used", used), hours)
            .withColumn("ds", after(F.col("_start"), F.col("_step"))).drop("_step")
            .withColumn("_epoch_hour", _epoch_hours(F.col("ds")))
            .withColumn("_hour", F.rint(F.col("_epoch_hour") - _epoch_hours(F.col("_start"))))
            .withColumn("_x", _design()))
    ahead = F.greatest(F.lit(0.0), F.col("_hour") / (F.col("_n") - 1) - 1)
    drift = F.col("_used") * 2 * F.col("_change") ** 2 * ahead ** 3 / 3
    spread = F.sqrt(F.col("noise") ** 2 + drift) * INTERVAL_Z * F.col("_scale")
    parts = rows.select(
        *keys, "ds", (F.col("ds") > F.col("_end")).alias("is_future"),
        _dot(0, width).alias("trend"), _dot(width, 2 * DAILY_ORDER).alias("daily"),
        _dot(width + 2 * DAILY_ORDER, 2 * WEEKLY_ORDER).alias("weekly"), spread.alias("_spread"),
        "_scale", F.timestamp_diff("HOUR", F.col("_end"), F.col("ds")).alias("_ahead"))
    width = F.col("_spread")
    if interval == SIMULATED and periods > 0:
        parts = attach(parts, simulated_offsets(model, periods, keys=keys, draws=draws, seed=seed), [*keys, "_ahead"])
        width = F.coalesce(F.col("_width") * F.col("_scale"), width)
    yhat = F.col("trend") + F.col("daily") + F.col("weekly")
    return parts.select(*keys, "ds", yhat.alias("yhat"), (yhat - width).alias("yhat_lower"),
                        (yhat + width).alias("yhat_upper"), "trend", "daily", "weekly", "is_future")


def forecast(series: DataFrame, periods: int = HORIZON, *, time: str = "datetime",
             value: str = "requests", keys: Sequence[str] = (), **interval) -> DataFrame:
    """Fit and predict; no rows for a series shorter than 48 hours."""
    model = checkpoint(fit_forecast(series, time=time, value=value, keys=keys))
    return predict(model, periods, keys=keys, **interval)


def forecast_components(predicted: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Trend, daily and weekly part of each hour."""
    return predicted.select(*keys, "ds", "trend", "daily", "weekly")


def next_hours(predicted: DataFrame, n: int = SHOWN, *, keys: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` hours after the history."""
    future = predicted.where("is_future").select(*keys, "ds", "yhat", "yhat_lower", "yhat_upper")
    if not keys:
        return future.orderBy("ds").limit(n)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("ds"))
    return future.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
