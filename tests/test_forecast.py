from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import START
from hitlens.operators import forecast as fc


def wave(n, noise=0.0, slope=0.2, seed=0):
    t = np.arange(n)
    y = 200 + slope * t + 40 * np.sin(2 * np.pi * t / 24) + 25 * np.cos(2 * np.pi * t / 168)
    return y + np.random.default_rng(seed).normal(0, noise, n) if noise else y


def series(spark, y, host=None):
    rows = [(START + timedelta(hours=i), float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, requests double")
    return df if host is None else df.selectExpr(f"'{host}' as host", "*")


def test_recovers_a_clean_signal(spark):
    n = 24 * 28
    out = fc.forecast(series(spark, wave(n))).toPandas().sort_values("ds")
    truth = wave(n + 48)
    assert len(out) == n + 48 and out.is_future.sum() == 48
    np.testing.assert_allclose(out.yhat, truth, rtol=0.01)
    np.testing.assert_allclose(out.trend + out.daily + out.weekly, out.yhat)
    assert out.daily.abs().max() == pytest.approx(40, rel=0.05)


def test_interval_covers_the_noise(spark):
    n = 24 * 42
    y = wave(n, noise=15)
    out = fc.forecast(series(spark, y)).toPandas().sort_values("ds")
    assert (out.yhat_lower <= out.yhat).all() and (out.yhat <= out.yhat_upper).all()
    past = out[~out.is_future]
    inside = ((y >= past.yhat_lower) & (y <= past.yhat_upper)).mean()
    assert 0.92 < inside < 0.98
    width = (out.yhat_upper - out.yhat_lower).to_numpy()
    assert width[-1] >= width[0]


def test_coefficients_minimise_the_penalised_squares(spark):
    y = wave(24 * 10, noise=10, slope=-0.3)
    model = fc.fit_forecast(series(spark, y)).first()
    # rebuild the design independently
    n, scale = len(y), np.abs(y).max()
    t = np.arange(n) / (n - 1)
    history = int(n * 0.8)
    knots = np.round(np.linspace(0, history - 1, 26))[1:] / (n - 1)
    start = (START - START.replace(year=1970)).days
    days = start + np.arange(n) / 24
    x = [np.ones(n), t] + [np.maximum(0, t - k) for k in knots]
    for period, order in ((1, 4), (7, 3)):
        for i in range(1, order + 1):
            x += [np.sin(2 * np.pi * i * days / period), np.cos(2 * np.pi * i * days / period)]
    x = np.column_stack(x)
    scales = np.array([5.0] * 2 + [np.inf] * 25 + [10.0] * 14)

    def cost(beta):
        return (((y / scale - x @ beta) ** 2).sum() / (2 * model.noise ** 2)
                + (beta ** 2 / (2 * scales ** 2)).sum() + np.abs(beta[2:27]).sum() / 0.05)

    beta = np.array(model.beta)
    best, rng = cost(beta), np.random.default_rng(0)
    for step in (1e-1, 1e-2, 1e-3):
        for _ in range(300):
            assert cost(beta + rng.normal(0, step, len(beta))) > best - 1e-6


def test_long_series_is_fitted_in_blocks(spark):
    y = wave(24 * 7 * 30)  # more than one block
    out = fc.next_hours(fc.forecast(series(spark, y)), 48).toPandas()
    np.testing.assert_allclose(out.yhat, wave(len(y) + 48)[-48:], rtol=0.02)


def test_many_series(spark):
    a, b = wave(24 * 14), wave(24 * 14, slope=-0.1) / 10
    df = series(spark, a, "a").union(series(spark, b, "b")).union(series(spark, wave(20), "short"))
    out = fc.forecast(df, keys=["host"]).toPandas()
    assert set(out.host) == {"a", "b"}
    alone = fc.forecast(series(spark, b)).toPandas().sort_values("ds")
    np.testing.assert_allclose(out[out.host == "b"].sort_values("ds").yhat, alone.yhat)
    assert fc.next_hours(fc.forecast(df, keys=["host"]), keys=["host"]).count() == 48


def test_guards_and_frames(spark):
    assert fc.forecast(series(spark, wave(47))).count() == 0
    assert fc.forecast(series(spark, wave(48))).count() == 96
    frame = fc.future_frame(series(spark, wave(10)), 5).orderBy("ds").collect()
    assert len(frame) == 15 and sum(r.is_future for r in frame) == 5
    flat = fc.forecast(series(spark, np.zeros(60))).toPandas()
    assert flat.yhat.abs().max() == pytest.approx(0, abs=1e-9)
    parts = fc.forecast_components(fc.forecast(series(spark, wave(60))))
    assert parts.columns == ["ds", "trend", "daily", "weekly"]


def test_certificate_tells_the_optimum_from_others(spark, hours):
    rng = np.random.default_rng(3)
    at = np.arange(24 * 30)
    counts = 200 + 0.3 * at + np.where(at > 300, 0.8 * (at - 300), 0) + 40 * np.sin(at * 2 * np.pi / 24) + rng.normal(0, 9, len(at))
    rows = hours(np.maximum(counts, 0).astype(int))
    model = fc.fit_forecast(rows)
    terms = fc.certificate(rows, model).toPandas().sort_values("term")
    assert terms.term.tolist() == list(range(41)) and terms.violation.max() < 1e-5
    # the same figures from plain matrices
    x = np.stack([r._x for r in fc._designed(rows, "datetime", "requests", []).collect()])
    y = np.array([r._y for r in fc._designed(rows, "datetime", "requests", []).collect()])
    fitted = model.first()
    gradient = x.T @ (y - x @ np.array(fitted.beta)) / fitted.noise ** 2
    np.testing.assert_allclose(terms.gradient, gradient, rtol=1e-6, atol=1e-4)
    worse = model.withColumn("beta", F.transform("beta", lambda b, i: F.when(i == 5, b + 0.01).otherwise(b)))
    assert fc.certificate(rows, worse).agg(F.max("violation")).first()[0] > 1e-2
    two = rows.withColumn("host", F.lit("a")).unionByName(rows.withColumn("host", F.lit("b")))
    by_host = fc.certificate(two, fc.fit_forecast(two, keys=["host"]), keys=["host"])
    assert by_host.count() == 82 and by_host.agg(F.max("violation")).first()[0] < 1e-5


def test_simulated_interval_covers_and_repeats(spark, hours):
    """Futures drawn one by one, with changes as frequent and large as fitted, lie in the interval 95 % of the time."""
    rng = np.random.default_rng(17)
    n, ahead, rows = 24 * 14, 48, None
    for i in range(3):
        slope = np.repeat(rng.laplace(0, 2, 8), n // 8)
        own = hours(np.rint(2500 + slope.cumsum() + rng.normal(0, 12, n)).astype(int)).withColumn("host", F.lit(f"h{i}"))
        rows = own if rows is None else rows.unionByName(own)
    model = fc.fit_forecast(rows, keys=["host"])
    out, again, closed = (fc.predict(m, ahead, keys=["host"], **how).where("is_future").toPandas().sort_values(
        ["host", "ds"]) for m, how in ((model, {}), (model.repartition(5), {}), (model, {"interval": "closed"})))
    assert out.yhat_lower.tolist() == again.yhat_lower.tolist()
    inside = []
    for fit in model.collect():
        own = out[out.host == fit.host]
        changes = np.array(fit.beta[2:2 + fc.CHANGEPOINTS])
        end = ahead / (n - 1)
        at = np.arange(1, ahead + 1) / (n - 1)
        for _ in range(1000):
            path = rng.normal(0, fit.noise, ahead)
            for _ in range(rng.poisson(25 * end)):
                path += rng.laplace(0, np.abs(changes).mean()) * np.maximum(at - rng.uniform(0, end), 0)
            y = own.yhat.to_numpy() + path * fit._scale
            inside.append(((y >= own.yhat_lower) & (y <= own.yhat_upper)).mean())
    assert np.mean(inside) == pytest.approx(0.95, abs=0.01)
    width, other = ((p.yhat_upper - p.yhat_lower).to_numpy() for p in (out, closed))
    assert 0.8 < width.mean() / other.mean() < 1.25
    with pytest.raises(ValueError):
        fc.predict(model, keys=["host"], interval="other")


def test_simulated_paths_have_the_variance_of_the_changes():
    rng = np.random.default_rng(1)
    ahead = np.array([0.1, 0.2, 0.4])
    found = fc._paths(rng, ahead, 25, 0.3, 20_000)
    np.testing.assert_allclose(found.var(axis=0), 25 * 2 * 0.3 ** 2 * ahead ** 3 / 3, rtol=0.1)
