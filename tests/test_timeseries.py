import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import request
from hitlens.operators import anomalies, isolation, timeseries as ts


def test_gaps_are_filled(feats):
    df = feats([request(at=0, status="500"), request(at=3 * 3600 + 5), request(at=3 * 3600 + 9, ip=None)])
    rows = ts.rollup(df).orderBy("datetime").collect()
    assert [(r.requests, r.is_error, r.bytes, r.response_time) for r in rows] == [
        (1, 1, 10.0, 5.0), (0, 0, 0.0, 0.0), (0, 0, 0.0, 0.0), (1, 0, 20.0, 5.0)]
    assert [r["rows"] for r in ts.rollup(df, metrics=["rows"]).orderBy("datetime").collect()] == [1, 0, 0, 2]
    assert ts.rollup(df, "day").count() == 1
    rates = [r.error_rate for r in ts.error_rate_series(ts.rollup(df)).orderBy("datetime").collect()]
    assert rates == [100.0, 0.0, 0.0, 0.0]


def test_gaps_per_key(feats):
    df = feats([request(at=0), request(at=7200), request(at=0, method="POST")])
    got = ts.rollup(df, keys=["method"]).groupBy("method").count().collect()
    assert {r.method: r["count"] for r in got} == {"GET": 3, "POST": 1}


@pytest.mark.parametrize("n", [3, 7, 8, 50, 97, 200])
def test_rolling_matches_pandas(hours, n):
    counts = np.random.default_rng(n).integers(0, 100, n)
    w = min(24, n // 4)
    got = ts.rolling_stats(hours(counts)).orderBy("datetime").toPandas()
    if w > 1:
        want = pd.Series(counts).rolling(w)
        np.testing.assert_allclose(got.rolling_mean.astype(float), want.mean())
        np.testing.assert_allclose(got.rolling_std.astype(float), want.std(), atol=1e-9)
        fixed = ts.rolling_stats(hours(counts), window=w).orderBy("datetime").toPandas()
        np.testing.assert_allclose(fixed.rolling_std.astype(float), want.std(), atol=1e-9)
    else:
        assert got.rolling_mean.isna().all() and got.rolling_std.isna().all()


def test_zscore(hours):
    counts = [10] * 30 + [500]
    got = ts.zscore_anomalies(hours(counts)).where("is_zscore").collect()
    assert [r.requests for r in got] == [500]
    assert ts.zscore_anomalies(hours([4] * 10)).where("is_zscore").count() == 0


def test_series_of_one_hour_gives_nothing(hours):
    votes = anomalies.detect_anomalies(hours([5]), ("zscore", "moving_average"))
    assert votes.count() == 0
    assert tuple(anomalies.anomaly_summary(votes).first()) == (0, 0.0, 0, 0.0)


def test_isolation_forest(hours):
    counts = np.random.default_rng(1).poisson(100, 400)
    counts[200] = 1000
    out = isolation.isolation_forest_anomalies(hours(counts)).toPandas()
    assert out.loc[out.requests == 1000, "is_isolation_forest"].all()
    assert 1 <= out.is_isolation_forest.sum() <= 0.05 * 400 + 1
    again = isolation.isolation_forest_anomalies(hours(counts).repartition(7)).toPandas()
    assert again.sort_values("datetime").isolation_score.tolist() == pytest.approx(
        out.sort_values("datetime").isolation_score.tolist())
    assert isolation.isolation_forest_anomalies(hours([3] * 50)).where("is_isolation_forest").count() == 0


def test_isolation_forest_per_key(spark, hours):
    counts = np.random.default_rng(2).poisson(50, 120)
    counts[7] = 900
    df = hours(counts).selectExpr("'a' as host", "*").union(
        hours([9] * 40).selectExpr("'b' as host", "*"))
    out = isolation.isolation_forest_anomalies(df, keys=["host"]).toPandas()
    assert len(out) == 160
    assert out[(out.host == "a") & (out.requests == 900)].is_isolation_forest.all()
    assert not out[out.host == "b"].is_isolation_forest.any()


def test_votes(hours):
    counts = np.random.default_rng(3).poisson(100, 300)
    counts[150] = 2000
    out = anomalies.detect_anomalies(hours(counts)).toPandas()
    votes = out[["is_isolation_forest", "is_zscore", "is_moving_average"]].sum(axis=1)
    assert (out.anomaly_score == votes).all() and (out.is_anomaly == (votes > 0)).all()
    assert out.loc[out.requests == 2000, "anomaly_score"].item() == 3
    literal = anomalies.detect_anomalies(hours(counts), compat=True).toPandas()
    assert (literal.is_anomaly == literal.is_isolation_forest).all()
    with pytest.raises(ValueError):
        anomalies.detect_anomalies(hours(counts), ["crystal_ball"])


def test_votes_per_key(hours):
    df = hours([5] * 30 + [300]).selectExpr("'a' as host", "*").union(
        hours([1]).selectExpr("'b' as host", "*"))
    out = anomalies.detect_anomalies(df, ("zscore", "moving_average"), keys=["host"])
    assert {r.host: r["count"] for r in out.groupBy("host").count().collect()} == {"a": 31}
    got = anomalies.anomaly_summary(out, keys=["host"]).first()
    assert got.total_anomalies == 1 and got.max_requests == 300


def test_a_very_long_gap(spark, feats):
    from datetime import datetime
    rows = spark.createDataFrame([(datetime(1970, 1, 1), 3), (datetime(2024, 1, 1, 5), 4)],
                                 "datetime timestamp_ntz, requests long")
    out = ts.fill_gaps(rows)
    hours = (datetime(2024, 1, 1, 5) - datetime(1970, 1, 1)).days * 24 + 5 + 1
    assert out.agg({"requests": "sum"}).first()[0] == 7 and out.count() == hours
    assert out.select("datetime").distinct().count() == hours
    assert ts.fill_gaps(rows, "day").count() == hours // 24 + 1


def test_kept_rollups_equal_one_scan(spark, feats, tmp_path):
    """Batches out of order, twice, late, empty, before and after compaction."""
    from hitlens.operators.rollups import RollupStore

    rng = np.random.default_rng(12)
    rows = feats([request(ip=None if i % 9 == 0 else f"c{i % 5}", at=int(rng.integers(0, 5 * 86400)),
                          status=str(rng.choice([200, 404, 500])), size=str(i), took=str(i % 50))
                  for i in range(400)]).withColumn("part", F.pmod(F.xxhash64("datetime", "bytes"), F.lit(4)))
    rows = rows.cache()

    def same(store, parts, keys=()):
        own = rows.where(F.col("part").isin(*parts))
        for grain in ("hour", "day"):
            a, b = (x.toPandas().sort_values([*keys, "datetime"]).reset_index(drop=True) for x in (
                store.rollup(grain), ts.rollup(own, grain, keys=list(keys))))
            pd.testing.assert_frame_equal(a[b.columns], b, check_dtype=False)

    store = RollupStore(spark, str(tmp_path / "plain"))
    assert store.rollup().count() == 0
    for part in (2, 0, 2):  # out of order, one twice
        assert store.add(f"p{part}", rows.where(F.col("part") == part))
    same(store, (0, 2))
    assert store.compact() == 1
    same(store, (0, 2))
    assert not store.add("p2", rows.where("part = 2"))  # held by the snapshot
    assert store.add("p1", rows.where("part = 1")) and store.add("none", rows.limit(0))
    same(store, (0, 1, 2))
    store.vacuum()  # a batch is pending: its folder stays
    same(store, (0, 1, 2))
    # a compaction that died before its names were written changes nothing
    store.states().limit(1).write.parquet(str(tmp_path / "plain" / "states-2"))
    same(store, (0, 1, 2))
    assert store.compact() == 2
    store.vacuum()
    assert not (tmp_path / "plain" / "batches").exists() and not (tmp_path / "plain" / "states-1").exists()
    same(RollupStore(spark, str(tmp_path / "plain")), (0, 1, 2))
    by_ip = RollupStore(spark, str(tmp_path / "by"), [("method", "string")])
    by_ip.add("a", rows.where("part = 3"))
    by_ip.compact()
    by_ip.add("b", rows.where("part < 3"))
    same(by_ip, (0, 1, 2, 3), ("method",))
    with pytest.raises(ValueError):
        store.add("../x", rows)
