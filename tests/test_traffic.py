import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import request
from hitlens.operators import traffic
from hitlens.operators.quantiles import exact_quantile


def test_summary_of_one_request(feats):
    row = traffic.traffic_summary(feats([request()])).first()
    assert (row.total_requests, row.unique_ips, row.duration_hours, row.requests_per_hour) == (1, 1, 0.0, 1.0)


def test_overview_and_keys(feats):
    df = feats([request(at=0), request(at=7200, ip="b", status="500"), request(at=10, method="POST")])
    row = traffic.overview(df).first()
    assert row.duration_hours == 2.0 and row.requests_per_hour == 1.5
    assert row.error_rate_pct == pytest.approx(100 / 3)
    by = {r.method: r.total_requests for r in traffic.traffic_summary(df, keys=["method"]).collect()}
    assert by == {"GET": 2, "POST": 1}
    approx = traffic.traffic_summary(df, approx=True).first()
    assert approx.unique_ips == 2


def test_nothing_served(feats):
    df = feats([request(size="0", took="0")])
    assert traffic.bandwidth_stats(df).first() == (None, None, None)
    assert traffic.response_time_stats(df).first() == (None, None, None)
    assert traffic.response_time_stats(df, exact=False).first() == (None, None, None)


def test_top_values_ties_and_nulls(feats):
    df = feats([request(uri="/b"), request(uri="/a"), request(uri=None), request(uri="/c"), request(uri="/c")])
    assert [tuple(r) for r in traffic.top_values(df, "uri", 2).collect()] == [("/c", 2), ("/a", 1)]
    assert traffic.top_values(df, "uri", 1, keys=["method"]).collect()[0].uri == "/c"


def test_peak_tie_takes_the_smallest(feats):
    df = feats([request(at=3600 * h) for h in (5, 3, 3, 5, 7)])
    assert traffic.peak_period(df, "hour").first().peak_hour == 3
    assert traffic.peak_ratio(df).first().peak_ratio == pytest.approx(2 / (5 / 3))


def test_profile_of_a_single_request(feats):
    row = traffic.ip_profile(feats([request(), request(ip=None)])).collect()
    assert len(row) == 1 and row[0].hour_std == 0.0 and row[0].bytes_sum == 10.0
    slim = feats([request()]).drop("bytes")
    assert "bytes_mean" not in traffic.ip_profile(slim).columns


@pytest.mark.parametrize("q", [0.0, 0.05, 0.95])
@pytest.mark.parametrize("n", [2, 21, 1000])
def test_exact_quantile_small(spark, n, q):
    values = np.random.default_rng(n).integers(0, 50, n).astype(float)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert exact_quantile(df, "v", q).first().quantile == pytest.approx(np.quantile(values, q))


def test_exact_quantile_large_and_skewed(spark):
    n = 300_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(10 ** 9)) / 1000.0).alias("v"),
        (F.col("id") % 2).alias("k"))
    pdf = df.toPandas()
    for q in (0.05, 0.3, 0.95):
        assert exact_quantile(df, "v", q).first().quantile == pytest.approx(np.quantile(pdf.v, q), abs=1e-9)
    got = {r.k: r.quantile for r in exact_quantile(df, "v", 0.95, keys=["k"]).collect()}
    for k, part in pdf.groupby("k"):
        assert got[k] == pytest.approx(np.quantile(part.v, 0.95), abs=1e-9)


def test_attach_keeps_every_row(spark):
    from hitlens.operators import grouping
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 7).alias("k"), "id")
    stats = rows.groupBy("k").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    for limit in (grouping.BROADCAST_BYTES, 0):
        out = grouping.attach(rows, stats, ["k"], limit=limit).toPandas()
        assert len(out) == 3000 and out.id.is_unique and out.top.notna().all()
        for _, part in out.groupby("k", dropna=False):
            assert (part.n == len(part)).all() and (part.top == part.id.max()).all()


def test_hot_key_is_spread(spark):
    from hitlens.operators import grouping
    rows = spark.range(10_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"),
                                      "id")
    counts = rows.groupBy("k").count()
    salted = grouping.with_salts(rows, counts, ["k"], target=500).where("k = -1")
    parts = [r["count"] for r in salted.groupBy("_salt").count().collect()]
    assert len(parts) == 18 and max(parts) < 2 * min(parts)
    top = rows.groupBy("k").agg(F.max("id").alias("top"))
    for lookup in (top, top.join(counts, "k")):
        joined = grouping.salted_join(rows, lookup, ["k"], counts, target=500)
        assert joined.columns == ["k", "id", "top"]
        assert joined.where("k = -1").agg(F.count("*"), F.min("top")).first()[:] == (9000, 9999)


def test_small_dimension_shuffles_no_request(feats):
    from hitlens.operators import features
    out = features.enrich_user_agents(
        feats([request(agent=f"curl/{i % 3}") for i in range(50)]).drop(
            "browser", "browser_version", "os", "device", "is_mobile", "is_bot"), via="dimension")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 50 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
