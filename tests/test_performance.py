import pytest

from conftest import request
from hitlens.operators import performance as perf


def messages(df, name):
    return [r[name] for r in df.orderBy("position").collect()]


def spread(n, **fields):
    """One request per hour of the day, so that traffic is even."""
    return [request(at=3600 * (i % 24) + i, **fields) for i in range(n)]


def test_clean_log(feats):
    df = feats(spread(48))
    assert tuple(perf.performance_score(df).first()) == (85, "excellent")
    assert perf.bottlenecks(df).count() == 0
    assert messages(perf.optimization_tips(df), "tip") == [
        "Implement caching to improve response times",
        "Monitor traffic patterns for capacity planning"]


def test_everything_wrong(feats):
    rows = spread(20, took="0", status="500") + [request(at=60 * i, took="20002") for i in range(5)]
    rows += [request(at=i, took="1") for i in range(15)]
    df = feats(rows)
    row = perf.performance_score(df).first()
    assert tuple(row) == (15, "poor")
    assert messages(perf.bottlenecks(df), "bottleneck") == [
        "Slow average response time: 2501ms", "High number of slow requests: 5",
        "High error rate: 50.0%", "Uneven traffic distribution - consider load balancing"]


def test_mean_is_rounded_half_to_even(feats):
    df = feats(spread(24, took="2500") + spread(24, took="2501"))
    assert messages(perf.bottlenecks(df), "bottleneck") == ["Slow average response time: 2500ms"]


def test_no_time_rules_without_times(feats):
    df = feats(spread(24, took="0"))
    assert perf.performance_score(df).first().performance_score == 85
    slim = feats(spread(24)).drop("response_time", "bytes")
    assert perf.performance_score(slim).first().performance_score == 85
    assert messages(perf.optimization_tips(slim), "tip") == [
        "Monitor traffic patterns for capacity planning"]


def test_heavy_bandwidth(feats):
    df = feats(spread(24, size=str(5 * 1024 ** 3)))
    assert messages(perf.optimization_tips(df), "tip") == [
        "High bandwidth usage - optimize content delivery"]
    assert perf.resource_usage(df).first().bandwidth_gb == pytest.approx(120.0)


def test_slow_requests_per_key(feats):
    rows = [request(took="1")] * 9 + [request(took="100")] + [request(method="POST", took="100")] * 5
    df = feats(rows)
    assert perf.slow_requests(df).count() == 6
    assert perf.slow_requests(df, keys=["method"]).count() == 1
    got = {r.method: (r.slow_requests, r.slow_share)
           for r in perf.slow_request_stats(df, keys=["method"]).collect()}
    assert got == {"GET": (1, 0.1), "POST": (0, 0.0)}
    by = {r.method: r.performance_score for r in perf.performance_score(df, keys=["method"]).collect()}
    assert by == {"GET": 85, "POST": 85}
