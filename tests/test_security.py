import pytest

from conftest import request
from hitlens.operators import security


def quiet(n):
    """Requests at distinct times from many clients, none of them suspicious."""
    return [request(ip=f"q{i}", at=10_000 + i) for i in range(n)]


def suspects(feats, rows):
    return sorted(r.ip for r in security.suspicious_clients(feats(rows)).collect())


def test_error_share_is_strict(feats):
    half = [request(ip="half", at=1, status="500"), request(ip="half", at=2)]
    more = [request(ip="more", at=3, status="500"), request(ip="more", at=4, status="404"),
            request(ip="more", at=5)]
    assert suspects(feats, quiet(60) + half + more) == ["more"]


def test_volume_share_is_strict(feats):
    # 100 distinct times in all: 10 requests are not more than a tenth of them, 11 are
    ten = [request(ip="ten", at=i) for i in range(10)]
    eleven = [request(ip="eleven", at=100 + i) for i in range(11)]
    assert suspects(feats, quiet(79) + ten + eleven) == ["eleven"]


def test_scanning_needs_more_than_a_hundred_uris(feats):
    many = [request(ip="a100", at=i, uri=f"/{i}") for i in range(100)]
    more = [request(ip="a101", at=1000 + i, uri=f"/{i}") for i in range(101)]
    assert suspects(feats, quiet(2000) + many + more) == ["a101"]


def test_scanning_is_decided_without_shuffling_uris(feats):
    """Around the limit and the size of the set, with repeats, empty and null URIs, over partitions."""
    rows = quiet(3000)
    counts = {f"n{n}": n for n in (1, 99, 100, 101, 127, 128, 129, 130, 500)}
    for i, (ip, n) in enumerate(counts.items()):
        rows += [request(ip=ip, at=i * 600 + j % 200, uri=f"/{j}") for j in range(n)] * 2
    rows += [request(ip="edge", at=7000 + j % 200, uri="" if j == 100 else f"/{j}") for j in range(101)]
    rows += [request(ip="null", at=7500 + j % 200, uri=None if j == 100 else f"/{j}") for j in range(101)]
    df = feats(rows)
    wanted = {ip for ip, n in counts.items() if n > 100} | {"edge"}
    for parts in (1, 7):
        got = security.suspicious_clients(df.repartition(parts))
        assert {r.ip for r in got.collect()} == wanted
    exact = {r.ip: r for r in security.ip_security_profile(df).collect()}
    for r in got.collect():
        assert all(r[c] == exact[r.ip][c] for c in exact[r.ip].asDict())
    # what is shuffled for the decision is grouped by client only
    plan = security._suspects(df, [])._jdf.queryExecution().executedPlan().toString()
    assert "theta_sketch_agg" in plan and not [
        line for line in plan.splitlines() if "hashpartitioning" in line and "uri" in line]


@pytest.mark.parametrize("n,level,literal", [
    (0, "Low", "Low"), (5, "Low", "Low"), (6, "Medium", "Medium"), (10, "Medium", "Medium"),
    (11, "High", "Medium")])
def test_threat_level(feats, n, level, literal):
    df = feats(quiet(50) + [request(ip=f"e{i:02}", at=i, status="500") for i in range(n)])
    row = security.threat_level(df).first()
    assert (row.threat_level, row.total_threats, row.total_suspicious) == (level, min(n, 10), n)
    assert security.threat_level(df, compat=True).first().threat_level == literal
    assert security.suspicious_ips(df).count() == min(n, 10)


def test_threat_level_per_key(feats):
    rows = quiet(30) + [request(ip=f"e{i}", at=i, status="500", method="POST") for i in range(6)]
    rows += [request(ip=f"p{i}", at=500 + i, method="POST") for i in range(30)]
    got = {r.method: r.threat_level for r in security.threat_level(feats(rows), keys=["method"]).collect()}
    assert got == {"GET": "Low", "POST": "Medium"}


def test_attack_patterns(feats):
    df = feats([request(uri=u) for u in (
        "/SELECTion", "/x?q=<script>", "/../etc", "/..\\win", "/ok", None)])
    got = {r.pattern: (r.requests, r.message) for r in security.attack_pattern_counts(df).collect()}
    assert got == {"sql_injection": (2, "SQL Injection attempts: 2 requests"),
                   "xss": (1, "XSS attempts: 1 requests"),
                   "traversal": (2, "Directory traversal: 2 requests")}
    assert security.attack_hits(df).count() == 4
    assert security.attack_pattern_counts(feats([request()])).count() == 0


def test_recommendations(feats):
    bots = [request(ip=f"b{i}", at=i, agent="spider") for i in range(20)]
    rows = [r.recommendation for r in security.security_recommendations(
        feats(quiet(20) + bots)).orderBy("position").collect()]
    assert rows == ["High bot traffic - implement bot protection measures"]
    assert security.security_recommendations(feats(quiet(20))).count() == 0
