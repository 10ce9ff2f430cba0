import json

import numpy as np

from conftest import request
from hitlens.operators import timeseries, traffic
from hitlens.plans.report import RANKED, analyze, analyze_path, report_rows
from hitlens.sources.sinks import write_report


def test_whole_report(spark, feats, tmp_path):
    rng = np.random.default_rng(0)
    rows = [request(ip=f"10.0.0.{i % 12}", at=int(i * 900 + rng.integers(0, 600)),
                    status=str(rng.choice([200, 200, 404])), took=str(rng.integers(1, 900)))
            for i in range(500)]
    report = analyze(feats(rows), n_init=1)
    assert report["stats"].first().total_requests == 500
    assert report["forecast_next"].count() == 24
    assert report["clusters"].count() == 12
    assert report["hourly"].count() >= 124
    stats = report["anomaly_stats"].first()
    assert stats.total_anomalies == report["anomalies"].count()
    assert report_rows(report).select("section").distinct().count() >= 20
    write_report(report, str(tmp_path / "out"))
    files = list((tmp_path / "out" / "performance_score").glob("*.json"))
    assert "performance_score" in json.loads("".join(f.read_text() for f in files))


def test_report_from_files_with_few_columns(spark, tmp_path):
    lines = [f'10.0.0.{i % 2} - - [10/Oct/2000:13:55:{i:02d} +0000] "GET /{i} HTTP/1.1" 200 5' for i in range(6)]
    (tmp_path / "a.log").write_text("\n".join(lines))
    report = analyze_path(spark, str(tmp_path), n_init=1)
    assert report["stats"].first().unique_ips == 2
    assert "cluster_sizes" not in report and report["clusters"].count() == 2
    assert report["forecast"].count() == 0
    assert report["anomaly_stats"].first().total_anomalies == 0


def test_sections_that_share_a_scan_equal_their_operators(feats):
    rng = np.random.default_rng(2)
    rows = [request(ip=None if i % 11 == 0 else f"10.0.0.{i % 23}", at=int(rng.integers(0, 3 * 86400)), uri=f"/{i % 31}",
                    status=rng.choice(["200", "404", "-"]), took=str(i % 70), agent=None if i % 3 else f"a{i % 12}")
            for i in range(600)]
    df = feats(rows)
    ranked = traffic.ranked_dimensions(df.repartition(5), RANKED).cache()
    for column, k in list(RANKED.items())[:4]:
        assert traffic.top_of(ranked, df, column).collect() == traffic.top_values(df, column, k).collect()
    for column in ("hour", "dayofweek"):
        assert traffic.peak_of(ranked, df, column).collect() == traffic.peak_period(df, column).collect()
    report = analyze(df, n_init=1)
    assert report["top_uris"].collect() == traffic.top_values(df, "uri", 10).collect()
    assert report["peak_hour"].collect() == traffic.peak_period(df, "hour").collect()
    daily, own = (sorted(map(tuple, x.select("datetime", "requests", "is_error", "bytes").collect()))
                  for x in (report["daily"], timeseries.rollup(df, "day")))
    assert daily == own
    none = traffic.ranked_dimensions(df.limit(0), RANKED)
    assert none.count() == 0 and traffic.peak_of(none, df, "hour").first().peak_hour is None
