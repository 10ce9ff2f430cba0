"""The whole report over one feature table."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from hitlens.operators import anomalies, cluster, forecast, performance, security, traffic
from hitlens.operators.features import extract_features
from hitlens.operators.rollups import from_states, hourly_states
from hitlens.operators.timeseries import error_rate_series, rolling_stats
from hitlens.session import checkpoint
from hitlens.sources.logs import read_logs

CLUSTER_ROWS = 20
# Ranked columns of the report and how many values of each.
RANKED = {"status": 10, "ip": 10, "uri": 10, "user_agent": 5, "hour": 1, "dayofweek": 1}


def analyze(df: DataFrame, *, compat: bool = False, n_init: int = cluster.N_INIT) -> dict[str, DataFrame]:
    """Every section of the report, each a DataFrame, from a feature table.

    Requests are scanned by the few aggregates that need them, each reading only its own
    columns when the table is Parquet. What several sections share (hourly series, client
    profile, suspicious clients, rule inputs) is small, computed once and checkpointed.
    Whether the feature table itself is worth persisting is left to the caller.
    """
    report = {"stats": traffic.overview(df)}
    if "response_time" in df.columns:
        report["response_time"] = traffic.response_time_stats(df)
    # rankings and peaks share one scan
    most = {c: k for c, k in RANKED.items() if c in df.columns}
    ranked = checkpoint(traffic.ranked_dimensions(df, most))
    for column, section in (("status", "status_breakdown"), ("ip", "top_ips"), ("uri", "top_uris"),
                            ("user_agent", "top_user_agents")):
        if column in most:
            report[section] = traffic.top_of(ranked, df, column)
    if "uri" in df.columns:
        report["attack_patterns"] = security.attack_pattern_counts(df)
    for column in ("hour", "dayofweek"):
        report[f"peak_{column}"] = traffic.peak_of(ranked, df, column)

    suspects = checkpoint(security.suspicious_clients(df))
    report["suspicious_ips"] = security.first_clients(suspects)
    report["threat_level"] = security.level_of(suspects, compat=compat)
    report["security_recommendations"] = security.recommendations_for(df, report["threat_level"])

    state = checkpoint(performance.performance_state(df))
    report["performance_score"] = performance.score_from_state(state)
    report["bottlenecks"] = performance.bottlenecks_from_state(state)
    report["optimization_tips"] = performance.tips_from_state(state, "response_time" in df.columns)
    if "bytes" in df.columns:
        report["resource_usage"] = state.select(F.bround("bandwidth_gb", 2).alias("bandwidth_gb"))

    states = checkpoint(hourly_states(df))
    measures = [m for m in ("is_error", "bytes", "response_time") if m in df.columns]
    hourly = checkpoint(from_states(states, "hour", ["requests", "rows", *measures]))
    votes = checkpoint(anomalies.detect_anomalies(hourly.drop("rows"), compat=compat))
    report["hourly"] = error_rate_series(rolling_stats(votes))
    report["daily"] = from_states(states, "day", ["requests", *[m for m in measures if m != "response_time"]])
    report["anomalies"] = votes.where("is_anomaly")
    report["anomaly_stats"] = anomalies.anomaly_summary(votes)

    predicted = checkpoint(forecast.forecast(hourly, value="rows"))
    report["forecast"] = predicted
    report["forecast_next"] = forecast.next_hours(predicted)

    clients = checkpoint(cluster.cluster_ips(df, n_init=n_init))
    report["clusters"] = clients.orderBy("ip").limit(CLUSTER_ROWS)
    if "cluster" in clients.columns:
        report["cluster_sizes"] = cluster.cluster_sizes(clients)
        report["cluster_summary"] = cluster.cluster_summary(clients)
        report["cluster_points"] = cluster.cluster_points(clients)
    return report


def analyze_path(spark: SparkSession, path, layout: str = "auto", **options) -> dict[str, DataFrame]:
    """Read, enrich and analyze the logs under a path."""
    return analyze(extract_features(read_logs(spark, path, layout)), **options)


def report_rows(report: dict[str, DataFrame]) -> DataFrame:
    """All sections as one table: section, row as JSON."""
    out = None
    for section, frame in report.items():
        rows = frame.select(F.lit(section).alias("section"),
                            F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out
