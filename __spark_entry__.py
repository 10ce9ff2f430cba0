"""Entry points for checks: a flagship query, all registered queries, and their SQL."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import numpy as np  # noqa: E402
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T  # noqa: E402

from hitlens.operators import (  # noqa: E402
    anomalies, cluster, dbscan, features, forecast, isolation, kmeans, performance, rollups, security,
    silhouettes, timeseries, traffic)
from hitlens.plans import report  # noqa: E402
from hitlens.operators.grouping import attach  # noqa: E402
from hitlens.session import checkpoint, delete_folder, shared_folder  # noqa: E402
from hitlens.sources.logs import parse_lines, read_logs, standardize  # noqa: E402
from hitlens.sources.sinks import nan_to_null  # noqa: E402
from hitlens.streaming import live  # noqa: E402
from oracle.sql import build  # noqa: E402
from oracle.weblog import LINES, WEBLOG  # noqa: E402

try:  # the driver may delete these two, and a library they need may be absent
    import corpus_pipeline
    from hitlens.llm import queries as llm_queries
except ModuleNotFoundError:
    corpus_pipeline = llm_queries = None

SMOKE_DIR = "/root/testdata/sf0.001"
STATISTICAL = ("zscore", "moving_average")
TWO_FEATURES = ("is_mobile_mean", "is_bot_mean")


def _tidy(df: DataFrame) -> DataFrame:
    """Portable types: whole numbers as bigint, doubles to six places."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            col = F.round(col, 6) + 0.0
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            col = col.cast("long")
        elif isinstance(field.dataType, T.TimestampType):
            col = col.cast("timestamp_ntz")
        out.append(col.alias(field.name))
    return df.select(*out)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def _weblog(events: DataFrame) -> DataFrame:
    return events.sparkSession.sql(WEBLOG.replace("from events", "from {events}"), events=events)


def _standardized(spark: SparkSession, sf: str) -> DataFrame:
    return standardize(_weblog(_events(spark, sf)))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return features.extract_features(_standardized(spark, sf))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    sql = LINES.replace("from weblog", "from {weblog}").replace("{{t}}", "\t").replace("{t}", "\t")
    return spark.sql(sql, weblog=_weblog(_events(spark, sf)))


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return parse_lines(_lines(spark, sf).select("value"))


def _from_files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The log written as text lines, comma files with a header and a kind of file to be left alone, and read
    again: accepted and quarantined rows with the suffix of their file."""
    folder = _folder(spark, "files")
    _lines(spark, sf).select("value").write.text(f"{folder}/lines")
    log = _weblog(_events(spark, sf))
    (log.select(F.concat_ws(" ", "date", "time").alias("datetime"), "ip", "method", "uri", "status", "bytes",
                F.col("response_time").alias("time-taken"), "referer", "user_agent")
     .write.option("header", True).csv(f"{folder}/commas"))
    log.write.json(f"{folder}/others")
    good, bad = (checkpoint(rows.withColumn("suffix", F.regexp_extract("source_file", r"[.]([^.]*)$", 1)))
                 for rows in read_logs(spark, [f"{folder}/{n}" for n in ("lines", "commas", "others")], quarantine=True))
    delete_folder(spark, folder)
    return good, bad


def _guards(spark: SparkSession, sf: str) -> DataFrame:
    """Series too short for a model: single hours for the detectors, days for the forecast."""
    hours = _hourly(spark, sf).withColumn("day", F.to_date("datetime"))
    lone = hours.withColumn("hour_of", F.col("datetime"))
    found = anomalies.detect_anomalies(lone, STATISTICAL, keys=["hour_of"])
    predicted = forecast.forecast(hours, keys=["day"])
    return hours.agg(F.count("*").alias("hours"), F.count_distinct("day").alias("days")).select(
        "*", F.lit(found.count()).cast("long").alias("detected"),
        F.lit(predicted.count()).cast("long").alias("predicted"))


def _hourly(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.rollup(_features(spark, sf))


def _profile(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    rows = _features(spark, sf)
    return traffic.ip_profile(rows), traffic.profile_columns(rows)


def _scaled(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Scaled profiles, one row per client, kept for the many passes of clustering."""
    profile, cols = _profile(spark, sf)
    return checkpoint(cluster.standardize_features(checkpoint(profile), cols)), cols


def _on_features(op, columns=None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf):
        out = op(_features(spark, sf))
        return _tidy(out.select(*columns) if columns else out)
    return run


def _on_hourly(op, columns=None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf):
        out = op(_hourly(spark, sf))
        return _tidy(out.select(*columns) if columns else out)
    return run


def _on_scaled(op) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf):
        return _tidy(op(*_scaled(spark, sf)))
    return run


def _on_votes(op) -> Callable[[SparkSession, str], DataFrame]:
    return _on_hourly(lambda h: op(anomalies.detect_anomalies(h, STATISTICAL)))


def _on_clusters(op) -> Callable[[SparkSession, str], DataFrame]:
    """K-means labels for a fixed k, with the unscaled profile beside them."""
    def run(spark, sf):
        profile, cols = _profile(spark, sf)
        scaled = [f"z_{c}" for c in cols]
        rows = checkpoint(cluster.standardize_features(checkpoint(profile), cols, "z_"))
        return _tidy(op(cluster.kmeans_clusters(rows, 3, scaled).drop(*scaled)))
    return run


def _chosen_k(df: DataFrame, cols: list[str]) -> DataFrame:
    """Bounds of the silhouette by plain distance for every k."""
    scores = cluster.silhouettes_by_k(df, cols)
    rows = [(k, low, high, k == cluster.best_k(scores)) for k, (low, high) in scores.items()]
    return df.sparkSession.createDataFrame(rows, "k long, lower double, upper double, is_best boolean")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _streamed(op, keys=None) -> Callable[[SparkSession, str], DataFrame]:
    """Run a streaming operator over the events as a stream of files, to its end: rows as they
    come, or with ``keys`` every window."""
    def run(spark, sf):
        schema = _events(spark, sf).schema
        events = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
                  .parquet(sf))
        # the fixture's SQL, as column expressions on a stream
        view = f"hitlens_events_{uuid.uuid4().hex}"
        events.createOrReplaceTempView(view)
        out = op(features.extract_features(standardize(
            spark.sql(WEBLOG.replace("from events", f"from {view}")))))
        target = _folder(spark, "stream")
        if keys:
            rows = live.run_to_end(out, target, keys)
        else:
            (out.writeStream.format("parquet").option("path", f"{target}/rows")
             .option("checkpointLocation", f"{target}/state").outputMode("append")
             .trigger(availableNow=True).start().awaitTermination())
            rows = spark.read.schema(out.schema).parquet(f"{target}/rows")
        rows = checkpoint(rows)
        delete_folder(spark, target)
        spark.catalog.dropTempView(view)
        return rows
    return run


def _live_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles per window; whether the approximate number of URIs is near the exact one."""
    rows = _streamed(live.live_ip_profile, ["window_start", "window_end", "ip"])(spark, sf)
    exact = (_features(spark, sf).where("ip is not null")
             .groupBy(F.window(F.col("datetime").cast("timestamp"), "1 hour").alias("w"), "ip")
             .agg(F.count_distinct("uri").alias("exact"))
             .select(F.col("w.start").alias("window_start"), "ip", "exact"))
    close = F.abs(F.col("uris") - F.col("exact")) <= F.greatest(F.lit(2), F.col("exact") * 0.25)
    return _tidy(rows.join(exact, ["window_start", "ip"]).select(
        "window_start", "ip", "requests", "is_error_mean", close.alias("uris_close")))


def _kept_rollup(grain: str) -> Callable[[SparkSession, str], DataFrame]:
    """Rollup of requests that came in batches, one of them late and one twice, with compaction between."""
    def run(spark, sf):
        rows, folder = _features(spark, sf), _folder(spark, "rollups")
        store = rollups.RollupStore(spark, folder)
        late = F.col("event_id") % 10 == 7
        store.add("first", rows.where((F.dayofmonth("datetime") <= 12) & ~late))
        store.add("second", rows.where((F.dayofmonth("datetime") > 12) & ~late))
        store.add("first", rows.where((F.dayofmonth("datetime") <= 12) & ~late))
        store.compact()
        store.vacuum()
        store.add("second", rows.where((F.dayofmonth("datetime") > 12) & ~late))
        store.add("late", rows.where(late))
        out = checkpoint(store.rollup(grain))
        delete_folder(spark, folder)
        return _tidy(out)
    return run


def _json_rows(f: DataFrame) -> DataFrame:
    """Requests as JSON text after conversion, with NaN for a missing figure at four depths."""
    size = F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.floor("bytes").cast("double"))
    nested = f.select("event_id", F.struct(
        size.alias("bytes"), F.array(size, F.lit(None).cast("double"), F.lit(1.5)).alias("sizes"),
        F.create_map(F.lit("last"), F.struct(F.array(size).alias("all"), F.col("method").alias("method"))).alias("by"),
        F.col("status").cast("long").alias("status")).alias("record"))
    return nan_to_null(nested).select("event_id", F.to_json("record", {"ignoreNullFields": "false"}).alias("json"))


def _report(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of the report. The features are written once; sections read their columns."""
    target = _folder(spark, "features")
    _features(spark, sf).write.parquet(target)
    rows = checkpoint(report.report_rows(report.analyze(spark.read.parquet(target))))
    delete_folder(spark, target)
    return rows


# sections whose size the data decide in a way that SQL can tell
SECTIONS = ("stats", "response_time", "status_breakdown", "top_ips", "top_uris", "top_user_agents",
            "peak_hour", "peak_dayofweek", "suspicious_ips", "threat_level", "performance_score",
            "resource_usage", "hourly", "daily", "anomaly_stats", "forecast", "forecast_next",
            "clusters", "cluster_points")


def _report_sections(spark: SparkSession, sf: str) -> DataFrame:
    return (_report(spark, sf).where(F.col("section").isin(*SECTIONS)).groupBy("section")
            .agg(F.count("*").alias("rows")))


def _silhouette_bands(x: DataFrame, cols: list[str]) -> DataFrame:
    """Silhouettes of a labelling by one column, in both metrics."""
    rows = x.withColumn("band", (F.col("hour_mean") > 0).cast("int"))
    scores = [cluster.silhouette(rows, cols, "band", metric=m)
              for m in (cluster.SQUARED, cluster.EUCLIDEAN)]
    return x.sparkSession.createDataFrame([tuple(scores)], "squared double, euclidean double")


def _silhouette_bounds(x: DataFrame, cols: list[str]) -> DataFrame:
    """Silhouettes around two fixed centres without distances of all pairs: by squared distance, by plain
    distance from fine cells, and whether those of coarse cells hold it."""
    points = checkpoint(kmeans.fixed_point(x, cols))
    model = kmeans.Model(2, 0, np.array([[-1.0] * len(cols), [1.0] * len(cols)]))
    kmeans.lloyd(points, [model], rounds=0)
    (low, high), = silhouettes.bounds(points, {2: model}, 16).values()
    fine = sum(silhouettes.euclidean(points, {2: model}, [4096])[2]) / 2
    row = silhouettes.squared(points, {2: model})[2], fine, low <= fine <= high
    return x.sparkSession.createDataFrame([row], "squared double, euclidean double, bounded boolean").withColumn(
        "squared", F.round("squared", 4))


def _kmeans_facts(x: DataFrame, cols: list[str]) -> DataFrame:
    """Clients whose cluster's mean is not the nearest one, and sums over sizes and summary."""
    labelled = checkpoint(cluster.kmeans_clusters(x, 3, cols))
    means = labelled.groupBy("cluster").agg(F.array(*[F.avg(c) for c in cols]).alias("mean"))
    centres = means.agg(F.sort_array(F.collect_list(F.struct("cluster", "mean"))).alias("centres"))
    own = F.array(*[F.col(c).cast("double") for c in cols])

    def distance(centre):
        return F.aggregate(F.zip_with(own, centre["mean"], lambda a, b: (a - b) * (a - b)),
                           F.lit(0.0), lambda total, d: total + d)

    near = F.array_min(F.transform("centres", distance))
    mine = distance(F.filter("centres", lambda c: c["cluster"] == F.col("cluster"))[0])
    rows = attach(labelled, centres).agg(
        F.count("*").alias("clients"), F.count_distinct("cluster").alias("clusters"),
        F.sum((mine > near + 1e-9).cast("long")).alias("misplaced"))
    shown = cluster.cluster_summary(labelled, cols)
    off = shown.join(means, "cluster").agg(F.sum(F.aggregate(
        F.zip_with(F.array(*cols), "mean", lambda a, b: (F.abs(a - b) > 1e-9).cast("long")),
        F.lit(0).cast("long"), lambda total, d: total + d)).alias("summary_off"))
    sizes = cluster.cluster_sizes(labelled).agg(F.sum("clients").alias("sized"))
    return attach(attach(rows, off), sizes)


def _pca_facts(x: DataFrame, cols: list[str]) -> DataFrame:
    """Means, covariance and leading variance of the two components."""
    return cluster.pca_2d(x, cols).agg(
        F.avg("pca_x").alias("mean_x"), F.avg("pca_y").alias("mean_y"),
        F.covar_samp("pca_x", "pca_y").alias("covariance"),
        F.round(F.var_samp("pca_x"), 4).alias("variance"))


def _forest_facts(hourly: DataFrame) -> DataFrame:
    """At most the share asked for is flagged, and equal hours score the same."""
    scored = checkpoint(isolation.isolation_forest_anomalies(hourly))
    spread = scored.groupBy("requests").agg(
        (F.max("isolation_score") - F.min("isolation_score")).alias("spread")).agg(
        (F.max("spread") < 1e-9).alias("equal_scores"))
    return attach(scored.agg(
        F.count("*").alias("hours"),
        (F.sum(F.col("is_isolation_forest").cast("long")) <= F.ceil(F.count("*") * 0.05))
        .alias("few_flagged")), spread)


def _vote_facts(hourly: DataFrame) -> DataFrame:
    flags = ("is_zscore", "is_moving_average", "is_isolation_forest")
    total = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    return anomalies.detect_anomalies(hourly).select(
        "datetime", "is_zscore", "is_moving_average",
        ((F.col("anomaly_score") == total) & (F.col("is_anomaly") == (total > 0))).alias("adds_up"))


def _forecast_facts(hourly: DataFrame) -> DataFrame:
    """Hours of the forecast; whether its parts add up and its bounds hold it."""
    parts = F.col("trend") + F.col("daily") + F.col("weekly")
    return forecast.forecast(hourly).select(
        "ds", "is_future", (F.abs(F.col("yhat") - parts) < 1e-6).alias("adds_up"),
        F.col("yhat").between(F.col("yhat_lower"), F.col("yhat_upper")).alias("bounded"))


def _forecast_fit(hourly: DataFrame) -> DataFrame:
    """Whether the fitted hours are nearer to the history than its mean is."""
    rows = checkpoint(hourly)
    fitted = forecast.forecast(rows).select(F.col("ds").alias("datetime"), "yhat")
    error = F.sum((F.col("requests") - F.col("yhat")) ** 2)
    return rows.join(fitted, "datetime").agg(
        F.count("*").alias("hours"),
        (error <= F.var_pop("requests") * F.count("*")).alias("better_than_mean"))


def _forecast_certificate(hourly: DataFrame) -> DataFrame:
    """Terms of the design, and whether the gradient of each balances its prior."""
    rows = checkpoint(hourly)
    terms = forecast.certificate(rows, forecast.fit_forecast(rows))
    return terms.agg(F.count("*").alias("terms"), F.count_distinct("term").alias("distinct_terms"),
                     (F.max("violation") < 1e-4).alias("optimal"))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the traffic summary of the fixture log."""
    return queries()["overview"](spark, SMOKE_DIR)


FEATURE_COLUMNS = [
    "event_id", "datetime", "hour", "dayofweek", "month", "day", "is_weekend", "status", "is_error",
    "is_server_error", "is_client_error", "is_success", "bytes", "bytes_log", "response_time",
    "response_time_log", "uri_length", "has_query_params", "uri_depth", "file_extension"]
AGENT_COLUMNS = ["browser", "browser_version", "os", "device", "is_mobile", "is_bot"]
ATTACK_COLUMNS = ["event_id", "ip", "uri", "is_sql_injection", "is_xss", "is_traversal"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator; each callable takes (spark, sf_dir)."""
    by_method = {"keys": ["method"]}
    good = "layout is not null and datetime is not null"
    llm = {}
    if llm_queries is not None:
        llm = llm_queries.queries() | {"pipeline": corpus_pipeline.run}
    return {
        # sources
        "parsed_lines": lambda s, d: _tidy(_parsed(s, d).where(good).select(
            "datetime", "ip", "method", "uri", "status", "bytes", "response_time", "referer",
            "user_agent", "protocol", "cookie", "layout")),
        "quarantined_lines": lambda s, d: _tidy(_parsed(s, d).where(f"not ({good})").select("raw_line")),
        "standardized_log": lambda s, d: _tidy(_standardized(s, d).select(
            "event_id", "datetime", "ip", "method", "uri", "status", "bytes", "response_time",
            "referer", "user_agent")),
        "logs_from_files": lambda s, d: _tidy(_from_files(s, d)[0].drop("source_file", "identity", "user")),
        "quarantine_from_files": lambda s, d: _tidy(_from_files(s, d)[1].select("raw_line", "suffix")),
        "json_rows": _on_features(_json_rows),
        # row features
        "log_features": _on_features(lambda f: f, FEATURE_COLUMNS),
        "page_uri_features": lambda s, d: _tidy(features.uri_features(
            s.read.parquet(f"{d}/pages.parquet").select("page_id", F.col("url").alias("uri")))
            .drop("uri")),
        "user_agent_dim": lambda s, d: _tidy(features.user_agent_dim(_standardized(s, d))),
        "user_agent_features": lambda s, d: _tidy(features.enrich_user_agents(
            _standardized(s, d), via="dimension").select("event_id", *AGENT_COLUMNS)),
        "ip_features": _on_features(
            lambda f: f, ["event_id", "ip", "is_private_ip", "ip_first_octet", "subnet_class"]),
        # traffic
        "traffic_summary": _on_features(traffic.traffic_summary),
        "traffic_by_method": _on_features(lambda f: traffic.traffic_summary(f, **by_method)),
        "overview": _on_features(traffic.overview),
        "bandwidth_stats": _on_features(traffic.bandwidth_stats),
        "response_time_stats": _on_features(traffic.response_time_stats),
        "response_time_by_method": _on_features(
            lambda f: traffic.response_time_stats(f, **by_method)),
        "device_mix": _on_features(traffic.device_mix),
        "status_breakdown": _on_features(lambda f: traffic.top_values(f, "status", 10)),
        "top_ips": _on_features(lambda f: traffic.top_values(f, "ip", 10)),
        "top_uris": _on_features(lambda f: traffic.top_values(f, "uri", 10)),
        "top_user_agents": _on_features(lambda f: traffic.top_values(f, "user_agent", 5)),
        "top_uris_by_method": _on_features(lambda f: traffic.top_values(f, "uri", 3, **by_method)),
        "peak_hour": _on_features(lambda f: traffic.peak_period(f, "hour")),
        "peak_weekday": _on_features(lambda f: traffic.peak_period(f, "dayofweek")),
        "ranked_dimensions": _on_features(lambda f: traffic.ranked_dimensions(f, report.RANKED)),
        "hour_profile": _on_features(traffic.hour_profile),
        "peak_ratio": _on_features(traffic.peak_ratio),
        "ip_profile": _on_features(traffic.ip_profile),
        "ip_profile_head": _on_features(lambda f: traffic.ip_profile(f).orderBy("ip").limit(20)),
        # security
        "attack_hits": _on_features(security.attack_hits, ATTACK_COLUMNS),
        "attack_pattern_counts": _on_features(security.attack_pattern_counts),
        "ip_security_profile": _on_features(security.ip_security_profile),
        "distinct_times": _on_features(security.distinct_times),
        "suspicious_clients": _on_features(security.suspicious_clients),
        "suspicious_ips": _on_features(security.suspicious_ips),
        "threat_level": _on_features(security.threat_level),
        "threat_level_compat": _on_features(lambda f: security.threat_level(f, compat=True)),
        "security_recommendations": _on_features(security.security_recommendations),
        # performance
        "slow_requests": _on_features(
            performance.slow_requests, ["event_id", "ip", "uri", "response_time"]),
        "slow_request_stats": _on_features(performance.slow_request_stats),
        "slow_request_stats_by_method": _on_features(
            lambda f: performance.slow_request_stats(f, **by_method)),
        "performance_score": _on_features(performance.performance_score),
        "bottlenecks": _on_features(performance.bottlenecks),
        "resource_usage": _on_features(performance.resource_usage),
        "optimization_tips": _on_features(performance.optimization_tips),
        # time series
        "hourly_rollup": _on_hourly(lambda h: h),
        "daily_rollup": _on_features(lambda f: timeseries.rollup(f, "day")),
        "kept_hourly_rollup": _kept_rollup("hour"),
        "kept_daily_rollup": _kept_rollup("day"),
        "requests_per_hour": _on_features(lambda f: timeseries.rollup(f, "hour", ["rows"])),
        "hourly_rollup_by_method": _on_features(lambda f: timeseries.rollup(f, **by_method)),
        "rolling_stats": _on_hourly(
            timeseries.rolling_stats, ["datetime", "requests", "rolling_mean", "rolling_std"]),
        "zscore_anomalies": _on_hourly(
            timeseries.zscore_anomalies, ["datetime", "requests", "z_score", "is_zscore"]),
        "moving_average_anomalies": _on_hourly(
            timeseries.moving_average_anomalies, ["datetime", "requests", "is_moving_average"]),
        "anomaly_votes": _on_votes(lambda v: v.select(
            "datetime", "requests", "is_zscore", "is_moving_average", "anomaly_score", "is_anomaly")),
        "anomalous_hours": _on_votes(lambda v: v.where("is_anomaly").select(
            "datetime", "requests", "anomaly_score")),
        "short_series": lambda s, d: _tidy(_guards(s, d)),
        "anomaly_summary": _on_votes(anomalies.anomaly_summary),
        "error_rate_series": _on_hourly(timeseries.error_rate_series, ["datetime", "error_rate"]),
        "isolation_forest_anomalies": _on_hourly(isolation.isolation_forest_anomalies),
        "detect_anomalies": _on_hourly(anomalies.detect_anomalies),
        # clustering
        "scaled_profile": lambda s, d: _tidy(cluster.standardize_features(*_profile(s, d))),
        "dbscan_labels": _on_scaled(
            lambda x, c: dbscan.dbscan(x, c).select("ip", "outlier_cluster")),
        "dbscan_labels_two_features": _on_scaled(
            lambda x, c: dbscan.dbscan(x, TWO_FEATURES).select("ip", "outlier_cluster")),
        "dbscan_outliers": _on_scaled(
            lambda x, c: cluster.dbscan_outliers(dbscan.dbscan(x, TWO_FEATURES))
            .select("ip", "outlier_cluster")),
        "kmeans_clusters": _on_scaled(
            lambda x, c: cluster.kmeans_clusters(x, 3, c).select("ip", "cluster")),
        "choose_k": _on_scaled(_chosen_k),
        "cluster_sizes": _on_clusters(cluster.cluster_sizes),
        "cluster_summary": _on_clusters(cluster.cluster_summary),
        "cluster_points": lambda s, d: _tidy(cluster.cluster_points(
            cluster.cluster_ips(_features(s, d)))),
        "pca_2d": _on_scaled(lambda x, c: cluster.pca_2d(x, c).select("ip", "pca_x", "pca_y")),
        "pca_variance": _on_scaled(lambda x, c: cluster.pca(x, c).drop(*c)),
        # forecast
        "future_frame": _on_hourly(forecast.future_frame),
        "forecast": _on_hourly(forecast.forecast),
        "forecast_components": _on_hourly(
            lambda h: forecast.forecast_components(forecast.forecast(h))),
        "forecast_next_hours": _on_hourly(lambda h: forecast.next_hours(forecast.forecast(h))),
        "forecast_by_method": _on_features(
            lambda f: forecast.forecast(timeseries.rollup(f, **by_method), **by_method)),
        # streams
        "live_traffic": lambda s, d: _tidy(_streamed(
            live.live_traffic, ["window_start", "window_end"])(s, d)),
        "live_ip_profile": _live_profile,
        "live_attacks": lambda s, d: _tidy(_streamed(live.live_attacks)(s, d).select(
            *ATTACK_COLUMNS)),
        # everything
        "full_report": _report,
        # facts of the operators above that SQL can check
        "silhouette_bands": _on_scaled(_silhouette_bands),
        "silhouette_bounds": _on_scaled(_silhouette_bounds),
        "kmeans_facts": _on_scaled(_kmeans_facts),
        "pca_facts": _on_scaled(_pca_facts),
        "forest_facts": _on_hourly(_forest_facts),
        "vote_facts": _on_hourly(_vote_facts),
        "forecast_facts": _on_hourly(_forecast_facts),
        "forecast_fit": _on_hourly(_forecast_fit),
        "forecast_certificate": _on_hourly(_forecast_certificate),
        "report_sections": _report_sections,
    } | llm


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for every query that SQL can express."""
    llm = llm_queries.oracle_sql() if llm_queries is not None else {}
    if llm_queries is not None and corpus_pipeline.ORACLE_SQL is not None:
        llm = llm | {"pipeline": corpus_pipeline.ORACLE_SQL}
    return build() | llm
