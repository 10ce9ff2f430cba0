"""Per-request features: one narrow projection, no shuffle and no Python."""

from pyspark.sql import DataFrame, functions as F

from hitlens.functions import agents, fields
from hitlens.operators.grouping import attach


def temporal_features(df: DataFrame) -> DataFrame:
    when = F.col("datetime")
    weekday = F.weekday(when)  # Monday = 0
    return df.withColumns({
        "hour": F.hour(when),
        "dayofweek": weekday,
        "month": F.month(when),
        "day": F.dayofmonth(when),
        "is_weekend": weekday.isin(5, 6).cast("int"),
    })


def status_features(df: DataFrame) -> DataFrame:
    status = F.col("status")
    return df.withColumn("status", fields.numeric(df, "status")).withColumns({
        "is_error": fields.flag(status >= 400),
        "is_server_error": fields.flag(status >= 500),
        "is_client_error": fields.flag((status >= 400) & (status < 500)),
        "is_success": fields.flag(status < 400),
    })


def size_features(df: DataFrame) -> DataFrame:
    for name in ("bytes", "response_time"):
        if name in df.columns:
            value = F.coalesce(fields.numeric(df, name), F.lit(0.0))
            df = (df.withColumn(name, value)
                  .withColumn(f"{name}_log", F.log1p(name)))
    return df


def uri_features(df: DataFrame) -> DataFrame:
    if "uri" not in df.columns:
        return df
    uri = F.col("uri")
    return df.withColumns({
        "uri_length": F.coalesce(F.length(uri), F.lit(0)),
        "has_query_params": fields.flag(uri.contains("?")),
        "uri_depth": F.coalesce(fields.occurrences(uri, "/"), F.lit(0)),
        "file_extension": fields.file_extension(uri),
    })


def user_agent_dim(df: DataFrame, rules=None) -> DataFrame:
    """One row per distinct user agent with its classification."""
    return (df.select("user_agent").distinct()
            .withColumns(agents.agent_columns("user_agent", rules)))


def enrich_user_agents(df: DataFrame, rules=None, via: str = "inline") -> DataFrame:
    """Add browser, os, device, is_mobile and is_bot.

    ``inline`` evaluates the rules on each row, which needs no shuffle. ``dimension``
    classifies each distinct agent once and joins back, frequent agents salted; it pays
    off for expensive rule sets. Catalyst broadcasts the dimension where its measured size
    allows.
    """
    if "user_agent" not in df.columns:
        return df
    if via == "inline":
        return df.withColumns(agents.agent_columns("user_agent", rules))
    if via != "dimension":
        raise ValueError(f"via must be 'inline' or 'dimension', not {via!r}")
    return attach(df, user_agent_dim(df, rules), ["user_agent"])


def ip_features(df: DataFrame) -> DataFrame:
    octet = F.col("_octet")
    return (df.withColumn("_octet", fields.first_octet(F.col("ip"))).withColumns({
        "is_private_ip": fields.is_private(octet),
        "ip_first_octet": F.coalesce(octet, F.lit(0)),
        "subnet_class": fields.subnet_class(octet),
    }).drop("_octet"))


def extract_features(df: DataFrame, rules=None) -> DataFrame:
    """All request features; a feature whose source column is absent is left out."""
    df = temporal_features(df)
    df = status_features(df)
    df = size_features(df)
    df = uri_features(df)
    df = enrich_user_agents(df, rules)
    return ip_features(df)
