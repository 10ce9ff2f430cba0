"""Attack signatures, suspicious clients and the rules built on them."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hitlens.functions.fields import ATTACK_LABELS, ATTACK_TOKENS, attack_flag
from hitlens.operators.grouping import attach, attach_per_group
from hitlens.operators.rules import messages
from hitlens.session import checkpoint

# Thresholds of the suspicion and threat rules.
ERROR_SHARE = 0.5
VOLUME_SHARE = 0.1
MAX_URIS = 100
REPORTED_IPS = 10
HIGH_THREATS = 10
MEDIUM_THREATS = 5


def attack_flags(df: DataFrame) -> DataFrame:
    """Add one 1/0 flag per signature; a URI may carry several."""
    return df.withColumns({f"is_{kind}": attack_flag(F.col("uri"), kind) for kind in ATTACK_TOKENS})


def attack_hits(df: DataFrame) -> DataFrame:
    """Requests matching any signature."""
    flags = [F.col(f"is_{kind}") for kind in ATTACK_TOKENS]
    return attack_flags(df).where(F.greatest(*flags) == 1)


def attack_pattern_counts(df: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Requests per signature, only those that occur, with the report line."""
    counts = attack_flags(df).groupBy(*keys).agg(
        *[F.sum(f"is_{kind}").alias(kind) for kind in ATTACK_TOKENS])
    long = counts.unpivot(list(keys), list(ATTACK_TOKENS), "pattern", "requests")
    label = F.create_map(*[F.lit(x) for pair in ATTACK_LABELS.items() for x in pair])
    return (long.where(F.col("requests") > 0)
            .withColumn("message", F.format_string(
                "%s: %d requests", label[F.col("pattern")], F.col("requests"))))


def ip_security_profile(df: DataFrame, *, keys: Sequence[str] = (),
                        approx: bool = False) -> DataFrame:
    """Requests, errors, distinct times and distinct URIs per client.

    Spark spreads the distinct counts over (ip, value), so one scanner with millions of
    URIs is counted by many tasks. ``approx`` counts them by mergeable sketches instead, which
    shuffles one row per client and task.
    """
    count_distinct = F.approx_count_distinct if approx else F.count_distinct
    uris = count_distinct(F.col("uri")) if "uri" in df.columns else F.lit(0).cast("long")
    return df.where(F.col("ip").isNotNull()).groupBy(*keys, "ip").agg(
        F.count("is_error").alias("is_error_count"),
        F.sum("is_error").alias("is_error_sum"),
        F.avg("is_error").alias("is_error_mean"),
        F.count("datetime").alias("datetime_count"),
        count_distinct(F.col("datetime")).alias("datetime_nunique"),
        uris.alias("uri_nunique"))


def distinct_times(df: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct request times in the whole log."""
    return df.groupBy(*keys).agg(F.count_distinct(F.col("datetime")).alias("distinct_times"))


# Base-2 logarithm of the hashes a client's set of URIs holds: more than the limit of the rule.
_SET = (MAX_URIS + 1).bit_length()


def _suspicion(uris: str = "uri_nunique") -> Column:
    return ((F.col("is_error_mean") > ERROR_SHARE)
            | (F.col("datetime_count") > F.col("distinct_times") * VOLUME_SHARE)
            | (F.col(uris) > MAX_URIS))


def _suspects(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Suspicious clients with their requests and errors, and the distinct times of the log.

    The rule asks only whether a client has more than 100 URIs. A mergeable set of the 128 least hashes
    answers that exactly: it is complete up to 128 URIs, and beyond them its estimate is above 128. So tasks
    send one bounded row per client, and no URI is shuffled.
    """
    # hashed first, as the set would leave out empty texts
    uri = F.when(F.col("uri").isNotNull(), F.xxhash64("uri")) if "uri" in df.columns else F.lit(None).cast("long")
    profile = df.where(F.col("ip").isNotNull()).groupBy(*keys, "ip").agg(
        F.count("is_error").alias("is_error_count"),
        F.sum("is_error").alias("is_error_sum"),
        F.avg("is_error").alias("is_error_mean"),
        F.count("datetime").alias("datetime_count"),
        F.theta_sketch_estimate(F.theta_sketch_agg(uri, _SET)).alias("_uris"))
    return attach(profile, distinct_times(df, keys=keys), keys).where(_suspicion("_uris")).drop("_uris")


def suspicious_clients(df: DataFrame, *, keys: Sequence[str] = (),
                       approx: bool = False) -> DataFrame:
    """Every client with mostly errors, an unusual volume or scanning behaviour.

    Distinct times and URIs are counted for the suspicious clients alone. With ``approx`` they are
    estimated for every client, so clients near the limit may differ.
    """
    if approx:
        profile = ip_security_profile(df, keys=keys, approx=True)
        return attach(profile, distinct_times(df, keys=keys), keys).where(_suspicion())
    suspects = checkpoint(_suspects(df, keys))
    columns = ["datetime", *(["uri"] if "uri" in df.columns else [])]
    requests = attach(df.select(*keys, "ip", *columns), suspects.select(
        *keys, "ip", F.lit(True).alias("_suspect")), [*keys, "ip"]).where("_suspect")
    uris = F.count_distinct(F.col("uri")) if "uri" in df.columns else F.lit(0).cast("long")
    exact = requests.groupBy(*keys, "ip").agg(
        F.count_distinct(F.col("datetime")).alias("datetime_nunique"), uris.alias("uri_nunique"))
    return attach_per_group(suspects, exact, [*keys, "ip"]).select(
        *keys, "ip", "is_error_count", "is_error_sum", "is_error_mean", "datetime_count", "datetime_nunique",
        "uri_nunique", "distinct_times")


def first_clients(suspects: DataFrame, limit: int = REPORTED_IPS, *,
                  keys: Sequence[str] = ()) -> DataFrame:
    """The first suspicious clients by address, as reported."""
    if not keys:
        return suspects.orderBy("ip").limit(limit)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("ip"))
    return suspects.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def suspicious_ips(df: DataFrame, limit: int = REPORTED_IPS, *, keys: Sequence[str] = ()) -> DataFrame:
    """The first suspicious clients of a log."""
    return first_clients(suspicious_clients(df, keys=keys), limit, keys=keys)


def level_of(suspects: DataFrame, *, keys: Sequence[str] = (), compat: bool = False) -> DataFrame:
    """Threat level from the rows of ``suspects`` (those with a client)."""
    total = F.col("total_suspicious")
    judged = F.least(total, F.lit(REPORTED_IPS)) if compat else total
    level = (F.when(judged > HIGH_THREATS, "High").when(judged > MEDIUM_THREATS, "Medium")
             .otherwise("Low"))
    return (suspects.groupBy(*keys).agg(F.count("ip").alias("total_suspicious"))
            .select(*keys, level.alias("threat_level"),
                    F.least(total, F.lit(REPORTED_IPS)).cast("long").alias("total_threats"), total))


def threat_level(df: DataFrame, *, keys: Sequence[str] = (), compat: bool = False) -> DataFrame:
    """Level from the number of suspicious clients.

    ``total_threats`` is the reported number, at most ten; ``total_suspicious`` is the
    full one. ``compat`` derives the level from the reported number, so that High cannot
    occur.
    """
    suspects = _suspects(df, keys)
    if keys:  # a key without suspects still gets its row
        suspects = df.select(*keys).distinct().unionByName(
            suspects.select(*keys, "ip"), allowMissingColumns=True)
    return level_of(suspects, keys=keys, compat=compat)


# The advice, word for word.
ADVICE = {
    "clients": "Consider blocking or rate-limiting suspicious IP addresses",
    "errors": "High error rate detected - review server configuration",
    "bots": "High bot traffic - implement bot protection measures",
}


def recommendations_for(df: DataFrame, level: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Advice rows, in report order, given the threat level."""
    bots = F.avg("is_bot") if "is_bot" in df.columns else F.lit(0.0)
    shares = df.groupBy(*keys).agg(F.avg("is_error").alias("error_share"), bots.alias("bot_share"))
    state = attach_per_group(shares, level.select(*keys, "total_suspicious"), keys)
    return messages(state, "recommendation", [
        (F.col("total_suspicious") > 0, F.lit(ADVICE["clients"])),
        (F.col("error_share") > 0.1, F.lit(ADVICE["errors"])),
        (F.col("bot_share") > 0.3, F.lit(ADVICE["bots"])),
    ], keys=keys)


def security_recommendations(df: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Advice rows, in report order."""
    return recommendations_for(df, threat_level(df, keys=keys), keys=keys)
