"""Exact quantiles without holding a group in one buffer."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from hitlens.operators.grouping import attach

_ACCURACY = 100_000
_SLICES = 1024


def exact_quantile(df: DataFrame, column: str, q: float, *, keys: Sequence[str] = (),
                   name: str = "quantile") -> DataFrame:
    """Linear-interpolated quantile per key (or overall).

    The ``percentile`` aggregate keeps every distinct value of a group in one hash map.
    Here a mergeable sketch first brackets the wanted rank; one partially aggregated pass
    then counts rows below the bracket and per value inside it. The bracket is cut into
    slices, and only the values of the one or two slices that hold the wanted ranks are
    ordered. The answer is exact: the bracket is wider than the sketch error.
    """
    keys = list(keys)
    margin = 4.0 / _ACCURACY
    values = df.where(F.col(column).isNotNull()).select(
        *keys, F.col(column).alias("_v"), F.lit(1).cast("long").alias("_c"))
    bounds = values.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("_v", max(0.0, q - margin), _ACCURACY).alias("_lo0"),
        F.percentile_approx("_v", min(1.0, q + margin), _ACCURACY).alias("_hi0"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    # for few rows, or near either end, the neighbouring rank may lie outside the bracket
    few = F.col("_n") * margin < 4
    bounds = bounds.select(
        *keys, "_n",
        F.when(few | F.lit(q <= margin), F.col("_min")).otherwise(F.col("_lo0")).alias("_lo"),
        F.when(few | F.lit(q >= 1 - margin), F.col("_max")).otherwise(F.col("_hi0")).alias("_hi"))
    if keys:  # the bounds are joined, so shrink the rows first
        values = values.groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"))
    width = F.col("_hi") - F.col("_lo")
    place = F.least(F.lit(_SLICES - 1), F.floor(
        F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), width), F.lit(0.0)) * _SLICES))
    inside = F.col("_v") >= F.col("_lo")
    counted = (attach(values, bounds, keys)
               .where(F.col("_v") <= F.col("_hi"))
               .groupBy(*keys, F.when(inside, place).otherwise(-1).cast("int").alias("_slice"),
                        F.when(inside, F.col("_v")).alias("_v"))
               .agg(F.sum("_c").alias("_c"), F.first("_n").alias("_n")))
    position = (F.col("_n") - 1) * F.lit(float(q))
    low, high = F.floor(position), F.ceil(position)

    def holds(rank, end, size):
        return (F.col(end) > rank) & (F.col(end) - F.col(size) <= rank)

    slices = counted.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_size"), F.first("_n").alias("_n"))
    upto = F.sum("_size").over(W.partitionBy(*keys).orderBy("_slice"))  # at most _SLICES + 1 rows
    wanted = (slices.withColumn("_upto", upto)
              .where(holds(low, "_upto", "_size") | holds(high, "_upto", "_size"))
              .select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_slice").alias("_key_slice"),
                      (F.col("_upto") - F.col("_size")).alias("_before")))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    ranked = (counted.join(wanted, [*same, F.col("_slice") == F.col("_key_slice")])
              .withColumn("_end", F.col("_before") + F.sum("_c").over(
                  W.partitionBy(*keys, "_slice").orderBy("_v"))))
    return (ranked.groupBy(*keys)
            .agg(F.max(F.when(holds(low, "_end", "_c"), F.col("_v"))).alias("_a"),
                 F.max(F.when(holds(high, "_end", "_c"), F.col("_v"))).alias("_b"),
                 F.max(position - low).alias("_f"))
            .select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias(name)))
