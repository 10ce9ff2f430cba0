"""Helpers to attach group-level numbers to rows without cross joins or hot tasks."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from hitlens.session import checkpoint

# Rows of one key that a task may get; a key with more is spread over as many salts as needed.
TARGET_ROWS = 500_000
# A table of one row per key is broadcast up to so many bytes (as JSON text), and joined beyond.
BROADCAST_BYTES = 16 << 20


def measured_bytes(df: DataFrame) -> int:
    """Size of a table as JSON text, summed on the executors."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def with_salts(rows: DataFrame, counts: DataFrame, keys: Sequence[str], count: str = "count",
               target: int = TARGET_ROWS) -> DataFrame:
    """Add ``_salt`` and ``_salts``: a key of n rows gets ceil(n / target) salts.

    A row's salt comes from the hash of its columns, so it is the same when a lost task runs
    again. Keys of more than ``target`` rows are at most rows / target, hence the broadcast.
    """
    hot = counts.where(F.col(count) > target).select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys],
        F.ceil(F.col(count) / target).cast("int").alias("_salts"))
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    drawn = F.xxhash64(*[f"`{f.name}`" for f in rows.schema.fields
                         if not isinstance(f.dataType, T.MapType)])
    return (rows.join(F.broadcast(hot), same, "left").drop(*[f"_hot_{k}" for k in keys])
            .withColumn("_salts", F.coalesce("_salts", F.lit(1)))
            .withColumn("_salt", F.pmod(drawn, F.col("_salts")).cast("int")))


def salted_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], counts: DataFrame,
                how: str = "left", *, count: str = "count",
                target: int = TARGET_ROWS) -> DataFrame:
    """Null-safe join of rows with a table of one row per key.

    ``counts`` holds the rows of each key; a column ``count`` of the lookup does the same for it
    and is not part of the result. Rows of a hot key are spread over its salts and its
    lookup row is copied to each. Adaptive skew handling would not do: it does not split a
    side that shares the shuffle of an aggregate.
    """
    left = with_salts(rows, counts, keys, count, target).drop("_salts")
    names = [c for c in lookup.columns if c not in (*keys, count)]
    if count in lookup.columns:  # a lookup row that knows its rows needs no list of hot keys
        lookup = lookup.withColumn("_salts", F.greatest(F.ceil(F.col(count) / target), F.lit(1)))
    else:
        lookup = with_salts(lookup, counts, keys, count, target)
    right = lookup.withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], *names, "_copy")
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return (left.join(right, [*same, F.col("_salt") == F.col("_copy")], how)
            .drop(*[f"_key_{k}" for k in keys], "_salt", "_copy"))


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str] = (), *,
           limit: int = BROADCAST_BYTES) -> DataFrame:
    """Add the columns of ``stats`` (one row per key, or one row) to ``df``.

    Without keys the row becomes a scalar subquery: nothing is joined. With keys the table is
    computed and measured: up to ``limit`` bytes it is broadcast and no row of ``df`` is
    shuffled, beyond it the rows per key are counted and the join is salted by them.
    """
    names = [c for c in stats.columns if c not in keys]
    if not keys:
        row = stats.select(F.struct(*names)).scalar()
        return (df.withColumn("_stats", row)
                .withColumns({n: F.col(f"_stats.{n}") for n in names}).drop("_stats"))
    lookup = checkpoint(stats)
    if measured_bytes(lookup) > limit:
        counts = df.groupBy(*keys).agg(F.count("*").alias("count"))
        return salted_join(df, lookup, keys, counts)
    right = F.broadcast(lookup.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *names))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return df.join(right, same, "left").drop(*[f"_key_{k}" for k in keys])


def attach_per_group(groups: DataFrame, stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``attach`` for a table that has one row per key itself: no key can be hot."""
    if not keys:
        return attach(groups, stats)
    names = [c for c in stats.columns if c not in keys]
    right = stats.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *names)
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return groups.join(right, same, "left").drop(*[f"_key_{k}" for k in keys])
