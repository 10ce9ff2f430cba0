"""Threshold rules over aggregates, as rows of messages."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def messages(state: DataFrame, name: str, rules: list[tuple[Column, Column]], *,
             keys: Sequence[str] = ()) -> DataFrame:
    """One row per rule that holds, numbered in rule order."""
    fired = F.array_compact(F.array(*[F.when(condition, text) for condition, text in rules]))
    return (state.select(*keys, F.posexplode(fired).alias("position", name))
            .select(*keys, F.col("position").cast("long"), name))
