"""Isolation forest. Trees are small by definition (a few hundred sampled rows each), so
they grow in parallel, one task group per tree, and act as a bounded model.

Nothing is drawn from a random generator: which rows a tree samples, and where a node splits, are
md5 sums of (seed, tree, row or node) read as numbers of the unit line. A forest is the same on every
engine that has md5, and does not depend on the order of rows or on partitions.
"""

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from hitlens.operators.grouping import attach
from hitlens.operators.quantiles import exact_quantile
from hitlens.session import checkpoint

_TREE = ("tree long, rows long, feature array<int>, threshold array<double>, "
         "below array<int>, above array<int>, path array<double>")
_OVERSAMPLE = 2
# Hex digits of a checksum that make a number of the unit line.
_DIGITS = 13


def unit(text: Column) -> Column:
    """A pseudo-random number in [0, 1) for a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _DIGITS), 16, 10).cast("double") / 16.0 ** _DIGITS


def _unit(text: str) -> float:
    return int(hashlib.md5(text.encode()).hexdigest()[:_DIGITS], 16) / 16.0 ** _DIGITS


def _expected_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    if n < 2:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, name: str, max_depth: int):
    """Splits down to single rows, equal rows or the depth limit, drawn for the tree's name.

    Nodes are numbered as in a heap: the root is 1, the children of n are 2 n and 2 n + 1.
    """
    feature, threshold, below, above, path = [], [], [], [], []

    def node(rows, depth, number):
        me = len(feature)
        for column, value in ((feature, -1), (threshold, 0.0), (below, -1), (above, -1),
                              (path, depth + _expected_path(len(rows)))):
            column.append(value)
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth < max_depth and usable.size:
            f = int(usable[int(_unit(f"{name}|{number}|feature") * usable.size)])
            cut = float(low[f] + _unit(f"{name}|{number}|cut") * (high[f] - low[f]))
            left = x[rows, f] <= cut
            feature[me], threshold[me] = f, cut
            below[me] = node(rows[left], depth + 1, 2 * number)
            above[me] = node(rows[~left], depth + 1, 2 * number + 1)
        return me

    node(np.arange(len(x)), 0, 1)
    return feature, threshold, below, above, path


def _score(x: np.ndarray, forest) -> np.ndarray:
    """2 ** -(mean path / expected path): near 1 for rows that are isolated early."""
    total = np.zeros(len(x))
    for _, _, feature, threshold, below, above, path in forest:
        feature, threshold = np.asarray(feature), np.asarray(threshold)
        below, above, path = np.asarray(below), np.asarray(above), np.asarray(path)
        at = np.zeros(len(x), dtype=int)
        inner = feature[at] >= 0
        while inner.any():
            rows, nodes = np.flatnonzero(inner), at[inner]
            left = x[rows, feature[nodes]] <= threshold[nodes]
            at[rows] = np.where(left, below[nodes], above[nodes])
            inner = feature[at] >= 0
        total += path[at]
    expected = _expected_path(max(int(tree[1]) for tree in forest)) if forest else 0.0
    if expected == 0.0:
        return np.full(len(x), 0.5)
    return np.power(2.0, -total / len(forest) / expected)


def _forest(df: DataFrame, cols: list[str], keys: list[str], ids: list[str], trees: int, sample: int,
            seed: int) -> DataFrame:
    """One row per (key and) tree, grown on its own hash-ordered sample.

    One number places a row among the trees: it joins every tree whose share of the unit line
    it meets, about twice the sample per tree, and only those rows exist. The exact sample of
    a tree is the least of a second draw.
    """
    size = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    share = F.least(F.lit(1.0), F.lit(float(_OVERSAMPLE * sample)) / F.col("_rows"))
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*keys, *ids]]
    joins = F.ceil(F.lit(trees) * F.col("_share") - F.col("_place")).cast("int")
    drawn = (attach(df, size, keys).withColumn("_share", share).withColumn("_row", F.concat_ws("|", *own))
             .withColumn("_place", unit(F.concat(F.lit(f"{seed}|"), F.col("_row"))))
             .withColumn("_join", F.explode(F.when(joins > 0, F.sequence(F.lit(0), joins - 1))))
             .withColumn("tree", F.floor((F.col("_place") + F.col("_join")) / F.col("_share")))
             .where(F.col("tree") < trees)
             .withColumn("_draw", unit(F.concat_ws("|", F.lit(f"{seed}"), F.col("tree").cast("string"), "_row"))))
    depth = int(np.ceil(np.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_draw", "_row", *cols], kind="stable").head(sample)
        tree = int(pdf["tree"].iloc[0])
        name = "|".join(map(str, [seed, *(pdf[k].iloc[0] for k in keys), tree]))
        grown = _grow(pdf[cols].to_numpy(float), name, depth)
        values = {k: [pdf[k].iloc[0]] for k in keys}
        values |= {"tree": [tree], "rows": [len(pdf)]}
        values |= dict(zip(("feature", "threshold", "below", "above", "path"),
                           ([column] for column in grown)))
        return pd.DataFrame(values)

    schema = T.StructType([df.schema[k] for k in keys] + T.StructType.fromDDL(_TREE).fields)
    return (drawn.select(*keys, *[c for c in cols if c not in keys], "tree", "_draw", "_row")
            .groupBy(*keys, "tree").applyInPandas(grow, schema))


def isolation_forest_anomalies(df: DataFrame, cols: Sequence[str] = ("requests",), *,
                               trees: int = 100, sample: int = 256, contamination: float = 0.05,
                               seed: int = 42, keys: Sequence[str] = (),
                               ids: Sequence[str] | None = None) -> DataFrame:
    """Add ``isolation_score`` and ``is_isolation_forest``.

    Flagged are the rows scoring beyond the ``1 - contamination`` quantile of the scores;
    equal rows score the same, so a constant series has no anomaly. The input is read
    several times and is therefore checkpointed first. Sampled rows differ from those of
    implementations that draw at random, and so do scores in detail. Samples tell rows apart by the
    columns ``ids``: ``datetime`` where there is one, else all columns.
    """
    cols, keys = list(cols), list(keys)
    ids = list(ids or (["datetime"] if "datetime" in df.columns else df.columns))
    rows = checkpoint(df)
    forest = _forest(rows, cols, keys, ids, trees, sample, seed)
    scored_schema = T.StructType(rows.schema.fields + [T.StructField("isolation_score", T.DoubleType())])
    names = ["tree", "rows", "feature", "threshold", "below", "above", "path"]
    if keys:
        def score_group(pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
            forest = model.sort_values("tree")[names].itertuples(index=False, name=None)
            return pdf.assign(isolation_score=_score(pdf[cols].to_numpy(float), list(forest)))

        # a series has one row per bucket of time, a forest a fixed number of nodes
        scored = (rows.groupBy(*keys).cogroup(forest.groupBy(*keys))
                  .applyInPandas(score_group, scored_schema))
    else:
        # the model is bounded: trees x (2 x sample - 1) nodes
        model = [tuple(r) for r in forest.select(*names).orderBy("tree").collect()]

        @F.pandas_udf("double")
        def score(*series: pd.Series) -> pd.Series:
            return pd.Series(_score(np.column_stack([s.to_numpy(float) for s in series]), model))

        scored = rows.withColumn("isolation_score", score(*cols))
    scored = checkpoint(scored)
    limit = exact_quantile(scored, "isolation_score", 1 - contamination, keys=keys, name="_limit")
    # a rounding step apart is a tie, not an outlier
    return (attach(scored, limit, keys)
            .withColumn("is_isolation_forest",
                        F.coalesce(F.col("isolation_score") > F.col("_limit") + 1e-12, F.lit(False)))
            .drop("_limit"))
