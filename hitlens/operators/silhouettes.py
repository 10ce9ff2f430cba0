"""Mean silhouettes of k-means labellings for several k, without the distances of all pairs.

By squared distance a silhouette needs each cluster's mean and spread only. By plain distance it is
bracketed: for the n points of a cell with mean m and mean squared distance v from it, the sum of distances from x
lies between n |x - m| and n sqrt(|x - m|^2 + v), as the norm is convex and the root concave. Cells are
the nearest of a number of pivots, so the work is points times cells. A k whose upper bound stays
below another one's lower bound is out; more cells are tried for the others, and exact distances only for
those that the finest cells leave open. With a pivot at every distinct point the bounds are exact.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hitlens.operators.distances import strips
from hitlens.operators.kmeans import STEPS, Model, matrices, squared_distances

# Numbers of pivots tried one after another: the last bounds what is broadcast.
CELLS = (256, 1024, 4096)
# Bounds this close to each other count as equal.
TIE = 1e-9
_SEED = 7


def _score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    top = np.maximum(a, b)
    return np.divide(b - a, top, out=np.zeros_like(top), where=top > 0)


def _means_over(points: DataFrame, scores, ks: Sequence[int], width: int) -> dict[int, tuple[float, float]]:
    """Mean of two scores per k over all points; ``scores(x, k)`` gives them for rows of points."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(ks), 2)), 0
        for x in matrices(batches, width):
            n += len(x)
            for i, k in enumerate(ks):
                total[i] += [s.sum() for s in scores(x / STEPS, k)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(ks), pa.int64()), pa.array(total[:, 0]), pa.array(total[:, 1]),
             pa.array([n] * len(ks), pa.int64())], names=["k", "low", "high", "n"])

    rows = points.select("x").mapInArrow(run, "k long, low double, high double, n long").groupBy("k").agg(
        (F.sum("low") / F.sum("n")).alias("low"), (F.sum("high") / F.sum("n")).alias("high")).collect()
    return {r.k: (r.low, r.high) for r in rows}


def _pick(sums_low, sums_high, sizes: np.ndarray, own: np.ndarray):
    """Lower and upper scores from bounds of the distance sums (rows x clusters)."""
    rows, some = np.arange(len(own)), sizes > 0
    others = np.where(some, np.maximum(sizes, 1), 1)
    alone = sizes[own] < 2
    rest = np.maximum(sizes[own] - 1, 1)
    bounds = []
    for sums in (sums_low, sums_high):
        mean = np.where(some, sums / others, np.inf)
        a = sums[rows, own] / rest
        mean[rows, own] = np.inf
        bounds.append((a, mean.min(axis=1)))
    (a_low, b_low), (a_high, b_high) = bounds
    found = (_score(a_high, b_low), _score(a_low, b_high))
    return tuple(np.where(alone | ~np.isfinite(b_low), 0.0, s) for s in found)


def squared(points: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Mean silhouette by squared distance for each k, in one pass."""
    facts = {k: (m.centres, np.array(m._means()), np.array(m.sizes, float), m.spread()) for k, m in models.items()}
    width = len(next(iter(facts.values()))[0][0]) if facts else 0

    def scores(x, k):
        centres, means, sizes, spread = facts[k]
        own = squared_distances(x, centres).argmin(axis=1)
        sums = (squared_distances(x, means) + spread) * sizes
        return _pick(sums, sums, sizes, own)

    return {k: low for k, (low, _) in _means_over(points, scores, list(models), width).items()}


def _pivots(points: DataFrame, cells: int) -> np.ndarray:
    """Distinct points of the least hashes."""
    rows = points.select("x").distinct().orderBy(F.xxhash64(F.lit(_SEED), "x"), "x").limit(cells).toArrow()
    return np.array(rows.column("x").to_pylist(), float) / STEPS


def _entries(points: DataFrame, models: dict[int, Model], pivots: np.ndarray) -> dict[int, tuple]:
    """Per k: (cluster, size, mean, spread) of every cell and cluster that share a point."""
    width = pivots.shape[1]
    ks = list(models)
    centres = {k: models[k].centres for k in ks}
    named = ["k", "cell", "cluster", "n", "v", *[f"s{d}" for d in range(width)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[tuple, np.ndarray] = {}
        for x in matrices(batches, width):
            x = x / STEPS
            cell = np.concatenate([near.argmin(axis=1) for _, near in strips(x, pivots)])
            offset = x - pivots[cell]
            values = np.column_stack([np.ones(len(x)), (offset * offset).sum(axis=1), offset])
            for k in ks:
                key = cell * k + squared_distances(x, centres[k]).argmin(axis=1)
                order = np.argsort(key, kind="stable")
                at = np.flatnonzero(np.diff(key[order], prepend=-1))
                for own, sums in zip(key[order][at].tolist(), np.add.reduceat(values[order], at)):
                    known = table.get((k, own))
                    table[k, own] = sums if known is None else known + sums
        keys = list(table)
        sums = np.array([table[key] for key in keys]).reshape(len(keys), width + 2)
        number = np.array(keys, np.int64).reshape(len(keys), 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(number[:, 0]), pa.array(number[:, 1] // np.maximum(number[:, 0], 1)),
             pa.array(number[:, 1] % np.maximum(number[:, 0], 1)), *[pa.array(c) for c in sums.T]], names=named)

    schema = "k long, cell long, cluster long, " + ", ".join(f"{n} double" for n in named[3:])
    rows = points.select("x").mapInArrow(run, schema).groupBy("k", "cell", "cluster").agg(
        *[F.sum(n).alias(n) for n in named[3:]]).toArrow()
    k, cell, cluster, n, v = (rows.column(c).to_numpy() for c in named[:5])
    mean = np.column_stack([rows.column(f"s{d}").to_numpy() for d in range(width)]) / n[:, None]
    spread = np.maximum(v / n - (mean * mean).sum(axis=1), 0)
    mean += pivots[cell]
    order = np.lexsort((cell, cluster, k))  # a cluster's cells side by side
    return {own: tuple(c[order[k[order] == own]] for c in (cluster, n, mean, spread)) for own in ks}


def bounds(points: DataFrame, models: dict[int, Model], cells: int) -> dict[int, tuple[float, float]]:
    """(lower, upper) bound of the mean silhouette by plain distance for each k."""
    pivots = _pivots(points, cells)
    entries = _entries(points, models, pivots)
    facts = {k: (m.centres, np.array(m.sizes, float)) for k, m in models.items()}

    def scores(x, k):
        centres, sizes = facts[k]
        cluster, n, mean, spread = entries[k]
        own = squared_distances(x, centres).argmin(axis=1)
        runs = np.flatnonzero(np.diff(cluster, prepend=-1))
        filled = cluster[runs]
        low, high = np.zeros((len(x), len(sizes))), np.zeros((len(x), len(sizes)))
        for start, near in strips(x, mean):
            rows = slice(start, start + len(near))
            low[rows, filled] = np.add.reduceat(np.sqrt(near) * n, runs, axis=1)
            near += spread
            high[rows, filled] = np.add.reduceat(np.sqrt(near, out=near) * n, runs, axis=1)
        return _pick(low, high, sizes, own)

    return _means_over(points, scores, list(models), pivots.shape[1])


def open_ks(found: dict[int, tuple[float, float]]) -> list[int]:
    """The ks that may have the greatest silhouette."""
    most = max(low for low, _ in found.values())
    return [k for k, (_, high) in found.items() if high >= most - TIE]


def euclidean(points: DataFrame, models: dict[int, Model], cells: Sequence[int] = CELLS) -> dict[int, tuple[float, float]]:
    """Bounds for every k, finer for those that may be the greatest; stops when one is left."""
    found: dict[int, tuple[float, float]] = {}
    wanted = list(models)
    for number in cells:
        found |= bounds(points, {k: models[k] for k in wanted}, number)
        wanted = open_ks(found)
        if len(wanted) < 2 or all(high - low <= TIE for low, high in (found[k] for k in wanted)):
            break
    return found
