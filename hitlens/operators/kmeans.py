"""K-means for every number of clusters and every start at once.

All models, a few dozen matrices of at most ``max(ks)`` centres, are carried by one Lloyd loop: a round is one
pass over the points that adds up every cluster of every model map-side. A model leaves the loop when its
centres move by less than a tolerance; the start of least cost goes on for each k until its sums stay the
same. Coordinates are fixed-point numbers and sums are added as whole
numbers, so that neither partitions nor the order of rows change a result in the last digit.

Starts are drawn by k-means++ from a bounded sample, the points of the least hashes of (seed, id).
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Fixed-point steps of a coordinate, and of a squared distance in the cost.
STEPS, COST_STEPS = 1 << 30, 1 << 20
# Points the starts are drawn from; rounds at most; squared move of the centres, in shares of a
# coordinate's mean variance, at which starts are compared.
SAMPLE, ROUNDS, TOLERANCE = 4096, 300, 1e-4
# Points per task at least: a round of fewer is all start-up.
TASK_POINTS = 10_000
# A coordinate's low part: sums of the parts stay whole in doubles within a strip, in longs beyond.
_LOW, _STRIP = 24, 2048
# Rows whose distances from a few hundred centres stay in a processor's cache.
_ROUND_STRIP = 128


def fixed_point(df: DataFrame, cols: Sequence[str], id_col: str = "ip") -> DataFrame:
    """(id, x): coordinates as whole numbers of ``STEPS``, in tasks of ``TASK_POINTS`` or more."""
    return df.coalesce(-(-df.count() // TASK_POINTS) or 1).select(F.col(id_col).alias("id"), F.array(
        *[F.round(F.col(c).cast("double") * STEPS).cast("long") for c in cols]).alias("x"))


def matrices(batches: Iterator[pa.RecordBatch], width: int, strip: int = _STRIP) -> Iterator[np.ndarray]:
    """Fixed-point coordinates in strips of rows."""
    for batch in batches:
        flat = batch.column("x").flatten().to_numpy()
        rows = flat.reshape(-1, width)
        for start in range(0, len(rows), strip):
            yield rows[start:start + strip]


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Row by row the same numbers, whatever rows are beside it."""
    out = np.zeros((len(x), len(centres)))
    gap = np.empty_like(out)
    columns = np.ascontiguousarray(centres.T)  # much faster to run along
    for d in range(x.shape[1]):
        np.subtract(x[:, d, None], columns[d], out=gap)
        gap *= gap
        out += gap
    return out


@dataclass
class Model:
    """Centres of one start, with sizes, means and costs of the clusters at the last pass."""

    k: int
    start: int
    centres: np.ndarray
    sizes: list[int] = field(default_factory=list)
    sums: list[list[int]] = field(default_factory=list)
    costs: list[int] = field(default_factory=list)

    @property
    def cost(self) -> int:
        return sum(self.costs)

    def spread(self) -> np.ndarray:
        """Mean squared distance of each cluster's points from their mean."""
        off = ((np.array(self._means()) - self.centres) ** 2).sum(axis=1)
        return np.maximum([c / COST_STEPS / max(n, 1) - o for c, n, o in zip(self.costs, self.sizes, off)], 0)

    def _means(self) -> list[list[float]]:
        return [[s / (n * STEPS) for s in sums] if n else list(own)
                for n, sums, own in zip(self.sizes, self.sums, self.centres)]

    def take(self, sizes: list[int], sums: list[list[int]], costs: list[int], least: float) -> bool:
        """Take up a pass's figures; move the centres to the means unless that is too little."""
        self.sizes, self.sums, self.costs = sizes, sums, costs
        means = np.array(self._means())
        moved = ((means - self.centres) ** 2).sum()
        if moved > least:
            self.centres = means
        return moved > least


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ with a few candidates per centre, of which the one that lowers the cost most is taken."""
    chosen = [x[rng.integers(len(x))]]
    near = ((x - chosen[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        weight = near if near.sum() > 0 else np.ones(len(x))
        picks = rng.choice(len(x), size=2 + int(np.log(k)), p=weight / weight.sum())
        options = np.minimum(near, ((x[None] - x[picks][:, None]) ** 2).sum(axis=2))
        best = int(options.sum(axis=1).argmin())
        chosen.append(x[picks[best]])
        near = options[best]
    return np.array(chosen)


def starts(points: DataFrame, ks: Sequence[int], n_init: int, seed: int) -> list[Model]:
    """``n_init`` models per k."""
    order = F.xxhash64(F.lit(seed), F.col("id").cast("string"))
    rows = points.select("x", order.alias("_o"), F.col("id").cast("string").alias("_i")).orderBy(
        "_o", "_i", F.col("x")).limit(SAMPLE).toArrow()
    if not rows.num_rows:
        return []
    x = np.array(rows.column("x").to_pylist(), float) / STEPS
    return [Model(k, s, plus_plus(x, k, np.random.default_rng([seed, k, s]))) for k in ks for s in range(n_init)]


def _figures(points: DataFrame, models: Sequence[Model], width: int) -> dict[int, tuple]:
    """Size, coordinate sums and cost of every cluster of the models, by its number in their row."""
    centres = np.concatenate([m.centres for m in models])
    alike, first = [], 0  # first slot, k and number of the models of one k
    for k, same in groupby(m.k for m in models):
        alike.append((first, k, len(list(same))))
        first += k * alike[-1][2]
    high, low = [f"h{d}" for d in range(width)], [f"l{d}" for d in range(width)]
    names = ["slot", "n", "cost", *high, *low]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centres), len(names) - 1), np.int64)
        for x in matrices(batches, width, _ROUND_STRIP):
            distance = squared_distances(x / STEPS, centres)
            row = np.arange(len(x))[:, None]
            # models of one k are beside each other: one search for all of them
            slot = np.concatenate([a + k * np.arange(m) + distance[:, a:a + k * m].reshape(len(x), m, k).argmin(axis=2)
                                   for a, k, m in alike], axis=1)
            member = np.zeros(distance.shape)
            member[row, slot] = 1
            parts = np.column_stack([np.ones(len(x)), x >> _LOW, x & ((1 << _LOW) - 1)]).astype(float)
            sums = (member.T @ parts).astype(np.int64)  # whole numbers below 2**53: exact
            cost = np.zeros(len(centres), np.int64)
            np.add.at(cost, slot, np.floor(distance[row, slot] * COST_STEPS).astype(np.int64))
            total += np.column_stack([sums[:, :1], cost, sums[:, 1:]])
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(c[used]) for c in total.T]], names=names)

    rows = points.select("x").mapInArrow(run, ", ".join(f"{n} long" for n in names)).groupBy(
        "slot").sum(*names[1:]).toArrow()
    slot, n, cost, *parts = [column.to_pylist() for column in rows.columns]
    sums = [[(h << _LOW) + l for h, l in zip(x[:width], x[width:])] for x in zip(*parts)]
    return dict(zip(slot, zip(n, sums, cost)))


def lloyd(points: DataFrame, models: Sequence[Model], least: float = 0.0, rounds: int = ROUNDS) -> None:
    """Move the centres of all models to their clusters' means until they move by ``least`` at most.

    ``points`` is best persisted.
    """
    live = list(models)
    for left in range(rounds, -1, -1):
        if not live:
            break
        width = live[0].centres.shape[1]
        found, slot, moving = _figures(points, live, width), 0, []
        for model in live:
            own = [found.get(slot + c, (0, [0] * width, 0)) for c in range(model.k)]
            slot += model.k
            # the last pass is for the figures
            if model.take(*map(list, zip(*own)), least if left else float("inf")):
                moving.append(model)
        live = moving


def fit(points: DataFrame, ks: Sequence[int], n_init: int, seed: int, tolerance: float = TOLERANCE) -> dict[
        int, Model]:
    """The start of least cost for each k, the first one on ties."""
    models = starts(points, ks, n_init, seed)
    if not models:
        return {}
    width = models[0].centres.shape[1]
    variance = points.agg(*[F.var_pop(F.get("x", F.lit(d)) / STEPS) for d in range(width)]).first()
    lloyd(points, models, tolerance * round(sum(variance) / width, 6))
    best: dict[int, Model] = {}
    for model in models:
        if model.k not in best or (model.cost, model.start) < (best[model.k].cost, best[model.k].start):
            best[model.k] = model
    lloyd(points, list(best.values()))
    return best


def label(cols: Sequence[str], model: Model) -> Column:
    """Number of the nearest centre, the first one on ties."""
    point = [F.round(F.col(c).cast("double") * STEPS) / STEPS for c in cols]
    distances = []
    for centre in model.centres.tolist():
        total = F.lit(0.0)
        for p, c in zip(point, centre):
            total = total + (p - c) * (p - c)
        distances.append(total)
    every = F.array(*distances)
    return (F.array_position(every, F.array_min(every)) - 1).cast("long")
