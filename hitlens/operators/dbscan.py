"""Exact DBSCAN as Spark joins and bounded numpy blocks.

1. Equal points collapse into one weighted point, so copies cost nothing.
2. Cells of side ``eps / sqrt(dimensions)`` with ``min_samples`` points are dense: all their points are
   core and in one cluster. A dense cell becomes one item with a bounding box and its extreme
   points; every other point is an item of its own.
3. A k-d split of a small hash sample cuts space into leaves. An item lives in one leaf and is copied
   to every leaf near it, so each leaf sees the complete neighbourhood of its own items. The split
   only places work: results do not depend on it.
4. Leaves with more items than a task should hold are cut into hashed blocks, and every
   pair of blocks is one task (see ``distances``).
5. Pass one sums neighbour weights. Boxes decide most pairs with a dense cell, extreme points link
   most dense cells side by side. What they leave open is settled by the points of the cells: how many
   of them are near a single point, and, for dense cells not connected otherwise, whether any pair is.
6. Pass two emits, per block pair, one tree edge per core point instead of all pairs; the components
   of these edges are the clusters. A non-core point has fewer than ``min_samples``
   neighbours, which are emitted.

Work grows with the square of the items in a region too dense to be cut; where points crowd in few
dimensions, items are cells there.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from hitlens.operators import distances
from hitlens.operators.components import connected_components
from hitlens.operators.distances import block_pairs, block_rows, hash_block, near_pairs
from hitlens.operators.grouping import attach, salted_join
from hitlens.session import checkpoint

NOISE = -1
_SAMPLE = 20_000
# Greatest share of rows near a cut.
MOST_COPIED = 0.5


def _split_space(sample: np.ndarray, eps: float, reach: float, leaves: int) -> list[tuple]:
    """k-d tree as (dimension, cut, below, above); a leaf is (-1, 0, leaf number, -1).

    Of the dimensions in which both halves stay wide against ``eps`` the one is cut at its median that has the
    least share of rows near the cut, which are copied; with more than ``MOST_COPIED`` in each
    a cut would save no more than its copies cost.
    """
    nodes, count = [], [0]
    target = max(2, len(sample) // leaves) if leaves > 1 else len(sample) + 1

    def grow(rows):
        me = len(nodes)
        nodes.append(None)
        best = MOST_COPIED, -1, 0.0
        if len(rows) > target:
            low, high, cuts = rows.min(axis=0), rows.max(axis=0), np.median(rows, axis=0)
            shares = ((rows >= cuts - eps) & (rows <= cuts + reach)).mean(axis=0)
            wide = (high - low >= 8 * eps) & (np.minimum(cuts - low, high - cuts) >= 2 * eps)
            best = min([best, *[(s, d, c) for d, (s, c) in enumerate(zip(shares, cuts)) if wide[d]]])
        _, d, cut = best
        if d >= 0:
            left = rows[:, d] < cut
            nodes[me] = (d, float(cut), grow(rows[left]), grow(rows[~left]))
        else:
            nodes[me] = (-1, 0.0, count[0], -1)
            count[0] += 1
        return me

    grow(sample)
    return nodes


def _high(items: pd.DataFrame) -> np.ndarray:
    """High corners; a single point has its only one as ``low``."""
    return np.stack(items["high"].where(items["high"].notna(), items["low"]).to_numpy())


def _place(items: DataFrame, tree: list[tuple], eps: float, reach: float, schema: str) -> DataFrame:
    """One row per item and leaf it belongs to (by its low corner) or lies near.

    An item of the leaf below a cut ends less than ``reach - eps`` above it.
    """
    def spread(batches):
        for pdf in batches:
            low, high = (np.stack(pdf["low"].to_numpy()), _high(pdf)) if len(pdf) else (np.zeros((0, 1)),) * 2
            work = [(0, np.arange(len(pdf)), np.ones(len(pdf), dtype=bool))]
            while work:
                at, rows, home = work.pop()
                if not len(rows):
                    continue
                d, cut, below, above = tree[at]
                if d < 0:
                    yield pdf.iloc[rows].assign(leaf=below, home=home)
                    continue
                left, right = low[rows, d] <= cut + reach, high[rows, d] >= cut - eps
                own = low[rows, d] < cut
                work.append((below, rows[left], home[left] & own[left]))
                work.append((above, rows[right], home[right] & ~own[right]))

    return items.mapInPandas(spread, f"{schema}, leaf long, home boolean")


def _gaps(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray):
    """Least and greatest squared distances between boxes."""
    near, far = np.zeros((len(low), len(other_low))), np.zeros((len(low), len(other_low)))
    for d in range(low.shape[1]):
        above = other_low[None, :, d] - high[:, d, None]
        below = low[:, d, None] - other_high[None, :, d]
        near += np.maximum(np.maximum(above, below), 0) ** 2
        far += np.maximum(other_high[None, :, d] - low[:, d, None], high[:, d, None] - other_low[None, :, d]) ** 2
    return near, far


def _any_near(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    return any(len(i) for i, _ in near_pairs(a, b, eps))


def _weights(left: np.ndarray, right: np.ndarray, weight: np.ndarray, eps: float) -> np.ndarray:
    """Weight of the right rows near each left one."""
    total = np.zeros(len(left), dtype=np.int64)
    for i, j in near_pairs(left, right, eps):
        np.add.at(total, i, weight[j])
    return total


def _survey(left: pd.DataFrame, right: pd.DataFrame, eps: float) -> pd.DataFrame:
    """What the left items are near to: rows (pid, other, weight).

    ``other`` is null in the sum over single points; else it is a dense cell, with null for the weight if its
    points have to be asked. Pairs of dense cells have the weight 0 when linked.
    """
    out = []
    if len(left) and len(right):
        one, other = ~left["dense"].to_numpy(bool), right["dense"].to_numpy(bool)
        corners = [c for f in (left, right) for c in (np.stack(f["low"].to_numpy()), _high(f))]
        ids, names, weight = left["pid"].to_numpy(), right["pid"].to_numpy(), right["weight"].to_numpy()
        total = _weights(corners[0][one], corners[2][~other], weight[~other], eps)
        out += [(i, None, n) for i, n in zip(ids[one], total)]
        cells = np.flatnonzero(other)
        step = max(1, distances.STRIP // max(len(cells), 1))
        for start in range(0, len(left) if len(cells) else 0, step):
            rows = slice(start, start + step)
            near, far = _gaps(corners[0][rows], corners[1][rows], corners[2][cells], corners[3][cells])
            sure = far <= eps * eps
            for i, j in zip(*np.nonzero(near <= eps * eps)):
                a, b = start + i, cells[j]
                if one[a]:
                    out.append((ids[a], names[b], weight[b] if sure[i, j] else None))
                elif ids[a] < names[b]:
                    linked = sure[i, j] or _any_near(np.stack(left["extremes"].iloc[a]),
                                                     np.stack(right["extremes"].iloc[b]), eps)
                    out.append((ids[a], names[b], 0 if linked else None))
    return pd.DataFrame(out, columns=["pid", "other", "weight"])


def _near_points(single: pd.DataFrame, cell: pd.DataFrame, eps: float) -> pd.DataFrame:
    """Weights of a cell's points near each of the single ones."""
    total = np.zeros(len(single), dtype=np.int64)
    if len(single) and len(cell):
        total = _weights(np.stack(single["x"].to_numpy()), np.stack(cell["x"].to_numpy()),
                         cell["weight"].to_numpy(), eps)
    return single[["pid", "other"]].assign(weight=total)


def _link(left: pd.DataFrame, right: pd.DataFrame, eps: float) -> pd.DataFrame:
    """Tree edges between core points, and core neighbours of the others.

    ``right`` holds core points only.
    """
    edges = []
    if len(left) and len(right):
        a, b = np.stack(left["x"].to_numpy()), np.stack(right["x"].to_numpy())
        left_id, right_id = left["pid"].to_numpy(), right["pid"].to_numpy()
        core = left["core"].to_numpy(bool)
        root = np.arange(len(right))  # union-find over the right side

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        anchor = np.full(len(left), -1)
        for rows, near in near_pairs(a, b, eps):
            at = np.flatnonzero(np.diff(rows, prepend=-1))
            for k, hits in zip(rows[at], np.split(near, at[1:])):
                if not core[k]:
                    edges += [(left_id[k], right_id[h], False) for h in hits]
                else:
                    tops = {find(h) for h in np.unique(root[hits])}
                    first = min(tops)
                    for t in tops:
                        root[t] = first
                    anchor[k] = first
        edges += [(left_id[i], right_id[find(t)], True) for i, t in enumerate(anchor) if t >= 0]
        edges += [(right_id[i], right_id[find(i)], True) for i in range(len(right)) if root[i] != i]
    return pd.DataFrame(edges, columns=["a", "b", "core"])


def _numbered(clusters: DataFrame) -> DataFrame:
    """Number clusters 0, 1, ... by their least core point, without one big window.

    The sorted list is checkpointed; a row's number is its place within its partition plus
    the sizes of the partitions before it (one row per partition).
    """
    ordered = checkpoint(clusters.orderBy("component")
                         .withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    return (ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .select("component", (F.col("_before") + place).alias("label")))


def dbscan(df: DataFrame, cols: Sequence[str], eps: float = 0.5, min_samples: int = 5, *,
           id_col: str = "ip", name: str = "outlier_cluster",
           block: int | None = None) -> DataFrame:
    """Add the cluster label of each row, or -1 for noise.

    A point counts itself as a neighbour. Clusters are numbered by their least core row in
    ``id_col`` order, and a border point joins the lowest-numbered cluster it touches.
    """
    cols = list(cols)
    vector = F.array(*[F.col(c).cast("double") for c in cols])
    id_type = df.schema[id_col].dataType.simpleString()
    rows = checkpoint(df)
    side = eps / np.sqrt(len(cols)) * (1 - 1e-9)
    points = (rows.select(F.col(id_col).alias("_id"), vector.alias("x"))
              .groupBy("x").agg(F.min("_id").alias("pid"), F.count("*").alias("weight"))
              .select("pid", "x", "weight", F.transform("x", lambda v: F.floor(v / side)).alias("place")))
    points = checkpoint(points)
    crowded = points.groupBy("place").agg(
        F.sum("weight").alias("_all"), F.min("pid").alias("cell")).where(F.col("_all") >= min_samples)
    # without keys of one row per point: only dense cells are looked up
    points = checkpoint(attach(points, crowded.select("place", "cell"), ["place"]).drop("place"))
    items = checkpoint(_items(points, len(cols)))
    n = items.count()
    block = block or block_rows(n)
    thinning = max(1, n // _SAMPLE)  # the sample only decides where space is cut
    sample = (items.where(F.pmod(F.xxhash64("pid"), F.lit(thinning)) == 0).select("low").collect()
              if n > block else [])
    reach = (eps + side) * (1 + 1e-9)
    tree = (_split_space(np.array([r["low"] for r in sample]), eps, reach, n // block)
            if sample else [(-1, 0.0, 0, -1)])
    placed = _place(items, tree, eps * (1 + 1e-9), reach, f"pid {id_type}, low array<double>, high array<double>, "
                    "weight long, dense boolean, extremes array<array<double>>")
    sizes = placed.groupBy("leaf").agg(
        F.ceil(F.count("*") / F.lit(block)).cast("long").alias("_blocks"))
    # leaves are at most as many as sampled items
    placed = checkpoint(placed.join(F.broadcast(sizes), "leaf")
                        .withColumn("_block", hash_block(F.col("pid"), F.col("_blocks"))))

    def survey(left, right):
        return _survey(left, right, eps)

    def link(left, right):
        return _link(left, right, eps)

    seen = checkpoint(block_pairs(placed.where("home"), placed, ["leaf"]).applyInPandas(
        survey, f"pid {id_type}, other {id_type}, weight long"))
    dense = items.where("dense").select("pid")
    cells, singles = seen.join(dense, "pid"), seen.join(dense, "pid", "left_anti")
    asked = singles.where("other is not null and weight is null")
    if not asked.isEmpty():
        singles = singles.where("other is null or weight is not null").unionByName(
            _asked(asked, points, eps, block, id_type))
    singles = checkpoint(singles)
    core = (singles.groupBy("pid").agg(F.sum("weight").alias("_weight"))
            .select("pid", (F.col("_weight") >= min_samples).alias("core")))
    known = checkpoint(placed.where("not dense").select(
        "pid", F.col("low").alias("x"), "leaf", "home", "_block", "_blocks").join(core, "pid"))
    edges = checkpoint(block_pairs(known.where("home"), known.where("core"), ["leaf"])
                       .applyInPandas(link, f"a {id_type}, b {id_type}, core boolean")
                       .unionByName(singles.where("other is not null and weight > 0").join(core, "pid").select(
                           F.col("pid").alias("a"), F.col("other").alias("b"), "core")))
    lone = known.where(F.col("home") & F.col("core")).select("pid").unionByName(dense).select(
        F.col("pid").alias("a"), F.col("pid").alias("b"))
    sure = edges.where("core").select("a", "b").unionByName(lone).unionByName(
        cells.where("weight is not null").select(F.col("pid").alias("a"), F.col("other").alias("b")))
    member = checkpoint(connected_components(sure))
    doubtful = cells.where("weight is null").select("pid", "other")
    if not doubtful.isEmpty():
        more = checkpoint(_touching(doubtful, member, items, points, eps, block, id_type))
        if not more.isEmpty():
            member = checkpoint(connected_components(sure.unionByName(more)))
    labels = _numbered(member.select("component").distinct())
    # one cluster may hold most of the points
    sizes = member.groupBy("component").agg(F.count("*").alias("_size"))
    core_label = (salted_join(member, labels, ["component"], sizes, count="_size")
                  .select(F.col("node").alias("pid"), "label"))
    border = (edges.where(~F.col("core"))
              .join(core_label.withColumnRenamed("pid", "b"), "b")
              .groupBy(F.col("a").alias("pid")).agg(F.min("label").alias("label")))
    every = attach(points.withColumn("pid", F.coalesce("cell", "pid")),
                   core_label.unionByName(border.select("pid", "label")), ["pid"])
    by_vector = every.where("label is not null").select(F.col("x").alias("_point"), "label")
    frequent = points.withColumnRenamed("x", "_point")
    return (salted_join(rows.withColumn("_point", vector), by_vector, ["_point"], frequent,
                        count="weight")
            .withColumn(name, F.coalesce(F.col("label"), F.lit(NOISE).cast("long")))
            .drop("_point", "label"))


def _items(points: DataFrame, width: int) -> DataFrame:
    """Dense cells with box and extreme points, and the points outside them."""
    at = [F.get("x", F.lit(d)) for d in range(width)]
    cells = points.where("cell is not null").groupBy(F.col("cell").alias("pid")).agg(
        F.array(*[F.min(v) for v in at]).alias("low"), F.array(*[F.max(v) for v in at]).alias("high"),
        F.sum("weight").alias("weight"), F.array(*[pick("x", v) for v in at for pick in (F.min_by, F.max_by)])
        .alias("extremes"))
    single = points.where("cell is null").select(
        "pid", F.col("x").alias("low"), F.lit(None).cast("array<double>").alias("high"), "weight",
        F.lit(False).alias("dense"),
        F.lit(None).cast("array<array<double>>").alias("extremes"))
    return cells.select("pid", "low", "high", "weight", F.lit(True).alias("dense"), "extremes").unionByName(single)


def _in_blocks(points: DataFrame, cells: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The points of some cells with the block each is in, and the number of blocks of each cell."""
    own = points.join(cells.select("cell").distinct(), "cell")
    sizes = checkpoint(own.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("_blocks")))
    return attach(own, sizes, ["cell"]).withColumn(
        "_block", hash_block(F.col("pid"), F.col("_blocks"))).drop("_blocks"), sizes


def _asked(pairs: DataFrame, points: DataFrame, eps: float, block: int, id_type: str) -> DataFrame:
    """Pairs of a single point and a dense cell, with the weight of the cell's points near it.

    Every block of a cell sees all single points asked about it: fewer than ``min_samples`` for each
    cell around it.
    """
    single = pairs.select("pid", F.col("other").alias("cell")).join(
        points.where("cell is null").select("pid", "x"), "pid")
    own, sizes = _in_blocks(points, single, block)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    single = attach(single, sizes, ["cell"]).withColumn("_block", copies).select(
        "pid", F.col("cell").alias("other"), "x", "_block")
    own = own.select(F.col("cell").alias("other"), "x", "weight", "_block")
    single, own = single.toDF(*single.columns), own.toDF(*own.columns)

    def count(left, right):
        return _near_points(left, right, eps)

    return single.groupBy("other", "_block").cogroup(own.groupBy("other", "_block")).applyInPandas(
        count, f"pid {id_type}, other {id_type}, weight long").groupBy("pid", "other").agg(
        F.sum("weight").alias("weight"))


def _touching(pairs: DataFrame, member: DataFrame, items: DataFrame, points: DataFrame, eps: float, block: int,
              id_type: str) -> DataFrame:
    """Edges (a, b) between dense cells of different components that have points within eps.

    Only points near the other cell's box travel, and blocks of both sides meet.
    """
    own = member.select("node", "component")
    open_ = pairs.join(own.toDF("pid", "_c"), "pid").join(own.toDF("other", "_d"), "other").where(
        "_c <> _d").select("pid", "other")
    boxes = items.where("dense").select("pid", "low", "high")
    sides = []
    for mine, theirs in (("pid", "other"), ("other", "pid")):
        box = boxes.toDF("_box", "low", "high")
        gap = F.aggregate(F.zip_with("x", F.arrays_zip("low", "high"), lambda v, b: F.pow(F.greatest(
            b["low"] - v, v - b["high"], F.lit(0.0)), 2)), F.lit(0.0), lambda total, g: total + g)
        rows = open_.join(box, F.col(theirs) == F.col("_box")).join(
            points.select("cell", F.col("pid").alias("_id"), "x"), F.col(mine) == F.col("cell")).where(
            gap <= eps * eps * (1 + 1e-9)).select("pid", "other", "_id", "x")
        number = rows.groupBy("pid", "other").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("_blocks"))
        sides.append(attach(rows, number, ["pid", "other"]).withColumn(
            "_block", hash_block(F.col("_id"), F.col("_blocks"))))
    # both sides go to the blocks of each other
    counts = [s.groupBy("pid", "other").agg(F.max("_blocks").alias("_others")) for s in sides]
    names = ["pid", "other", "_i", "_j"]
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_others") - 1))
    left = attach(sides[0], counts[1], ["pid", "other"]).where("_others is not null").select(
        "pid", "other", "x", F.col("_block").alias("_i"), copies.alias("_j"))
    right = attach(sides[1], counts[0], ["pid", "other"]).where("_others is not null").select(
        "pid", "other", "x", F.col("_block").alias("_j"), copies.alias("_i"))
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)

    def meet(a, b):
        found = len(a) and len(b) and _any_near(np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy()), eps)
        return a[["pid", "other"]].head(1 if found else 0).set_axis(["a", "b"], axis=1)

    return left.groupBy(*names).cogroup(right.groupBy(*names)).applyInPandas(
        meet, f"a {id_type}, b {id_type}").distinct()
