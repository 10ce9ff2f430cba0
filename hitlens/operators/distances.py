"""Distance blocks: all-to-all work cut into bounded squares.

Points are hashed into blocks of a bounded number of rows, and a task sees one pair of
blocks at a time as two small matrices. Pairs exist only inside such a matrix; what leaves
the task is a few numbers per point.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

MIN_BLOCK, MAX_BLOCK = 8192, 32_768
# Distances a strip holds at once: a few arrays of so many numbers are all the memory a task needs for them.
STRIP = 1 << 18
# Squared distances from products are off by some 1e-15 of the squared lengths: those below this share of
# a length are computed again from differences.
_NEAR = 2e-6


def block_rows(n: int) -> int:
    """Rows per block: small ones keep few points parallel, large ones keep the copies of
    many points (one per block they meet, eight up to a quarter of a million points) few. Either fits a task easily."""
    return max(MIN_BLOCK, min(MAX_BLOCK, -(-n // 8)))


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances row by row of two matrices."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += (a[:, d] - b[:, d]) ** 2
    return out


def _products(left: np.ndarray, right: np.ndarray):
    """Yield (offset, squared lengths, squared distances up to rounding) for strips of the left rows."""
    length = (left * left).sum(axis=1)
    wide = np.column_stack([left * -2, length, np.ones(len(left))])
    tall = np.vstack([right.T, np.ones(len(right)), (right * right).sum(axis=1)])
    step = max(1, STRIP // max(len(right), 1))
    for start in range(0, len(left), step):
        yield start, length[start:start + step], wide[start:start + step] @ tall


def strips(left: np.ndarray, right: np.ndarray):
    """Yield (offset, squared distances) for strips of the left rows, from products of matrices.

    Rounding would tell in distances much below the lengths, which are then nearly equal: differences
    give those.
    """
    for start, length, out in _products(left, right):
        i, j = np.divmod(np.flatnonzero(out < _NEAR * length[:, None]), max(len(right), 1))
        out[i, j] = differences(left[start + i], right[j])
        yield start, out


def near_pairs(left: np.ndarray, right: np.ndarray, eps: float):
    """Yield (left rows, right rows) of the pairs within eps, in order, for strips of the left rows.

    Products only leave out the pairs that are surely too far; differences decide the others.
    """
    most = eps * eps
    greatest = (right * right).sum(axis=1).max(initial=0)
    for start, length, out in _products(left, right):
        reach = most + 1e-12 * (length + greatest + most)
        i, j = np.divmod(np.flatnonzero(out <= reach[:, None]), max(len(right), 1))
        near = differences(left[start + i], right[j]) <= most
        yield start + i[near], j[near]


def hash_block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks).cast("long")


def block_pairs(left: DataFrame, right: DataFrame, place: list[str]):
    """Cogroup every left block with every right block of the same place.

    Both frames carry ``_block`` and ``_blocks`` (their number in the place).
    """
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    names = [*place, "_i", "_j"]
    probe = left.withColumn("_j", others).withColumnRenamed("_block", "_i")
    build = right.withColumn("_i", others).withColumnRenamed("_block", "_j")
    # both sides may stem from one frame: give them columns of their own
    probe, build = probe.toDF(*probe.columns), build.toDF(*build.columns)
    return probe.groupBy(*names).cogroup(build.groupBy(*names))
