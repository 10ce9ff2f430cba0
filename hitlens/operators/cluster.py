"""Client clustering: scaling, choice of k, k-means, principal components."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from hitlens.operators import kmeans, silhouettes
from hitlens.operators.dbscan import NOISE, dbscan
from hitlens.operators.distances import block_pairs, block_rows, hash_block, strips
from hitlens.operators.grouping import attach
from hitlens.operators.traffic import ip_profile, profile_columns
from hitlens.session import checkpoint

# Search range of k, starts per fit, least number of clients to cluster.
MAX_K, N_INIT, SEED, MIN_CLIENTS = 8, 10, 42, 4
SUMMARY_COLUMNS = 8
# Distances of the silhouette.
SQUARED, EUCLIDEAN = "squaredEuclidean", "euclidean"
_SCALED = "z_"


def standardize_features(df: DataFrame, cols: Sequence[str], prefix: str = "") -> DataFrame:
    """Zero mean, unit population deviation; a constant column becomes 0."""
    stats = df.agg(*[agg for c in cols for agg in (
        F.avg(c).alias(f"_mean_{c}"), F.stddev_pop(c).alias(f"_std_{c}"),
        (F.max(c) == F.min(c)).alias(f"_const_{c}"))])
    scaled = {
        f"{prefix}{c}": F.when(F.col(f"_const_{c}"), 0.0).otherwise(
            F.coalesce(F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.col(f"_std_{c}")), F.lit(0.0)))
        for c in cols}
    return attach(df, stats).withColumns(scaled).drop(*stats.columns)


def _vectors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="_features").transform(df)


def _fitted(df: DataFrame, cols: Sequence[str], ks: Sequence[int], id_col: str, n_init: int,
            seed: int) -> dict[int, kmeans.Model]:
    points = kmeans.fixed_point(df, cols, id_col).persist()
    try:
        return kmeans.fit(points, ks, n_init, seed)
    finally:
        points.unpersist()


def kmeans_clusters(df: DataFrame, k: int, cols: Sequence[str], *, id_col: str = "ip",
                    n_init: int = N_INIT, seed: int = SEED) -> DataFrame:
    """Add the k-means ``cluster`` of each row; it does not depend on the input's partitions."""
    models = _fitted(df, cols, [k], id_col, n_init, seed)
    number = kmeans.label(cols, models[k]) if models else F.lit(None).cast("long")
    return df.withColumn("cluster", number)


def _silhouette_column(k: int, label: str, sums: list[Column], sizes: list[Column]) -> Column:
    own = F.col(label)

    def mean(c):  # mean distance to cluster c, the point itself left out of its own
        return F.try_divide(sums[c], sizes[c] - F.when(own == c, 1).otherwise(0))

    own_size, a, others = None, None, []
    for c in range(k):
        is_own = own == c
        own_size = F.when(is_own, sizes[c]) if own_size is None else own_size.when(is_own, sizes[c])
        a = F.when(is_own, mean(c)) if a is None else a.when(is_own, mean(c))
        others.append(F.when(~is_own & (sizes[c] > 0), mean(c)))
    b = F.least(*others)
    return F.when(own_size > 1, F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))
                  ).otherwise(0.0)


def euclidean_silhouettes(df: DataFrame, cols: Sequence[str], labels: dict[str, int], *,
                          id_col: str = "ip", block: int | None = None) -> dict[str, float]:
    """Mean silhouette of several labelings in one pass over the distances.

    ``labels`` maps a label column to its number of clusters. The work is quadratic in the
    points but runs in bounded blocks (see ``distances``); a point and block pair yield one
    row with a sum per cluster.
    """
    clusters = [(label, c) for label, k in labels.items() for c in range(k)]
    names = [f"_s{i}" for i in range(len(clusters))]
    n = df.count()
    blocks = F.lit(max(1, -(-n // (block or block_rows(n))))).cast("long")
    points = df.select(
        F.col(id_col).alias("_id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"),
        F.array(*[F.col(label).cast("int") for label in labels]).alias("_labels"),
        blocks.alias("_blocks"), hash_block(F.col(id_col), blocks).alias("_block"))
    order = list(labels)

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((len(left), len(clusters)))
        if len(left) and len(right):
            a, b = np.stack(left["x"].to_numpy()), np.stack(right["x"].to_numpy())
            theirs = np.stack(right["_labels"].to_numpy())
            member = np.column_stack([theirs[:, order.index(l)] == c for l, c in clusters]).astype(float)
            for start, square in strips(a, b):
                out[start:start + len(square)] = np.sqrt(square, out=square) @ member
        return pd.DataFrame(out, columns=names).assign(_id=left["_id"].to_numpy())

    id_type = df.schema[id_col].dataType.simpleString()
    partial = block_pairs(points, points, []).applyInPandas(
        sums, ", ".join(f"{n} double" for n in names) + f", _id {id_type}")
    total = partial.groupBy("_id").agg(*[F.sum(n).alias(n) for n in names])
    own = df.select(F.col(id_col).alias("_id"), *labels)
    sizes = df.agg(*[F.sum((F.col(l) == c).cast("long")).alias(f"_n{i}")
                     for i, (l, c) in enumerate(clusters)])
    rows = attach(total.join(own, "_id"), sizes)
    scores, at = [], 0
    for label, k in labels.items():
        scores.append(F.avg(_silhouette_column(
            k, label, [F.col(f"_s{i}") for i in range(at, at + k)],
            [F.col(f"_n{i}") for i in range(at, at + k)])).alias(label))
        at += k
    return rows.agg(*scores).first().asDict()


def silhouette(df: DataFrame, cols: Sequence[str], label: str, *, id_col: str = "ip",
               metric: str = SQUARED) -> float:
    """Mean silhouette of a labelling 0, 1, ... of the rows."""
    if metric == EUCLIDEAN:
        k = df.agg(F.max(label)).first()[0] + 1
        return euclidean_silhouettes(df, cols, {label: k}, id_col=id_col)[label]
    rows = _vectors(df, cols).withColumn(label, F.col(label).cast("double"))
    return ClusteringEvaluator(featuresCol="_features", predictionCol=label,
                               metricName="silhouette", distanceMeasure=metric).evaluate(rows)


def best_k(scores: dict[int, tuple[float, float]]) -> int:
    """k of the greatest silhouette, the smallest on ties; 2 without scores."""
    if not scores:
        return 2
    most = max(low for low, _ in scores.values())
    return min(k for k, (_, high) in scores.items() if high >= most - silhouettes.TIE)


def models_by_k(df: DataFrame, cols: Sequence[str], max_k: int = MAX_K, *, id_col: str = "ip",
                metric: str = EUCLIDEAN, n_init: int = N_INIT, seed: int = SEED,
                cells: Sequence[int] = silhouettes.CELLS) -> tuple[
                    dict[int, kmeans.Model], dict[int, tuple[float, float]]]:
    """The k-means model for every k from 2 to max_k (less than the rows), and bounds of its mean
    silhouette; nothing for fewer than four rows.

    By plain distance (``euclidean``) the bounds of a k that cannot be the best stay wide, and those of several
    that may be are made equal by exact distances. By ``squaredEuclidean`` they are equal anyway.
    """
    if metric not in (SQUARED, EUCLIDEAN):
        raise ValueError(f"metric must be {SQUARED!r} or {EUCLIDEAN!r}, not {metric!r}")
    points = kmeans.fixed_point(df, cols, id_col).persist()
    try:
        n = points.count()
        if n < MIN_CLIENTS:
            return {}, {}
        models = kmeans.fit(points, range(2, min(max_k, n - 1) + 1), n_init, seed)
        if metric == SQUARED:
            return models, {k: (s, s) for k, s in silhouettes.squared(points, models).items()}
        scores = silhouettes.euclidean(points, models, cells)
    finally:
        points.unpersist()
    wanted = silhouettes.open_ks(scores)
    if len(wanted) > 1 and any(high - low > silhouettes.TIE for low, high in (scores[k] for k in wanted)):
        labelled = df.withColumns({f"_k{k}": kmeans.label(cols, models[k]) for k in wanted})
        exact = euclidean_silhouettes(labelled, cols, {f"_k{k}": k for k in wanted}, id_col=id_col)
        scores |= {k: (exact[f"_k{k}"],) * 2 for k in wanted}
    return models, scores


def silhouettes_by_k(df: DataFrame, cols: Sequence[str], max_k: int = MAX_K, **search) -> dict[
        int, tuple[float, float]]:
    """Lower and upper bound of the mean silhouette for every k, see ``models_by_k``."""
    return models_by_k(df, cols, max_k, **search)[1]


def choose_k(df: DataFrame, cols: Sequence[str], max_k: int = MAX_K, **search) -> int:
    """k with the best silhouette, the smallest on ties; 2 when there are too few rows."""
    return best_k(silhouettes_by_k(df, cols, max_k, **search))


def _principal_axes(df: DataFrame, cols: Sequence[str], k: int):
    """Column means, loadings (one list per component) and explained variance shares.

    The covariance is summed on the executors; the driver sees a cols x cols matrix. Signs
    are arbitrary: the largest loading of a component is made positive.
    """
    vectors = _vectors(df, cols)
    model = PCA(k=k, inputCol="_features", outputCol="_pc").fit(vectors)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return [means[c] for c in cols], (loadings * signs).T.tolist(), model.explainedVariance.toArray()


def _project(df: DataFrame, cols: Sequence[str], means, axes, names: Sequence[str]) -> DataFrame:
    out = {}
    for name, axis in zip(names, axes):
        total = F.lit(0.0)
        for c, mean, weight in zip(cols, means, axis):
            total = total + (F.col(c) - mean) * weight
        out[name] = total
    return df.withColumns(out)


def pca_2d(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add the two leading principal components as ``pca_x`` and ``pca_y``."""
    means, axes, _ = _principal_axes(df, cols, 2)
    return _project(df, cols, means, axes, ("pca_x", "pca_y"))


def pca(df: DataFrame, cols: Sequence[str], variance: float = 0.95) -> DataFrame:
    """Add as many components ``pc1``, ``pc2``, ... as reach the share of variance."""
    means, axes, explained = _principal_axes(df, cols, len(cols))
    kept = int(np.searchsorted(np.cumsum(explained), variance, side="right")) + 1
    kept = min(kept, len(cols))
    return _project(df, cols, means, axes[:kept], [f"pc{i + 1}" for i in range(kept)])


def cluster_ips(df: DataFrame, *, n_init: int = N_INIT, seed: int = SEED,
                metric: str = EUCLIDEAN) -> DataFrame:
    """Profile each client of a feature table and label it.

    Adds ``cluster`` (k-means), ``outlier_cluster`` (DBSCAN) and ``pca_x``/``pca_y``. With
    fewer than four clients the plain profile is returned. The profile, one row per client,
    is checkpointed: everything after it leaves the requests alone.
    """
    cols = profile_columns(df)
    profile = checkpoint(ip_profile(df))
    if profile.limit(MIN_CLIENTS).count() < MIN_CLIENTS:
        return profile
    scaled_cols = [f"{_SCALED}{c}" for c in cols]
    scaled = checkpoint(standardize_features(profile, cols, _SCALED))
    models, scores = models_by_k(scaled, scaled_cols, seed=seed, metric=metric, n_init=n_init)
    out = scaled.withColumn("cluster", kmeans.label(scaled_cols, models[best_k(scores)]))
    out = pca_2d(out, scaled_cols)
    return dbscan(out, scaled_cols).drop(*scaled_cols)


def cluster_sizes(df: DataFrame) -> DataFrame:
    """Clients per cluster, in cluster order."""
    return df.groupBy("cluster").agg(F.count("*").alias("clients")).orderBy("cluster")


def cluster_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Mean of the first eight profile features per cluster, in cluster order."""
    if cols is None:
        skip = {"ip", "cluster", "outlier_cluster", "pca_x", "pca_y"}
        cols = [c for c in df.columns if c not in skip][:SUMMARY_COLUMNS]
    return df.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in cols]).orderBy("cluster")


def cluster_points(df: DataFrame) -> DataFrame:
    """Points of the scatter plots: position, cluster and outlier mark per client."""
    return df.select("ip", "pca_x", "pca_y", "cluster",
                     (F.col("outlier_cluster") == NOISE).alias("is_outlier"))


def dbscan_outliers(df: DataFrame) -> DataFrame:
    """Clients outside every density cluster."""
    return df.where(F.col("outlier_cluster") == NOISE)
