import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import request
from hitlens.operators import cluster, distances, kmeans, silhouettes
from hitlens.operators.components import connected_components
from hitlens.operators.dbscan import dbscan


def frame(spark, x, names=None):
    names = names or [f"f{i}" for i in range(x.shape[1])]
    rows = [(f"p{i:05}", *map(float, row)) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "ip string, " + ", ".join(f"{n} double" for n in names)), names


def brute_dbscan(x, eps, least):
    near = [np.flatnonzero(((x - p) ** 2).sum(axis=1) <= eps * eps) for p in x]
    core = [len(n) >= least for n in near]
    label, current = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] == -1:
            todo = [i]
            label[i] = current
            while todo:
                for j in near[todo.pop()]:
                    if label[j] == -1:
                        label[j] = current
                        if core[j]:
                            todo.append(j)
            current += 1
    return label


def blobs(seed, sizes, d, spread, far=0.0):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(rng.uniform(-far, far, d), spread, (n, d)) for n in sizes]
    return np.concatenate(parts)


@pytest.mark.parametrize("seed,sizes,d,far,block", [
    (0, [60, 60, 20], 2, 4, 2048),     # one leaf, one block
    (1, [200, 150, 50], 2, 6, 40),     # hot leaves cut into blocks, space cut into leaves
    (2, [100, 100, 30], 3, 20, 30),
    (3, [150, 10], 4, 0.5, 25),        # one blob that no cut can divide
])
def test_dbscan_matches_brute_force(spark, seed, sizes, d, far, block):
    x = blobs(seed, sizes, d, 0.35, far)
    x = np.concatenate([x, np.repeat(x[:3], 4, axis=0)])  # copies
    x = x[np.random.default_rng(seed).permutation(len(x))]
    df, cols = frame(spark, x)
    out = dbscan(df, cols, block=block).toPandas().sort_values("ip")
    assert out.outlier_cluster.tolist() == brute_dbscan(x, 0.5, 5).tolist()


def test_dbscan_many_copies_of_one_point(spark):
    x = np.concatenate([np.zeros((300, 2)), np.full((4, 2), 9.0), [[0.4, 0.0], [0.8, 0.0]]])
    df, cols = frame(spark, x)
    out = dbscan(df, cols, block=10).toPandas().sort_values("ip")
    assert out.outlier_cluster.tolist() == brute_dbscan(x, 0.5, 5).tolist()


@pytest.mark.parametrize("seed,d,block", [(20, 1, 50), (21, 2, 60), (22, 2, 4000), (23, 3, 80)])
def test_dbscan_dense_cells_match_brute_force(spark, seed, d, block):
    """Crowded blobs at distances around eps, thin bridges, and single points at their rims."""
    rng = np.random.default_rng(seed)
    parts = [rng.uniform(0, 1.2, (300, d)), rng.uniform(0, 0.6, (150, d)) + ([1.62] + [0.0] * (d - 1)),
             rng.uniform(0, 0.4, (100, d)) + ([2.75] + [0.3] * (d - 1)),
             np.linspace(0, 1, 9)[:, None] * np.ones(d) * 3 + 1.0, rng.uniform(-2, 6, (40, d)),
             np.repeat(rng.uniform(4, 5, (2, d)), 6, axis=0)]
    x = np.concatenate(parts)
    x = x[rng.permutation(len(x))]
    df, cols = frame(spark, x)
    out = dbscan(df, cols, block=block).toPandas().sort_values("ip")
    assert out.outlier_cluster.tolist() == brute_dbscan(x, 0.5, 5).tolist()


def test_dbscan_of_a_large_blob(spark, monkeypatch):
    """200,000 points within a few eps are some hundred cells; single points alone are compared."""
    from hitlens.operators import dbscan as module

    asked, place = [], module._place
    monkeypatch.setattr(module, "_place", lambda items, *a: asked.append(items.count()) or place(items, *a))
    rows = spark.range(200_000).select(
        F.col("id").alias("ip"), (F.rand(1) * 3).alias("f0"), (F.rand(2) * 3).alias("f1"))
    rows = rows.unionByName(spark.createDataFrame([(10**9, 9.0, 9.0)], rows.schema))
    out = dbscan(rows, ["f0", "f1"]).groupBy("outlier_cluster").count().collect()
    assert {r.outlier_cluster: r["count"] for r in out} == {0: 200_000, -1: 1}
    assert asked[0] < 500


def test_dbscan_all_noise(spark):
    df, cols = frame(spark, np.arange(8.0).reshape(-1, 1) * 10)
    assert {r.outlier_cluster for r in dbscan(df, cols).collect()} == {-1}
    assert cluster.dbscan_outliers(dbscan(df, cols)).count() == 8


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    df = spark.createDataFrame(chain + star + [(500, 500), (7, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 500: 500}
    assert got == want


def test_standardize(spark):
    x = np.column_stack([np.random.default_rng(0).normal(5, 3, 50), np.full(50, 0.1)])
    df, cols = frame(spark, x)
    out = cluster.standardize_features(df, cols).toPandas().sort_values("ip")
    np.testing.assert_allclose(out.f0, (x[:, 0] - x[:, 0].mean()) / x[:, 0].std())
    assert (out.f1 == 0).all()
    kept = cluster.standardize_features(df, cols, "z_")
    assert kept.columns == ["ip", "f0", "f1", "z_f0", "z_f1"]


def brute_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    scores = []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(x)) != i)
        if not same.any():
            scores.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, labels == c].mean() for c in set(labels) - {own})
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


@pytest.mark.parametrize("block", [2048, 20])
def test_euclidean_silhouette(spark, block):
    x = blobs(4, [40, 30, 25, 1], 3, 0.8, 3)
    df, cols = frame(spark, x)
    three = np.arange(len(x)) % 3
    two = (x[:, 0] > 0).astype(int)
    marks = spark.createDataFrame(
        [(f"p{i:05}", int(a), int(b)) for i, (a, b) in enumerate(zip(three, two))],
        "ip string, three int, two int")
    got = cluster.euclidean_silhouettes(df.join(marks, "ip"), cols, {"three": 3, "two": 2},
                                        block=block)
    assert got["three"] == pytest.approx(brute_silhouette(x, three))
    assert got["two"] == pytest.approx(brute_silhouette(x, two))


def test_kmeans_and_choice_of_k(spark):
    x = np.concatenate([np.random.default_rng(5).normal(c, 0.2, (20, 2)) for c in ((0, 0), (9, 0), (0, 9))])
    df, cols = frame(spark, x)
    assert cluster.choose_k(df, cols, 5) == 3
    assert cluster.choose_k(df, cols, 5, metric="squaredEuclidean") == 3
    assert cluster.choose_k(df.limit(3), cols) == 2
    out = cluster.kmeans_clusters(df, 3, cols, n_init=2).toPandas().sort_values("ip")
    groups = out.cluster.to_numpy().reshape(3, 20)
    assert all(len(set(g)) == 1 for g in groups) and len(set(groups[:, 0])) == 3
    sizes = cluster.cluster_sizes(cluster.kmeans_clusters(df, 3, cols, n_init=2)).collect()
    assert [(r.cluster, r.clients) for r in sizes] == [(0, 20), (1, 20), (2, 20)]


def test_pca(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 4)) @ np.diag([5, 2, 0.5, 0.1]) + 3
    df, cols = frame(spark, x)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov(centred.T))
    order = values.argsort()[::-1]
    want = centred @ vectors[:, order]
    out = cluster.pca_2d(df, cols).toPandas().sort_values("ip")
    np.testing.assert_allclose(np.abs(out[["pca_x", "pca_y"]]), np.abs(want[:, :2]), atol=1e-6)
    share = np.cumsum(values[order]) / values.sum()
    kept = [c for c in cluster.pca(df, cols, 0.95).columns if c.startswith("pc")]
    assert len(kept) == int((share <= 0.95).sum()) + 1


def test_pipeline(feats):
    rng = np.random.default_rng(7)
    rows = [request(ip=f"10.0.0.{i % 30}", at=int(rng.integers(0, 86400)), size=str(rng.integers(1, 99)),
                    status=str(rng.choice([200, 404, 500])), uri="/" * int(rng.integers(1, 9)))
            for i in range(400)]
    out = cluster.cluster_ips(feats(rows), n_init=2)
    assert out.count() == 30
    assert {"cluster", "outlier_cluster", "pca_x", "pca_y", "hour_mean"} <= set(out.columns)
    assert not [c for c in out.columns if c.startswith("z_")]
    assert cluster.cluster_points(out).columns == ["ip", "pca_x", "pca_y", "cluster", "is_outlier"]
    assert len(cluster.cluster_summary(out).columns) == 9
    few = cluster.cluster_ips(feats([request(ip=f"{i}") for i in range(3)]))
    assert few.count() == 3 and "cluster" not in few.columns


def test_kmeans_does_not_depend_on_partitions(spark):
    x = np.random.default_rng(8).normal(size=(400, 3))
    df, cols = frame(spark, x)
    a, b = (cluster.kmeans_clusters(d, 4, cols, n_init=3).toPandas().sort_values("ip").cluster.tolist()
            for d in (df, df.repartition(7)))
    assert a == b


def test_all_models_equal_plain_lloyd(spark):
    """Every start of every k moves as a loop of its own would, and the best one is kept."""
    x = blobs(11, [60, 50, 40, 7], 3, 0.7, 3)
    df, cols = frame(spark, x)
    points = kmeans.fixed_point(df, cols)
    models = kmeans.fit(points.repartition(5), [2, 4, 6], 4, 42)
    again = kmeans.fit(points, [2, 4, 6], 4, 42)
    for k, model in models.items():
        costs = []
        for start in kmeans.starts(points, [k], 4, 42):
            centres = start.centres
            for _ in range(300):
                own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
                moved = np.array([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(k)])
                if np.allclose(moved, centres, atol=1e-12):
                    break
                centres = moved
            costs.append(((x - centres[own]) ** 2).sum())
            if start.start == model.start:
                np.testing.assert_allclose(model.centres, centres, atol=1e-7)
        assert model.cost / kmeans.COST_STEPS == pytest.approx(min(costs), rel=1e-3)
        assert (model.centres == again[k].centres).all() and model.sums == again[k].sums
        labelled = df.withColumn("cluster", kmeans.label(cols, model)).toPandas().sort_values("ip")
        own = ((x[:, None] - model.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert labelled.cluster.tolist() == own.tolist()


def test_kmeans_of_few_and_equal_points(spark):
    df, cols = frame(spark, np.zeros((6, 2)))
    assert cluster.kmeans_clusters(df, 3, cols).where("cluster = 0").count() == 6
    assert cluster.kmeans_clusters(df.limit(0), 3, cols).count() == 0
    assert cluster.choose_k(df, cols) == 2
    distinct, names = frame(spark, np.arange(5.0).reshape(-1, 1))
    scores = cluster.silhouettes_by_k(distinct, names, n_init=2)
    assert sorted(scores) == [2, 3, 4] and all(0 <= low <= high for low, high in scores.values())


def test_silhouette_bounds_hold_the_exact_one(spark):
    x = blobs(12, [150, 120, 90, 40], 3, 0.6, 4)
    df, cols = frame(spark, x)
    points = kmeans.fixed_point(df, cols)
    models = kmeans.fit(points, range(2, 7), 2, 42)
    exact = {k: brute_silhouette(x, ((x[:, None] - m.centres[None]) ** 2).sum(axis=2).argmin(axis=1))
             for k, m in models.items()}
    width = None
    for cells in (8, 40, 400):
        found = silhouettes.bounds(points.repartition(3), models, cells)
        assert all(low - 1e-6 <= exact[k] <= high + 1e-6 for k, (low, high) in found.items())
        narrower = sum(high - low for low, high in found.values())
        assert width is None or narrower < width
        width = narrower
    assert width < 1e-5  # a pivot at every point
    assert silhouettes.squared(points, models) == pytest.approx({
        k: cluster.silhouette(df.withColumn("own", kmeans.label(cols, m)), cols, "own") for k, m in models.items()},
        abs=1e-4)
    want = max(exact, key=lambda k: (exact[k], -k))
    for cells in ((8,), (8, 32), (400,)):  # decided by exact distances, or by ever smaller cells
        assert cluster.choose_k(df, cols, 6, n_init=2, cells=cells) == want


def test_bounds_decide_without_all_pairs(spark, monkeypatch):
    """Twenty thousand points in clear groups: 256 cells tell the best k, no exact distance is asked for."""
    rows = spark.range(20_000).select(F.col("id").alias("ip"), *[
        (F.when(F.col("id") % 3 == i, 20).otherwise(0) + F.rand(i)).alias(f"f{i}") for i in range(2)])
    asked = []
    monkeypatch.setattr(cluster, "euclidean_silhouettes", lambda *a, **b: asked.append(a))
    tried, bounds = [], silhouettes.bounds
    monkeypatch.setattr(silhouettes, "bounds", lambda p, m, n: tried.append(n) or bounds(p, m, n))
    assert cluster.choose_k(rows, ["f0", "f1"], 5, n_init=2) == 3
    assert not asked and sum(tried) * 20_000 < 20_000 ** 2 / 50


def test_one_metric_at_every_size(spark):
    for n in (19_000, 21_000):
        rows = spark.range(n).select(F.col("id").alias("ip"), *[
            (F.when(F.col("id") % 3 == i, 20).otherwise(0) + F.rand(i)).alias(f"f{i}") for i in range(2)])
        assert cluster.choose_k(rows, ["f0", "f1"], 4, n_init=1) == 3
    labels = df_labels = np.arange(90) % 3
    x = np.random.default_rng(9).normal(size=(90, 2)) + labels[:, None]
    df, cols = frame(spark, x)
    marked = df.withColumn("band", F.expr("cast(substr(ip, 2) as int) % 3"))
    assert cluster.silhouette(marked, cols, "band", metric="euclidean") == pytest.approx(
        brute_silhouette(x, df_labels))
    with pytest.raises(ValueError):
        cluster.choose_k(df, cols, metric="auto")


@pytest.mark.parametrize("far", [0.0, 1e5])
def test_strips_are_bounded_and_near_pairs_exact(far):
    """However many rows are on the right, a strip holds a bounded number of distances."""
    rng = np.random.default_rng(3)
    left, right = rng.normal(size=(60, 5)) + far, rng.normal(size=(30_000, 5)) + far
    right[:40] = left[:40]
    want = ((left[:, None] - right[None]) ** 2).sum(axis=2)
    found = list(distances.strips(left, right))
    assert max(square.size for _, square in found) <= distances.STRIP < want.size
    assert np.allclose(np.concatenate([square for _, square in found]), want, rtol=1e-9 if not far else 1e-4, atol=0)
    pairs = [np.column_stack(p) for p in distances.near_pairs(left, right, 0.8)]
    exact = sum((left[:, d, None] - right[None, :, d]) ** 2 for d in range(5)) <= 0.8 * 0.8
    assert np.array_equal(np.concatenate(pairs), np.argwhere(exact))


def test_points_meet_few_blocks():
    """Copies of a point, one per block, do not grow with the points from one size to the next."""
    assert all(-(-n // distances.block_rows(n)) <= 8 for n in (9_000, 90_000, 250_000))
    assert -(-540_000 // distances.block_rows(540_000)) <= 17


def test_dbscan_copies_few_points_near_cuts(spark, monkeypatch):
    """Cuts where few points lie near them: no more copies than the smaller leaves save."""
    import hitlens.operators.dbscan as module
    placed, place = [], module._place
    monkeypatch.setattr(module, "_place", lambda items, *a: placed.append(
        place(items, *a).count() / items.count()) or place(items, *a))
    x = np.random.default_rng(8).normal(size=(1500, 6)) * 1.2
    df, cols = frame(spark, x)
    out = module.dbscan(df, cols, block=150).toPandas().sort_values("ip")
    assert out["outlier_cluster"].tolist() == brute_dbscan(x, 0.5, 5).tolist()
    assert placed[0] < 5, placed


def test_rounds_take_small_strips():
    """A round's distances stay in a processor's cache, and every row is in one strip."""
    import pyarrow as pa
    x = np.arange(2000).reshape(1000, 2)
    batch = pa.RecordBatch.from_arrays([pa.array(x.tolist())], names=["x"])
    found = list(kmeans.matrices([batch], 2, kmeans._ROUND_STRIP))
    assert max(map(len, found)) <= 128 and np.array_equal(np.concatenate(found), x)
