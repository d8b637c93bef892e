"""Steps that must stay bounded as tables grow: same results as brute force, bounded blocks, spread work."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickwright.operators import neighbors as nn


def frame(spark, x, label=None, **more):
    label = np.arange(len(x)) % 7 if label is None else label
    rows = [(i, [float(v) for v in r], float(c), *(int(v[i]) for v in more.values())) for i, (r, c) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows, ", ".join(["id bigint, features array<double>, label double", *[f"{c} int" for c in more]]))


def brute(x, k, ex, metric):
    d = nn.pair_distances(x, x, metric)
    d[ex[:, None] == ex[None, :]] = np.inf
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return {(i, r + 1, int(j), float(d[i, j])) for i, row in enumerate(order) for r, j in enumerate(row) if np.isfinite(d[i, j])}


def sphere(n, dims=24, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_knn_meets_blocks_where_cells_rule_out_nothing(spark, metric, monkeypatch):
    x = sphere(300)
    x[200:260] = x[0]  # copies: equal distances go by id
    fold = np.arange(300) % 4
    asked = []
    monkeypatch.setattr(nn, "grid", lambda *a, real=nn.grid: asked.append(a[4:6]) or real(*a))
    got = nn.knn_join(frame(spark, x, fold=fold), frame(spark, x, fold=fold), 6, exclude="fold", metric=metric, broadcast_bytes=0, block_rows=40, grid_bytes=24 * 8 * 120, grid_queries=80)
    assert {(r["query_id"], r["rank"], r["train_id"], r["distance"]) for r in got.collect()} == brute(x, 6, fold, metric)
    assert asked == [(4, 3)]  # chunks of queries, blocks of training rows


def test_knn_scan_is_spread_by_pairs(spark, monkeypatch):
    x = sphere(200)
    monkeypatch.setattr(nn, "TASK_PAIRS", 200 * 200 // 5)
    df = frame(spark, x).coalesce(1)
    spread = nn._knn_broadcast
    tasks = []
    monkeypatch.setattr(nn, "_knn_broadcast", lambda *a: tasks.append(spread(*a)) or tasks[-1])
    got = nn.knn_join(df, df, 3, exclude="id")
    assert {(r["query_id"], r["rank"], r["train_id"], r["distance"]) for r in got.collect()} == brute(x, 3, np.arange(200), "euclidean")
    assert tasks[0].rdd.getNumPartitions() == 5


@pytest.mark.parametrize("shift", [0.0, 1e7])
def test_rounded_products_name_every_candidate(shift):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(900, 12)), 1) + shift
    x[100:400] = x[rng.integers(0, 20, 300)]
    x[7, 3], x[8, 4] = np.nan, np.inf
    ex = np.arange(900) % 5
    for metric in ("euclidean", "manhattan"):
        i, j, d = nn.nearest(x, x, ex, ex, 4, metric)
        with np.errstate(invalid="ignore"):
            full = nn.pair_distances(x, x, metric)
        full[(ex[:, None] == ex[None, :]) | ~np.isfinite(full)] = np.inf
        order = np.argsort(full, axis=1, kind="stable")[:, :4]
        want = [(a, b, full[a, b]) for a, row in enumerate(order) for b in row if np.isfinite(full[a, b])]
        assert list(zip(i, j, d)) == want


# ---- silhouettes ----------------------------------------------------------------------------------------


def test_distance_sums_by_tiles(spark):
    """A batch against all rows never holds their whole distance matrix, and copies keep distance 0."""
    import tracemalloc

    from tickwright.operators import cluster as cl

    x = sphere(6000, 16)
    x[:1500] = x[0] + 3.0
    x[1500:1600] = x[0] + np.random.default_rng(2).normal(size=(100, 16)) * 1e-9
    member = np.eye(3)[np.arange(6000) % 3]
    tracemalloc.start()
    got = cl.distance_sums(x, x, member)
    assert tracemalloc.get_traced_memory()[1] < 6000 * 6000 * 8 / 2
    tracemalloc.stop()
    want = nn.pair_distances(x, x, "euclidean") @ member
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)
    assert (cl.distance_sums(x[:1500], x[:1500], np.ones((1500, 1))) == 0).all()


def test_silhouette_grid_matches_scan(spark):
    from tickwright.operators import cluster as cl

    df = frame(spark, sphere(200, 12))
    a = {r["id"]: r["silhouette"] for r in cl.silhouette(df, label="label").collect()}
    b = {r["id"]: r["silhouette"] for r in cl.silhouette(df, label="label", broadcast_bytes=0, rows=30).collect()}
    assert len(a) == 200 and all(abs(a[i] - b[i]) < 1e-9 for i in a)


# ---- points within a distance ---------------------------------------------------------------------------


def test_counts_and_clusters_where_every_ring_is_mixed(spark, monkeypatch):
    """No query is copied for each ring; counts and clusters stay those of brute force."""
    from tickwright.operators import cluster as cl
    from tickwright.operators import metric

    x = sphere(400, 16)
    x[300:340] = x[1]
    eps, d = 0.95, nn.pair_distances(x, x, "euclidean")
    for name, value in {"BLOCK_ROWS": 16, "BALL_ROWS": 16, "GRID_QUERIES": 150, "GRID_BYTES": 16 * 8 * 120}.items():
        monkeypatch.setattr(metric, name, value)
    met = []
    monkeypatch.setattr(metric, "grid", lambda *a, real=nn.grid: met.append(a[4:6]) or real(*a))
    got = {r["id"]: r["neighbors"] for r in cl.neighborhood_counts(frame(spark, x), eps).collect()}
    assert got == dict(enumerate((d <= eps).sum(1).tolist())) and met == [(3, 3)]
    found = {r["id"]: r["cluster"] for r in cl.dbscan(frame(spark, x), eps, 4).collect()}
    core = (d <= eps).sum(1) >= 4
    label = np.where(core, np.arange(400), 400)
    while True:
        new = np.where(core, np.where((d <= eps) & core[None, :], label[None, :], 400).min(1), 400)
        if (new == label).all():
            break
        label = new
    order = {c: i for i, c in enumerate(sorted(set(label[core])), 1)}
    of = np.array([order.get(c, 0) for c in label])
    reach = np.where((d <= eps) & core[None, :], of[None, :], 10**6).min(1)
    assert found == {i: int(of[i]) if core[i] else int(reach[i]) if reach[i] < 10**6 else 0 for i in range(400)}
    assert len(met) > 1 and 1 < len(order)


@pytest.mark.parametrize("dims", [2, 16])
def test_tiles_within_agree_with_distances(dims):
    from tickwright.operators import metric

    x = np.round(np.random.default_rng(4).normal(size=(700, dims)), 1)
    eps = float(np.partition(nn.pair_distances(x, x, "euclidean").ravel(), 5000)[5000])  # many pairs lie exactly there
    want = nn.pair_distances(x, x, "euclidean") <= eps
    got = np.zeros_like(want)
    for i, j, hit in metric.tiles_within(x, x, eps):
        got[i : i + hit.shape[0], j : j + hit.shape[1]] = hit
    assert (got == want).all()
