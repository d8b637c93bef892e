"""Units of a k-d tree: bounded pairs of rows, and the results of plain methods."""

import numpy as np
import pytest

from tickwright.operators import cluster as cl
from tickwright.operators import units
from tickwright.operators.neighbors import pair_distances


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, features array<double>")


def test_crowded_rows_within_the_distance_do_not_meet(spark, monkeypatch):
    """Rows on lines, a hundred times denser than the distance asks for: clusters need few pairs of rows."""
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.uniform(0, 20, 6000), rng.integers(0, 3, 6000) * 2.0])
    asked = []
    monkeypatch.setattr(units, "dealt", lambda s, a, b, rows, real=units.dealt: asked.append(int(rows.sum())) or real(s, a, b, rows))
    monkeypatch.setattr(units.into_units, "__defaults__", (64,))
    label = 1 + np.unique(x[:, 1], return_index=True)[1].argsort().argsort()[(x[:, 1] / 2).astype(int)]
    got = {r["id"]: r["cluster"] for r in cl.single_linkage(frame(spark, x), 1.5).collect()}
    assert got == dict(enumerate(label.tolist()))
    got = {r["id"]: r["cluster"] for r in cl.dbscan(frame(spark, x), 1.5, 4).collect()}
    assert got == dict(enumerate(label.tolist()))
    assert sum(asked) < 10 * len(x)  # rows of units that are met, though hundreds of rows lie near each row
    odd = spark.createDataFrame([(0, [0.0, None]), (1, [0.0, 0.0]), (2, [0.5, 0.0]), (3, [float("nan"), 0.0])], "id bigint, features array<double>")
    assert {r["id"]: r["cluster"] for r in cl.dbscan(odd, 1.0, 2).collect()} == {0: 0, 1: 1, 2: 1, 3: 0}


@pytest.mark.parametrize("local", [0, 1 << 20])
def test_spanning_tree_of_many_units(spark, local):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.integers(0, 30, (500, 2)).astype(float), rng.normal(60, 1, (400, 2)), [[500.0, 0.0]]])
    x = rng.permutation(np.unique(x, axis=0))
    _, tree = cl.spanning_tree(frame(spark, x), broadcast_bytes=local, block_rows=32)
    up, length = units.prim(pair_distances(x, x, "euclidean"))
    want = {(min(i, j), max(i, j), d) for i, (j, d) in enumerate(zip(up.tolist(), length.tolist())) if j >= 0}
    assert {tuple(r) for r in tree.collect()} == want


def test_units_far_apart_are_not_compared():
    x = np.random.default_rng(1).uniform(0, 100, (8192, 2))
    leaf = units.Tree(x, 7).leaf(x)
    boxes = units.Boxes.__new__(units.Boxes)
    rows = [x[leaf == i] for i in range(128)]
    boxes.unit = np.arange(128)
    boxes.low, boxes.high = np.array([r.min(0) for r in rows]), np.array([r.max(0) for r in rows])
    ends = np.stack([np.array([r[pick(r[:, k])] for r in rows]) for k in (0, 1) for pick in (np.argmin, np.argmax)], axis=1)
    longest = np.array([units.prim(pair_distances(r, r, "euclidean"))[1].max() for r in rows])
    a, b = units.unit_pairs(boxes, longest, ends)
    assert len(a) < 128 * 12  # of 8128 pairs
    up, _ = units.prim(pair_distances(x, x, "euclidean"))
    pairs = set(zip(a.tolist(), b.tolist()))
    assert all(leaf[i] == leaf[j] or (min(leaf[i], leaf[j]), max(leaf[i], leaf[j])) in pairs for i, j in enumerate(up) if j >= 0)


def test_neighbour_search_holds_bounded_blocks_in_a_worker(spark, monkeypatch):
    """No worker gets all training rows of more than 4 MB; blocks are of 8 MB at most."""
    from tickwright.operators import neighbors as nn

    x = np.random.default_rng(3).normal(size=(9000, 64))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, features array<double>")
    sizes, asked = [], []
    monkeypatch.setattr(nn, "_knn_broadcast", lambda *a: sizes.append(a) or a[0].sparkSession.createDataFrame([], a[4]))
    monkeypatch.setattr(nn, "grid", lambda *a, real=nn.grid: asked.append(a[4:6]) or real(*a))
    nn.knn_join(df, df.limit(5), 3, exclude="id")
    assert not sizes and asked == [(1, 1)]
    nn.knn_join(df, df.limit(5), 3, exclude="id", grid_bytes=1 << 20)
    assert asked[1:] == [(1, 5)]


def test_links_of_a_large_tree_are_drawn_together_in_tasks(spark, monkeypatch):
    """Most links never leave a task, many units share one, and large keys keep their digits."""
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.uniform(0, 50, 1500), rng.integers(0, 3, 1500) * 4.0])
    ids = 2**60 + np.arange(len(x))
    links, tasks = [], []
    monkeypatch.setattr(cl, "connected_components", lambda n, e, real=cl.connected_components: links.append(e.count()) or real(n, e))
    monkeypatch.setattr(units, "tasks_of", lambda n, real=units.tasks_of: tasks.append((n, real(n))) or real(n))
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "id bigint, features array<double>")
    got = {r["id"]: r["cluster"] for r in cl.single_linkage_k(df, 3, block_rows=64).collect()}
    label = 1 + np.unique(x[:, 1], return_index=True)[1].argsort().argsort()[(x[:, 1] / 4).astype(int)]
    assert got == dict(zip(ids.tolist(), label.tolist()))
    assert sum(links) < len(x) // 3
    assert units.tasks_of(4096) == 64 and max(n for n, _ in tasks) >= 64


def test_trees_by_parts_and_by_rows_agree():
    rng = np.random.default_rng(8)
    for x in (rng.integers(0, 9, (150, 2)).astype(float), rng.normal(size=(90, 3)), np.zeros((1, 2)), rng.normal(size=(2, 2))):
        d = pair_distances(*[rng.permutation(np.unique(x, axis=0))] * 2, "euclidean")
        for a, b in zip(units.prim(d), units.boruvka(d)):
            assert (a == b).all()


def test_manhattan_sums_choose_among_many_rows_at_once():
    """Rows are summed a few at a time and chosen by whole limits for 256 at a time, exactly as measured."""
    from tickwright.operators import neighbors as nn

    x = np.random.default_rng(9).integers(0, 6, (5300, 16)).astype(float)  # many equal distances
    a, b, fold = x[:300], x[300:], np.arange(5300) % 3
    near = nn.Rounded(a, b, "manhattan")
    assert near.rows == 8 * nn.SUM_ROWS and near.top(np.array([7.9, np.inf])).tolist() == [7, 32767]
    d = np.where(fold[:300, None] == fold[None, 300:], np.inf, pair_distances(a, b, "manhattan"))
    want = np.argsort(d, axis=1, kind="stable")[:, :7]
    i, j, got = nn.nearest(a, b, fold[:300], fold[300:], 7, "manhattan")
    assert (i == np.repeat(np.arange(300), 7)).all() and (j == want.ravel()).all() and (got == np.take_along_axis(d, want, 1).ravel()).all()
