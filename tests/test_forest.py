"""Forests against a plain grower, one node at a time."""

import numpy as np
import pytest

from tickwright.operators import classify as cf
from tickwright.operators import forest as fo


def data(spark, n=400, d=6, classes=0, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).round(1)
    y = (x[:, 0] * 2 > x[:, 1]).astype(float) + (x[:, 2] > 0.5) if classes else x[:, 0] * 3 + x[:, 1] ** 2 + rng.normal(size=n) * 0.1
    rows = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id bigint, features array<double>, label double"), x, np.asarray(y, float)


def plain_tree(x, y, w, tree, node, cfg):
    """Every split of every allowed feature by direct sums; the same ties."""
    def spread(mask):
        t = w[mask].sum()
        if cfg["classes"]:
            p = np.array([w[mask & (y == c)].sum() for c in range(cfg["classes"])]) / t
            return 1 - (p * p).sum()
        m = (w[mask] * y[mask]).sum() / t
        return (w[mask] * (y[mask] - m) ** 2).sum() / t

    out = {}

    def grow(mask, node):
        best = (1e-12, None, None)
        if int(node).bit_length() <= cfg["depth"]:
            for f in fo.subsets(tree, np.array([node]), x.shape[1], cfg["take"], cfg["seed"])[0]:
                for b in range(fo.BINS):
                    left, right = mask & (x[:, f] <= b), mask & (x[:, f] > b)
                    if min(w[left].sum(), w[right].sum()) >= max(cfg["min_leaf"], 1e-9):
                        gain = spread(mask) - (w[left].sum() * spread(left) + w[right].sum() * spread(right)) / w[mask].sum()
                        if gain > best[0] + 1e-10:
                            best = (gain, int(f), b)
        out[node] = best[1:] if best[1] is not None else (-1, 0)
        if best[1] is not None:
            grow(mask & (x[:, best[1]] <= best[2]), 2 * node)
            grow(mask & (x[:, best[1]] > best[2]), 2 * node + 1)

    grow(w > 0, node)
    return out


@pytest.mark.parametrize("classes, local", [(0, 20_000), (3, 20_000), (0, 40), (3, 0)])
def test_trees_equal_a_plain_grower(spark, classes, local):
    df, x, y = data(spark, classes=classes)
    model = fo.fit_forest(df.repartition(3), trees=3, depth=5, min_leaf=4, take=3, classes=classes, local_rows=local)
    keys = {r["id"]: r["h"] for r in df.selectExpr("id", "xxhash64(id) AS h").collect()}
    bins = fo.binned(np_series(x), model.cuts)
    for t in range(3):
        w = fo.bag_weights(np.array([keys[i] for i in range(len(x))]), t, 42)
        want = plain_tree(bins.astype(int), y, w, t, 1, model.cfg)
        own = model.tree == t
        got = dict(zip(model.node[own].tolist(), zip(model.feature[own].tolist(), model.bin[own].tolist())))
        inner = {k: v for k, v in want.items() if v[0] >= 0}
        assert {k: v for k, v in got.items() if v[0] >= 0} == inner and set(got) == set(want)


def np_series(x):
    import pandas as pd

    return pd.Series(list(x))


def test_bags_are_poisson():
    w = np.stack([fo.bag_weights(np.arange(20_000), t, 1) for t in range(20)])
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    assert (w[0] != w[1]).mean() > 0.5 and (fo.bag_weights(np.arange(20_000), 3, 1) == w[3]).all()


def test_predictions_and_out_of_bag_votes(spark):
    df, x, y = data(spark, 500, classes=3, seed=4)
    model = fo.fit_forest(df, trees=30, depth=8, classes=3)
    bins = fo.binned(np_series(x), model.cuts)
    values = model.tree_values(bins)
    keys = np.array([r["h"] for r in df.selectExpr("id", "xxhash64(id) AS h").orderBy("id").collect()])
    bag = np.stack([fo.bag_weights(keys, t, 42) for t in range(30)], 1)
    wrong = voted = 0
    for i in range(500):
        asked = values[i][bag[i] == 0]
        if len(asked):
            tally = np.bincount(asked.astype(int), minlength=3)
            voted += 1
            wrong += tally.argmax() != y[i]
    got = cf.oob_error(df, trees=30, depth=8, classes=3, take=None).first()
    assert got["voted_rows"] == voted and got["oob_error"] == pytest.approx(wrong / voted) and got["oob_error"] < 0.25
    rows = model.transform(df).orderBy("id").collect()
    assert [r["prediction"] for r in rows] == [float(np.bincount(v.astype(int), minlength=3).argmax()) for v in values]
    assert model.importances.sum() == pytest.approx(1) and model.importances[:3].sum() > 0.6


def test_regression_quality_and_uncertainty(spark):
    df, x, y = data(spark, 800, seed=2)
    model = fo.fit_forest(df, trees=20, depth=10, min_leaf=2, take=4)
    rows = model.transform(df).orderBy("id").collect()
    p = np.array([r["prediction"] for r in rows])
    assert 1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.9
    values = model.tree_values(fo.binned(np_series(x), model.cuts))
    assert [r["uncertainty"] for r in rows] == pytest.approx(values.std(1).tolist())


def test_empty_and_constant_rows(spark):
    none = spark.createDataFrame([], "id bigint, features array<double>, label double")
    assert fo.fit_forest(none, trees=2).transform(none).count() == 0
    same = spark.createDataFrame([(i, [1.0, float("nan")], 2.0) for i in range(9)] + [(9, None, 1.0), (10, [0.0, 0.0], None)], none.schema)
    out = fo.fit_forest(same, trees=3).transform(same.where("features IS NOT NULL")).collect()
    assert {r["prediction"] for r in out} == {2.0}
