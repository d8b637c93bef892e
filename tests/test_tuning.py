"""Grid searches against the same folds by hand."""

import json

import numpy as np
import pytest

from tickwright.operators import forest as fo
from tickwright.operators import tuning
from tickwright.sources.reference_data import read_validation_symbols


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) + [100, 0, 0]
    y = x @ [1.0, -2.0, 0.5] + np.sin(3 * x[:, 1]) + rng.normal(size=200) * 0.1
    x[7] = x[8]
    rows = [(i, [float(v) for v in r], *map(float, r), float(t), i % 5) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id bigint, features array<double>, a double, b double, c double, label double, fold int")
    return df.cache(), x, y, np.arange(200) % 5


def scores(df):
    return {r["params"]: r["score"] for r in df.collect()}


def test_linear_folds(table):
    df, x, y, fold = table
    got = scores(tuning.tune_linear(df, ["a", "b", "c"], (0.0,)))
    squares = 0.0
    for k in range(5):
        a = np.column_stack([np.ones((fold != k).sum()), x[fold != k]])
        beta, *_ = np.linalg.lstsq(a, y[fold != k], rcond=None)
        squares += ((y[fold == k] - beta[0] - x[fold == k] @ beta[1:]) ** 2).sum()
    assert got == {"ridge=0": pytest.approx(-squares / 200, rel=1e-8)}
    best = tuning.best_candidate(tuning.tune_linear(df, ["a", "b", "c"], (0.0, 1e6))).first()
    assert best["params"] == "ridge=0"


def test_neighbour_folds(table):
    df, x, y, fold = table
    got = scores(tuning.tune_knn(df, (1, 4, 500)))
    for metric in ("euclidean", "manhattan"):
        diff = x[:, None] - x[None]
        d = np.sqrt((diff**2).sum(2)) if metric == "euclidean" else np.abs(diff).sum(2)
        d[fold[:, None] == fold[None]] = np.inf
        order = np.lexsort((np.broadcast_to(np.arange(200), d.shape), d), axis=1)
        for k in (1, 4, 500):
            plain, inverse = np.empty(200), np.empty(200)
            for i in range(200):
                near = [j for j in order[i] if np.isfinite(d[i, j])][:k]
                w = d[i, near]
                plain[i] = y[near].mean()
                inverse[i] = y[near][w == 0].mean() if (w == 0).any() else (y[near] / w).sum() / (1 / w).sum()
            if k < 500:
                assert got[f"metric={metric}, weights=uniform, k={k}"] == pytest.approx(-((plain - y) ** 2).mean())
                assert got[f"metric={metric}, weights=distance, k={k}"] == pytest.approx(-((inverse - y) ** 2).mean())
    assert len(got) == 12


def test_forest_folds(spark, table):
    df, x, y, fold = table
    model = fo.fit_forest(df, 15, 6, 2, 2, fold="fold", folds=5)
    keys = np.array([r["h"] for r in df.selectExpr("id", "xxhash64(id) AS h").orderBy("id").collect()])
    import pandas as pd

    bins = fo.binned(pd.Series(list(x)), model.cuts)
    for t in (0, 7):  # a tree is that of the rows outside its fold
        own = fold != t % 5
        alone = fo.grow_branch(bins[own][w], y[own][w], fo.bag_weights(keys[own], t, 42)[w], t, 1, model.cfg) if (w := fo.bag_weights(keys[own], t, 42) > 0).any() else []
        mine = model.tree == t
        assert sorted(r[1] for r in alone) == model.node[mine].tolist()
    got = {(r["depth"], r["trees"]): r["mse"] for r in fo.out_of_fold(model, df, "fold", [2, 6], [1, 3]).collect()}
    for depth in (2, 6):
        values = model.tree_values(bins, depth)
        for count in (1, 3):
            p = np.array([values[i, [t for t in range(15) if t % 5 == fold[i]][:count]].mean() for i in range(200)])
            assert got[depth, count] == pytest.approx(((p - y) ** 2).mean())
    shallow = fo.fit_forest(df, 15, 2, 2, 2, fold="fold", folds=5)
    assert np.allclose(shallow.tree_values(bins), model.tree_values(bins, 2))
    table_ = tuning.tune_forest(df, (2, 6), (1, 3), (2,), (2,))
    assert table_.count() == 4 and tuning.best_candidate(table_).first()["params"].startswith("depth=6")


def test_support_vector_folds(table):
    df, *_ = table
    got = scores(tuning.tune_svr(df, ["a", "b", "c"], (1e-4, 1.0), kernels=("linear",), folds=5))
    assert got["kernel=linear, c=1, epsilon=0.1"] > got["kernel=linear, c=0.0001, epsilon=0.1"] > -20


def test_validation_symbols(spark, tmp_path):
    (tmp_path / "held.json").write_text(json.dumps({"us_stocks": ["A", "B"], "ind_stocks": ["C", "C"], "none": []}, indent=1))
    got = {(r["category"], r["symbol"]) for r in read_validation_symbols(spark, str(tmp_path / "held.json")).collect()}
    assert got == {("us_stocks", "A"), ("us_stocks", "B"), ("ind_stocks", "C")}
