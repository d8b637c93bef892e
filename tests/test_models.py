"""Models and distributed algorithms against brute force on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickwright.functions.position import with_global_rank, with_running_totals
from tickwright.operators import classify as cf
from tickwright.operators import cluster as cl
from tickwright.operators import features as ft
from tickwright.operators import joins, metric
from tickwright.operators import neighbors as nn
from tickwright.operators import regression as rg
from tickwright.operators import timeseries as ts


def cloud(spark, n=300, d=3, seed=0, hot=0):
    """Random points; ``hot`` of them share one position."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[:hot] = x[0]
    rows = [(i, [float(v) for v in row], float(i % 4), i % 5) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, features array<double>, label double, fold int"), x


def brute_knn(x, k, same):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    d[same] = np.inf
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :k]
    return {(i, int(r)): (int(j), round(float(d[i, j]), 9)) for i in range(len(x)) for r, j in enumerate(order[i], 1)}


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("exclude", ["id", "fold"])
def test_knn_both_paths_match_brute_force(spark, limit, exclude):
    df, x = cloud(spark, 240, 3, hot=80)
    n = len(x)
    same = np.eye(n, dtype=bool) if exclude == "id" else (np.arange(n)[:, None] % 5) == (np.arange(n)[None] % 5)
    got = nn.knn_join(df, df, 4, exclude=exclude, broadcast_bytes=limit, block_rows=40)
    rows = {(r["query_id"], r["rank"]): (r["train_id"], round(r["distance"], 9)) for r in got.collect()}
    assert rows == brute_knn(x, 4, same)


def test_knn_manhattan_cells(spark):
    df, x = cloud(spark, 120, 4)
    got = nn.knn_join(df, df, 3, exclude="id", metric="manhattan", broadcast_bytes=0, block_rows=30)
    d = np.abs(x[:, None] - x[None]).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, 1)[:, :3]
    for r in got.collect():
        assert abs(r["distance"] - want[r["query_id"], r["rank"] - 1]) < 1e-9


def test_knn_exact_match_counts_alone(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (1, 1.0, 9.0), (2, 2.0, 4.0), (2, 4.0, 8.0)], "query_id int, distance double, label double")
    got = {r["query_id"]: r["prediction"] for r in nn.knn_predict(df).collect()}
    assert got[1] == 5.0 and abs(got[2] - (4 / 2 + 8 / 4) / (1 / 2 + 1 / 4)) < 1e-12


def labels_by_brute_force(x, eps, min_pts):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= min_pts
    label, current = np.zeros(len(x), int), 0
    for i in range(len(x)):
        if not core[i] or label[i]:
            continue
        current += 1
        todo = [i]
        while todo:
            j = todo.pop()
            if label[j]:
                continue
            label[j] = current
            if core[j]:
                todo += [int(k) for k in np.nonzero(near[j])[0] if not label[k]]
    return near.sum(1), label


@pytest.mark.parametrize("hot", [0, 150])
def test_dbscan_and_counts_match_brute_force(spark, hot):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(0, 0.3, (120, 2)), rng.normal(2, 0.3, (120, 2)), rng.uniform(-4, 6, (160, 2))])
    if hot:
        x[:hot] = np.array([0.0, 0.0]) + rng.normal(0, 0.02, (hot, 2))
        x[hot : 2 * hot] = np.array([0.25, 0.0]) + rng.normal(0, 0.02, (hot, 2))
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "id bigint, features array<double>")
    counts, label = labels_by_brute_force(x, 0.3, 5)
    got = {r["id"]: r["neighbors"] for r in cl.neighborhood_counts(df, 0.3).collect()}
    assert got == {i: int(c) for i, c in enumerate(counts)}
    found = {r["id"]: r["cluster"] for r in cl.dbscan(df, 0.3, 5).collect()}
    assert found == {i: int(c) for i, c in enumerate(label)}


def test_border_point_joins_the_lowest_cluster(spark):
    pts = [(0, [0.0, 0.0]), (1, [0.1, 0.0]), (2, [0.2, 0.0]), (3, [1.1, 0.0]), (4, [2.0, 0.0]), (5, [2.1, 0.0]), (6, [2.2, 0.0])]
    df = spark.createDataFrame(pts, "id bigint, features array<double>")
    got = {r["id"]: r["cluster"] for r in cl.dbscan(df, 0.9, 4).collect()}
    assert got == dict(enumerate(labels_by_brute_force(np.array([p[1] for p in pts]), 0.9, 4)[1]))


@pytest.mark.parametrize("local", [0, 1000])
def test_connected_components_of_a_long_chain(spark, local):
    nodes = spark.range(60).toDF("node")
    edges = spark.range(59).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).where("src <> 30")
    got = {r["node"]: r["label"] for r in cl.connected_components(nodes, edges, local).collect()}
    assert got == {i: 0 if i <= 30 else 31 for i in range(60)}


def test_silhouette_paths_agree(spark):
    df, _ = cloud(spark, 90, 3)
    a = cl.silhouette(df, label="label")
    b = cl.silhouette(df, label="label", broadcast_bytes=0, rows=25)
    assert a.join(b.select("id", F.col("silhouette").alias("s")), "id").where(F.abs(F.col("silhouette") - F.col("s")) > 1e-9).count() == 0


def test_global_rank_is_exact(spark):
    df = spark.range(5000).select("id", F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("v"))
    for hashed, order in ((False, F.col("v")), (True, F.xxhash64("id"))):
        ranked, n = with_global_rank(df, order, ["id"], hashed)
        rows = ranked.withColumn("o", order).select("o", "id", "_rank", n.alias("n")).collect()
        rows.sort(key=lambda r: (r["o"], r["id"]))
        assert [r["_rank"] for r in rows] == list(range(1, 5001)) and rows[0]["n"] == 5000


def test_running_totals_know_the_next_value(spark):
    df = spark.range(3000).select((F.col("id") * 2).alias("v"))
    out = with_running_totals(df, F.col("v"), [], {"s": F.lit(1)}).orderBy("v").collect()
    assert [r["_next"] for r in out[:-1]] == [r["v"] + 2 for r in out[:-1]] and out[-1]["_next"] is None


def test_asof_join_limits_age(spark):
    left = spark.createDataFrame([(1, "2024-01-01 00:10:00"), (2, "2024-01-01 01:09:59"), (3, "2024-01-01 01:10:00"), (4, "2024-01-01 00:00:00")], "id int, t string").select("id", F.col("t").cast("timestamp").alias("ts"))
    right = spark.createDataFrame([("2024-01-01 00:10:00", 7.0)], "t string, rate double").select(F.col("t").cast("timestamp").alias("ts"), "rate")
    got = {r["id"]: r["rate"] for r in joins.asof_join(left, right, [], "ts", ["rate"], 3600).collect()}
    assert got == {1: 7.0, 2: 7.0, 3: None, 4: None}


def test_gram_fits_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(5, 2, (400, 2))
    y = 1.5 + x @ np.array([2.0, -0.5]) + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, label double").repartition(5)
    g = rg.gram(df, ["a", "b"])
    want = np.linalg.lstsq(np.c_[np.ones(400), x], y, rcond=None)[0]
    bias, beta = g.ols()
    np.testing.assert_allclose([bias, *beta], want, rtol=1e-8)
    gd_bias, theta, mean, std = g.gradient_descent(0.01, 3000)
    np.testing.assert_allclose(theta / std, want[1:], rtol=1e-6)
    halves = rg.fit_linear_incremental([df.where("a < 5"), df.where("a >= 5")], ["a", "b"]).ols()
    np.testing.assert_allclose([halves[0], *halves[1]], want, rtol=1e-8)


@pytest.mark.parametrize("kernel", ["linear", "rbf"])
def test_svr_learns_a_line(spark, kernel):
    rng = np.random.default_rng(5)
    x = rng.uniform(-2, 2, 500)
    df = spark.createDataFrame([(float(v), float(2 * v)) for v in x], "x double, label double")
    model = rg.fit_svr(df, ["x"], kernel=kernel)
    r2 = rg.linear_metrics(model.predict(df)).first()["r2"]
    assert r2 > 0.8


def test_gram_far_from_zero(spark):
    """Means near 1e9 cost no digits, also when batches with other means are added."""
    from tickwright.operators.cluster import covariance_matrix

    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    rows = [(int(i), float(1e9 + v + 100 * (i % 2)), float(2 * (v + 100 * (i % 2)) + 5e8)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "i int, x double, label double")
    assert abs(rg.gram(df, ["x"]).ols()[1][0] - 2) < 1e-5
    assert abs(rg.fit_linear_incremental([df.where("i % 2 = 0"), df.where("i % 2 = 1")], ["x"]).ols()[1][0] - 2) < 1e-5
    vectors = df.selectExpr("array(x, label) AS features")
    got = {(r["i"], r["j"]): r["value"] for r in covariance_matrix(vectors, "features", 2).collect()}
    want = np.cov(np.array([[r[1], r[2]] for r in rows]).T)
    assert abs(got[0, 1] / want[0, 1] - 1) < 1e-6


def test_svr_cost_scales_the_loss(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(50)], "x double, label double")
    weak = rg.fit_svr(df, ["x"], c=0.001, kernel="linear")
    strong = rg.fit_svr(df, ["x"], c=10.0, kernel="linear")
    assert abs(weak.w[0]) < abs(strong.w[0])


def test_latent_reconstruction_is_exact_at_full_rank(spark):
    df, x = cloud(spark, 100, 3)
    wide = df.select(*[F.col("features")[i].alias(f"x{i}") for i in range(3)], "label")
    model = rg.fit_latent_regression(wide, ["x0", "x1", "x2"], k=3)
    assert model.reconstruction_error(wide).agg(F.max("error")).first()[0] < 1e-18


def test_svd_and_pca_match_numpy(spark):
    df, x = cloud(spark, 150, 4)
    values, axes = cl.svd(df, 4, dims=4)
    np.testing.assert_allclose(values, np.linalg.svd(x, compute_uv=False), rtol=1e-9)
    _, eig = cl.pca(df, 2, dims=4)
    np.testing.assert_allclose(eig, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1], rtol=1e-9)
    assert cl.relative_error(cl.svd_reconstruct(df, axes)).first()[0] < 1e-9


def test_oob_error_on_separable_rows(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(1)
    rows = [(i, [float(i % 2) * 10 + float(rng.normal()), float(rng.normal()), 0.0], float(i % 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, f array<double>, label double").select("id", array_to_vector("f").alias("features"), "label")
    assert cf.oob_error(df, trees=6, take=3).first()["oob_error"] < 0.05


def test_ar_weights_and_forecast(spark):
    rng = np.random.default_rng(8)
    x = np.zeros(2000)
    for t in range(2, 2000):
        x[t] = 0.6 * x[t - 1] - 0.2 * x[t - 2] + rng.normal()
    rows = [("A", i, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, n int, x double").select("symbol", F.date_add(F.lit("2000-01-01").cast("date"), F.col("n")).alias("date"), "x")
    two, three = ts.fit_ar(df, 2).first(), ts.fit_ar(df, 3).first()
    assert abs(two["phi1"] - 0.6) < 0.07 and abs(two["phi2"] + 0.2) < 0.07 and abs(three["phi3"]) < 0.07
    model = ts.arima_fit_all(df, "x", [(2, 0, 0)], 100)
    m = model.first()
    assert abs(m["ar"][0] - 0.6) < 0.06 and abs(m["sigma2"] - 1.0) < 0.1
    f = ts.arima_forecast(df, model, 3, "x").orderBy("step").collect()
    assert abs(f[0]["mean"] - (m["constant"] + m["ar"][0] * x[-1] + m["ar"][1] * x[-2])) < 1e-9
    assert f[0]["upper"] - f[0]["lower"] < f[2]["upper"] - f[2]["lower"]


def test_kfold_and_split_sizes(spark):
    df = spark.range(103).toDF("id")
    sizes = [r["count"] for r in ft.kfold(df, "id", 5).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [20, 20, 20, 20, 23]
    split = {r["split"]: r["count"] for r in ft.shuffled_split(df, "id").groupBy("split").count().collect()}
    assert split == {"train": 83, "test": 20}
    assert ft.subsample(df, "id", 10).count() == 10


def test_elbow_needs_three_points(spark):
    two = spark.createDataFrame([(1, 9.0), (2, 3.0)], "k int, wcss double")
    assert cl.elbow(two).first()["best_k"] == 1
    four = spark.createDataFrame([(1, 100.0), (2, 20.0), (3, 15.0), (4, 14.0)], "k int, wcss double")
    assert cl.elbow(four).first()["best_k"] == 2


def test_medians_of_ranges_are_exact(spark):
    from tickwright.functions.position import exact_medians

    rng = np.random.default_rng(5)
    data = {"a": rng.normal(size=1001), "b": rng.integers(0, 3, 1001).astype(float), "c": np.full(1001, np.nan), "d": np.full(1001, np.nan)}
    data["d"][:2] = 4.0, -7.0
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*data.values())]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    want = {i: float(np.nanmedian(v)) for i, v in enumerate(data.values()) if not np.isnan(v).all()}
    assert {r["_c"]: r["_m"] for r in exact_medians(df, list(data)).collect()} == want
    out = rg.impute_median(df, list(data))
    assert "median(" not in out._jdf.queryExecution().toString()
    first = out.agg(*[F.min(c).alias(c) for c in "cd"], F.count("a").alias("n")).first()
    assert tuple(first) == (0.0, -7.0, 1001) and out.where("d = -1.5").count() == 999


def test_oob_query_grows_all_trees(spark, small, monkeypatch):
    import inspect

    from tickwright.plans import p15_classification as plans

    seen = []
    grown = inspect.signature(cf.oob_error)
    monkeypatch.setattr(plans, "vector_rows", lambda spark, d: None)
    monkeypatch.setattr(plans.cf, "oob_error", lambda *a, **k: seen.append(grown.bind(*a, **k)))
    plans.oob_error(spark, small)
    seen[0].apply_defaults()
    assert seen[0].arguments["trees"] == 100


# ---- density and linkage in any number of dimensions ---------------------------------------------


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "id bigint, features array<double>")


@pytest.mark.parametrize("dims, eps", [(1, 0.2), (64, 10.0), (3, 1e9)])
def test_density_in_any_dimension(spark, monkeypatch, dims, eps):
    for name, value in (("BLOCK_ROWS", 16), ("BALL_ROWS", 12), ("QUERY_ROWS", 20), ("MAX_RINGS", 3)):
        monkeypatch.setattr(metric, name, value)
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(120, dims))
    x[:20] = x[0]  # copies
    x[20:60] = x[20] + rng.normal(size=(40, dims)) * 1e-3  # nearly copies
    df = frame(spark, x)
    counts, label = labels_by_brute_force(x, eps, 4)
    assert {r["id"]: r["neighbors"] for r in cl.neighborhood_counts(df, eps).collect()} == {i: int(c) for i, c in enumerate(counts)}
    assert {r["id"]: r["cluster"] for r in cl.dbscan(df, eps, 4).collect()} == {i: int(c) for i, c in enumerate(label)}
    if eps < 1e9:
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        same = np.array([np.flatnonzero((x == row).all(1))[0] for row in x])
        heads = np.unique(same)
        want = {(int(a), int(b)): (int((same == a).sum()), int((same == b).sum())) for a in heads for b in heads if a < b and d[a, b] <= eps}
        got = {(r["id_a"], r["id_b"]): (r["copies_a"], r["copies_b"]) for r in cl.eps_join(df, eps).collect()}
        assert got == want


def test_dense_balls_do_not_meet_row_by_row(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 16), ("BALL_ROWS", 32)):
        monkeypatch.setattr(metric, name, value)
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(500, 8)) * 0.01, rng.normal(size=(1000, 8)) * 10])
    at = metric.Layout(frame(spark, x))
    links = metric.links_within(at.places, at.rings, at.members, 1.0).collect()
    assert len(links) < 6 * len(x)  # a third of the rows lie in one ball: 125 000 pairs
    sent = metric.routes(at.places, at.rings, 1.0, lambda part, *_: part[["pos"]].iloc[:0], "pos bigint")
    assert sent.count() < 10 * len(x)


def kruskal(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    parent = list(range(len(x)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    left = len(x)
    i, j = np.triu_indices(len(x), 1)
    for n in np.lexsort((j, i, d[i, j])):
        a, b = root(int(i[n])), root(int(j[n]))
        if left > k and a != b:
            parent[max(a, b)] = min(a, b)
            left -= 1
    roots = [root(i) for i in range(len(x))]
    names = {r: n for n, r in enumerate(sorted(set(roots)), 1)}
    return {i: names[r] for i, r in enumerate(roots)}


def clusters(df):
    return {r["id"]: r["cluster"] for r in df.collect()}


def test_single_linkage_to_k_clusters(spark):
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 50, (2000, 2)).astype(float), axis=0)  # many equal distances
    rng.shuffle(x)
    of, tree = cl.spanning_tree(frame(spark, x))
    assert tree.count() == len(x) - 1
    for k in (1, 17, 400, 5000):
        assert clusters(cl.cut_tree(of, tree, k)) == kruskal(x, k)


def test_single_linkage_of_copies_and_of_cells(spark):
    x = np.random.default_rng(5).normal(size=(200, 3))
    copies = np.vstack([x, x[:60]])
    want = kruskal(x, 9)
    got = clusters(cl.single_linkage_k(frame(spark, copies), 9, broadcast_bytes=0, block_rows=60))
    assert got == want | {200 + i: want[i] for i in range(60)}


# ---- unit roots ------------------------------------------------------------------------------------


def plain_unit_root(x, lags, skip=0):
    change, first = np.diff(x), max(lags, skip)
    rows = range(first, len(change))
    a = np.array([[1.0, x[i], *[change[i - k] for k in range(1, lags + 1)]] for i in rows])
    y = change[first:]
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    sse = ((y - a @ beta) ** 2).sum()
    t = beta[1] / np.sqrt(sse / (len(y) - a.shape[1]) * np.linalg.inv(a.T @ a)[1, 1])
    return t, len(y) * np.log(sse / len(y)) + 2 * a.shape[1], len(y)


def test_augmented_dickey_fuller(bars):
    rng = np.random.default_rng(3)
    walk = 100 + np.cumsum(rng.normal(size=300))
    mean_back = np.zeros(300)
    for i in range(1, 300):
        mean_back[i] = 0.4 * mean_back[i - 1] + 0.3 * rng.normal() + (0.3 * (mean_back[i - 1] - mean_back[i - 2]) if i > 1 else 0)
    df = bars({"W": walk, "M": mean_back + 50, "C": [5.0] * 40, "S": [1.0, 2.0], "L": np.arange(50.0)})
    fixed = {r["symbol"]: r for r in ts.augmented_dickey_fuller(df, lags=3).collect()}
    for name, x in (("W", walk), ("M", mean_back + 50)):
        t, _, n = plain_unit_root(x, 3)
        assert fixed[name]["t_stat"] == pytest.approx(t, rel=1e-8) and fixed[name]["rows"] == n
    found = {r["symbol"]: r for r in ts.augmented_dickey_fuller(df).collect()}
    for name, x in (("W", walk), ("M", mean_back + 50)):
        most = int(np.ceil(12 * (len(x) / 100) ** 0.25))
        lag = min(range(most + 1), key=lambda k: plain_unit_root(x, k, most)[1])
        assert found[name]["lags"] == lag and found[name]["t_stat"] == pytest.approx(plain_unit_root(x, lag)[0], rel=1e-8)
    assert found["M"]["stationary"] and not found["W"]["stationary"]
    assert all(found[k]["t_stat"] is None and not found[k]["stationary"] for k in "CSL")


def test_unit_root_p_values():
    for t, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):  # asymptotic critical values
        assert ts.unit_root_p(t) == pytest.approx(p, rel=0.03)
    assert ts.unit_root_p(-30.0) == 0 and ts.unit_root_p(5.0) == 1
    border = ts.TAU_BORDER
    assert ts.unit_root_p(border) == pytest.approx(ts.unit_root_p(border + 1e-9), abs=2e-3)


# ---- support vectors -------------------------------------------------------------------------------


@pytest.mark.parametrize("kernel, c", [("rbf", 1.0), ("rbf", 20.0), ("linear", 1.0)])
def test_svr_is_within_a_percent_of_the_exact_dual(spark, kernel, c):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3)) * [1, 10, 0.1] + [5, 0, 0]
    y = np.sin(x[:, 0]) * 2 + 0.05 * x[:, 1] + rng.normal(size=500) * 0.2
    y[::50] += 8
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, label double")
    model = rg.fit_svr(df, ["a", "b", "c"], c=c, kernel=kernel, components=500)
    z = (x - x.mean(0)) / x.std(0)
    k = z @ z.T if kernel == "linear" else np.exp(-((z[:, None] - z[None]) ** 2).sum(2) / 3)
    p = np.array([r["p"] for r in model.predict(df, "p").collect()])
    rows = df.collect()
    order = np.array([[r["a"], r["b"], r["c"]] for r in rows])
    assert (order == x).all()
    # the exact problem by projected dual ascent on pairs, from a start of zero
    a, grad = np.zeros(500), y.copy()
    for _ in range(200_000):
        up, down = grad - 0.1 * np.where(a >= 0, 1, -1), grad + 0.1 * np.where(a > 0, -1, 1)
        i = np.where(a < c, up, -np.inf).argmax()
        j = np.where(a > -c, down, np.inf).argmin()
        if up[i] - down[j] < 1e-4:
            break
        curve = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-9)
        t = (up[i] - down[j]) / curve
        t = min(t, c - a[i], c + a[j], -a[i] if a[i] < 0 else np.inf, a[j] if a[j] > 0 else np.inf)
        a[i] += t
        a[j] -= t
        grad -= t * (k[:, i] - k[:, j])
    dual = -0.5 * a @ k @ a + a @ y - 0.1 * np.abs(a).sum()
    w2 = model.w @ model.w if kernel == "linear" else model.w @ np.exp(-((model.landmarks[:, None] - model.landmarks[None]) ** 2).sum(2) / 3) @ model.w
    primal = 0.5 * w2 + c * np.maximum(np.abs(p - y) - 0.1, 0).sum()
    assert dual * 0.999 <= primal <= dual * 1.012 and model.gap <= 0.01 and model.passes < 60, (model.gap, model.passes)


def test_svr_without_rows_and_with_few_landmarks(spark):
    none = spark.createDataFrame([], "x double, label double")
    assert rg.fit_svr(none, ["x"]).predict(none).count() == 0
    same = spark.createDataFrame([(1.0, 4.0)] * 5, "x double, label double")
    assert rg.fit_svr(same, ["x"]).predict(same).first()["prediction"] == pytest.approx(4.0, abs=0.11)
    z = np.random.default_rng(0).normal(size=(60, 2))
    rows, factor = rg.choose_landmarks(z, 0.5, 60)
    kernel = np.exp(-0.5 * rg.squared_distances(z[rows], z[rows]))
    assert np.allclose(factor @ factor.T, kernel, atol=1e-8) and len(set(rows)) == len(rows)


# ---- the number of clusters --------------------------------------------------------------------------


def test_choose_k_fits_on_train_judges_on_valid_and_chooses(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(4)
    centres = np.array([[0.0, 0.0], [20.0, 0.0], [0.0, 20.0]])
    train, valid = (np.vstack([rng.normal(c, 1, (n, 2)) for c in centres]) for n in (40, 12))
    train, held = (frame(spark, x).withColumn("features", array_to_vector("features")) for x in (train, valid))
    rows = {r["k"]: r for r in cl.choose_k(train, held, [2, 3, 4]).collect()}
    assert list(cl.choose_k.__defaults__[0]) == list(range(2, 11))
    best = min(rows, key=lambda k: (rows[k]["wcss"], k))
    assert [k for k in rows if rows[k]["best_by_wcss"]] == [best]
    assert [k for k in rows if rows[k]["recommended"]] == [3]
    x = np.array([r["features"].toArray() for r in train.collect()])
    means = np.array([x[i : i + 40].mean(0) for i in (0, 40, 80)])
    for name, y in (("train_wcss", x), ("wcss", valid)):
        assert rows[3][name] == pytest.approx(((y[:, None] - means[None]) ** 2).sum(2).min(1).sum())


def test_choose_k_query_holds_vectors_out(spark, small, monkeypatch):
    from tickwright.plans import p16_clustering as plans

    sides = []
    monkeypatch.setattr(cl, "choose_k", lambda a, b, real=cl.choose_k: sides.extend((a, b)) or real(a, b, [2, 3], passes=5))
    rows = plans.choose_k(spark, small).collect()
    train, valid = ({r["id"] for r in s.select("id").collect()} for s in sides)
    assert not train & valid and len(train) == 400 and len(valid) == 100
    assert [r["k"] for r in rows] == [2, 3] and sum(r["recommended"] for r in rows) == 1
