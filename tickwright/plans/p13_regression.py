"""Queries for the regression models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwright.functions.numeric import r6
from tickwright.operators import features as ft
from tickwright.operators import forecast as fc
from tickwright.operators import neighbors as nn
from tickwright.operators import query as reads
from tickwright.operators import regression as rg
from tickwright.operators import tuning
from tickwright.schema import FEATURES_38
from tickwright.session import materialize, scratch_path
from tickwright.sources import tables as t

from .p06_indicators import out
from .p07_features import nation_bars
from .p11_joins import KNN, vectors
from .registry import query
from .registry import r6 as q6

# ---- least squares on order lines ----------------------------------------------------------------


def lines(spark, d):
    """Line price in thousands (label) against quantity and discount."""
    line = t.table(spark, d, "lineitem")
    return line.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_discount").alias("x2"),
        (F.col("l_extendedprice") / 1000.0).alias("label"),
    )


LS = """ls AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity AS x, l_discount AS x2, l_extendedprice / 1000.0 AS y FROM lineitem),
co AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM ls), rm AS (SELECT sqrt(avg((y - a - b * x) * (y - a - b * x))) AS rmse FROM ls, co)"""
LINE_ROWS = f"SELECT 'intercept' AS feature, {q6('a', 'coefficient')} FROM co UNION ALL SELECT 'x', {q6('b', 'coefficient')} FROM co"


@query("fit_linear", f"WITH {LS} {LINE_ROWS}")
def fit_linear(spark, d):
    model = rg.fit_linear(ft.assemble(lines(spark, d), ["x"]))
    rows = rg.coefficient_rows(spark, ["x"], model.intercept, model.coefficients)
    return out(rows, ["coefficient"], ["feature"])


@query("fit_linear_metrics", f"WITH {LS} SELECT {q6('rmse * rmse', 'mse')}, {q6('rmse', 'rmse')}, {q6('(SELECT regr_r2(y, x) FROM ls)', 'r2')} FROM rm")
def fit_linear_metrics(spark, d):
    data = ft.assemble(lines(spark, d), ["x"])
    return out(rg.linear_metrics(rg.fit_linear(data).transform(data)), ["mse", "rmse", "r2"], [])


@query("fit_linear_gd")
def fit_linear_gd(spark, d):
    """Gradient descent on two z-scored columns after 1000 epochs."""
    g = rg.gram(lines(spark, d), ["x", "x2"])
    bias, theta, _, _ = g.gradient_descent(0.01, 1000)
    return out(rg.coefficient_rows(spark, ["x", "x2"], bias, theta), ["coefficient"], ["feature"])


@query("fit_linear_incremental", f"WITH {LS} {LINE_ROWS}")
def fit_linear_incremental(spark, d):
    """Batches by line number, added one after the other; equals the fit on all rows."""
    data = lines(spark, d)
    batches = [data.where(F.col("l_linenumber").isin(1, 2)), data.where(F.col("l_linenumber").between(3, 5)), data.where(F.col("l_linenumber") > 5)]
    a, b = rg.fit_linear_incremental(batches, ["x"]).ols()
    return out(rg.coefficient_rows(spark, ["x"], a, b), ["coefficient"], ["feature"])


@query(
    "predict_interval_linear",
    f"""WITH {LS} SELECT x, x2, count(*) AS n, {q6('avg(a + b * x)', 'prediction')}, {q6('avg(a + b * x - 1.96 * rmse)', 'low')}, {q6('avg(a + b * x + 1.96 * rmse)', 'high')}
 FROM ls, co, rm GROUP BY x, x2""",
)
def predict_interval_linear(spark, d):
    data = lines(spark, d)
    g = rg.gram(data, ["x"])
    a, b = g.ols()
    line = rg.linear_expr(["x"], a, b)
    rmse = data.agg(F.sqrt(F.avg((F.col("label") - line) * (F.col("label") - line)))).scalar()
    scored = rg.predict_interval(data, line, rmse)
    sums = scored.groupBy("x", "x2").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("prediction", "low", "high")])
    return out(sums, ["prediction", "low", "high"], ["x", "x2", "n"])


# ---- models on the stacked matrix -----------------------------------------------------------------


def matrix(spark, d):
    """The stacked matrix of all symbols, stored once for the passes of a fit."""
    m = ft.stack_all_symbols(nation_bars(spark, d))
    return materialize(m, "matrix")


@query("coefficients")
def coefficients(spark, d):
    model = rg.fit_linear(ft.assemble(matrix(spark, d), FEATURES_38))
    return out(rg.coefficient_rows(spark, FEATURES_38, model.intercept, model.coefficients), ["coefficient"], ["feature"])


@query("fit_tree")
def fit_tree(spark, d):
    data = ft.assemble(rg.impute_median(matrix(spark, d), FEATURES_38), FEATURES_38)
    scored = rg.fit_tree(data).transform(data)
    return out(scored, ["prediction", "label"])


@query("tree_summary")
def tree_summary(spark, d):
    return rg.tree_summary(spark, rg.fit_tree(ft.assemble(matrix(spark, d), FEATURES_38)))


TREES, DEPTH = 100, 15


def forest(spark, d):
    data = ft.assemble(matrix(spark, d), FEATURES_38)
    return rg.fit_forest(data, TREES, DEPTH), data


@query("fit_forest")
def fit_forest(spark, d):
    model, data = forest(spark, d)
    return out(model.transform(data), ["prediction", "label"])


@query("forest_uncertainty")
def forest_uncertainty(spark, d):
    model, data = forest(spark, d)
    return out(rg.forest_uncertainty(model, data), ["prediction", "uncertainty"])


@query("feature_importance")
def feature_importance(spark, d):
    return rg.feature_importance(spark, forest(spark, d)[0], FEATURES_38)


@query("top_features")
def top_features(spark, d):
    return reads.top_features(rg.feature_importance(spark, forest(spark, d)[0], FEATURES_38), 10)


@query("fit_svr")
def fit_svr(spark, d):
    """Kernel and linear support vector regression, scored on the training rows."""
    data = matrix(spark, d)
    parts = None
    for name in ("rbf", "linear"):
        model = rg.fit_svr(data, FEATURES_38, kernel=name)
        one = rg.linear_metrics(model.predict(data)).withColumn("kernel", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    return out(parts, ["mse", "rmse", "r2"], ["kernel"])


@query("tune")
def tune(spark, d):
    from pyspark.ml.regression import DecisionTreeRegressor
    from pyspark.ml.tuning import ParamGridBuilder

    tree = DecisionTreeRegressor(seed=42)
    grid = ParamGridBuilder().addGrid(tree.maxDepth, [3, 6]).addGrid(tree.minInstancesPerNode, [1, 5]).build()
    _, table = rg.tune(tree, grid, ft.assemble(matrix(spark, d), FEATURES_38), folds=5)
    return table


def folded(df, *key):
    """Five folds by a hash of the key."""
    return df.withColumn("fold", F.pmod(F.xxhash64(*key), F.lit(5)).cast("int"))


@query("tune_linear")
def tune_linear(spark, d):
    rows = folded(matrix(spark, d), "symbol", "date")
    return out(tuning.tune_linear(rows, FEATURES_38, (0.0, 1.0, 100.0)), ["score"], ["model", "params"])


@query("tune_knn")
def tune_knn(spark, d):
    rows = materialize(folded(vectors(spark, d), "id"), "folds")
    return out(tuning.tune_knn(rows), ["score"], ["model", "params"])


@query("tune_forest")
def tune_forest(spark, d):
    """Depths, tree numbers and leaf sizes; every candidate predicts each row without its fold."""
    rows = materialize(folded(ft.assemble(matrix(spark, d), FEATURES_38), "symbol", "date"), "folds")
    return out(tuning.tune_forest(rows, (5, 10), (10, 20), (1, 5), key=("symbol", "date")), ["score"], ["model", "params"])


@query("tune_svr")
def tune_svr(spark, d):
    rows = materialize(folded(matrix(spark, d), "symbol", "date"), "folds")
    return out(tuning.tune_svr(rows, FEATURES_38, (0.1, 1.0), kernels=("linear",)), ["score"], ["model", "params"])


@query("train_run_held_out")
def train_run_held_out(spark, d):
    """A forest that never sees the rows of the listed symbols, validated on all of them."""
    def fit(rows):
        return rg.fit_forest(rows, 20, 10)

    row = rg.train_run(matrix(spark, d), FEATURES_38, "random_forest", fit, scratch_path(spark, "model"), scratch_path(spark, "registry"), ["3", "7", "11"])
    return out(row, ["avg_r2", "avg_rmse", "avg_mae"], ["model", "symbols", "features"])


def registered(spark, d):
    """A training run of the linear model, saved and registered in the shared folder."""
    registry = scratch_path(spark, "registry")
    row = rg.train_run(matrix(spark, d), FEATURES_38, "linear_regression", rg.fit_linear, scratch_path(spark, "model"), registry)
    return row, registry


@query("train_run")
def train_run(spark, d):
    return out(registered(spark, d)[0], ["avg_r2", "avg_rmse", "avg_mae"], ["model", "symbols", "features"])


@query("model_registry")
def model_registry(spark, d):
    rows = rg.model_registry(spark, registered(spark, d)[1], "linear_regression")
    return out(rows, ["avg_r2"], ["model", "symbols"])


@query("fit_latent_regression")
def fit_latent_regression(spark, d):
    data = matrix(spark, d)
    model = rg.fit_latent_regression(data, FEATURES_38, k=24)
    return out(model.reconstruction_error(model.predict(data)), ["prediction", "error"])


@query("latent_encode_reconstruct")
def latent_encode_reconstruct(spark, d):
    """Codes and the loss (half the mean squared rebuild error) at 16 dimensions."""
    data = matrix(spark, d)
    model = rg.fit_latent_regression(data, FEATURES_38, k=16)
    scored = model.reconstruction_error(data)
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.avg(F.col("error")) * float(len(FEATURES_38)) / 2.0).alias("loss"),
        F.max(F.size("latent")).alias("dims"),
    )


# ---- neighbour regression --------------------------------------------------------------------------

DIMS = [f"e{i}" for i in range(64)]


def scaled_vectors(spark, d):
    """Embeddings through the neighbour model's cleaning, sampling and scaling."""
    v = vectors(spark, d).withColumns({c: F.col("features")[i] for i, c in enumerate(DIMS)})
    train = nn.knn_training_set(v, DIMS, "id")
    return nn.scale_like(train, train, DIMS).select("id", "features", "label")


SCALED = """u AS (SELECT vec_id AS id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i, label::DOUBLE AS label FROM embeddings),
st AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM u GROUP BY i),
v AS (SELECT id, label, list((x - m) / s ORDER BY i) AS f FROM u JOIN st USING (i) GROUP BY id, label HAVING bool_and(abs(x - m) <= 10 * s)),
nb AS (SELECT a.id AS query_id, b.id AS train_id, list_distance(a.f, b.f) AS distance, b.label AS label, a.label AS y,
  row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f), b.id) AS rank FROM v a JOIN v b ON a.id <> b.id)"""
WEIGHTED = "sum(label / distance) / sum(1.0 / distance)"


@query("fit_knn", f"WITH {SCALED} SELECT query_id, {q6(WEIGHTED, 'prediction')} FROM nb WHERE rank <= 5 GROUP BY query_id")
def fit_knn(spark, d):
    v = materialize(scaled_vectors(spark, d), "scaled")
    return out(nn.knn_predict(nn.knn_join(v, v, 5, exclude="id")), ["prediction"], ["query_id"])


@query(
    "knn_distances",
    f"WITH {SCALED} SELECT query_id, {q6(WEIGHTED, 'prediction')}, list(floor(distance * 1e6 + 0.5003) / 1e6 ORDER BY rank) AS distances FROM nb WHERE rank <= 15 GROUP BY query_id",
)
def knn_distances(spark, d):
    v = materialize(scaled_vectors(spark, d), "scaled")
    near = materialize(nn.knn_join(v, v, 15, exclude="id"), "near")
    full = nn.knn_distances(near)
    return full.select("query_id", r6("prediction").alias("prediction"), F.transform("distances", lambda x: r6(x)).alias("distances"))


@query(
    "knn_choose_k_scores",
    f"""WITH {KNN}, w AS (SELECT query_id, y, rank, sum(label / greatest(distance, 1e-12)) OVER (PARTITION BY query_id ORDER BY rank) / sum(1.0 / greatest(distance, 1e-12)) OVER (PARTITION BY query_id ORDER BY rank) AS p FROM nb WHERE rank <= 19)
SELECT CAST(rank AS INTEGER) AS k, {q6('avg(-(y - p) * (y - p))', 'score')} FROM w WHERE rank % 2 = 1 GROUP BY rank""",
)
def knn_choose_k_scores(spark, d):
    v = vectors(spark, d)
    near = nn.knn_join(v, v, 19, exclude="id")
    truth = v.select(F.col("id").alias("query_id"), F.col("label").alias("y"))
    return out(nn.knn_errors_by_k(near, truth, 19, list(range(1, 20, 2))), ["score"], ["k"])


@query("knn_choose_k")
def knn_choose_k(spark, d):
    """Five folds: neighbours come from the other folds; the best odd k by mean -MSE."""
    v = materialize(ft.kfold(vectors(spark, d), "id", 5), "folds")
    near = nn.knn_join(v, v, 19, exclude="fold")
    truth = v.select(F.col("id").alias("query_id"), F.col("label").alias("y"))
    return out(nn.best_k(nn.knn_errors_by_k(near, truth, 19, list(range(1, 20, 2)))), ["best_score"], ["best_k"])


# ---- forecasts with fitted models --------------------------------------------------------------------


def fitted_models(spark, d):
    data = ft.assemble(matrix(spark, d), FEATURES_38)
    return {"linear_regression": rg.fit_linear(data), "decision_tree": rg.fit_tree(data)}


ACCURACY = {"linear_regression": 0.05, "decision_tree": 0.1}


@query("batch_forecast")
def batch_forecast(spark, d):
    return fc.batch_forecast(nation_bars(spark, d), fitted_models(spark, d), ACCURACY, "2002-01-01")


@query("on_demand_forecast")
def on_demand_forecast(spark, d):
    """The one-week forecast of one nation's symbol, in both currencies."""
    return fc.on_demand_forecast(nation_bars(spark, d), 4, "1w", fitted_models(spark, d), ACCURACY, "2002-01-01")
