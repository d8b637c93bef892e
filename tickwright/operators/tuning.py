"""Grid searches by cross-validation that share what the candidates have in common.

Linear candidates come from one Gram matrix a fold: the other folds' sum gives the fit, the fold's own
matrix its error, and no candidate reads the rows again. Neighbour candidates read one neighbour list
a metric. Forest candidates of every depth and size are the tops and first trees of one forest that
is grown for all folds at once. Only support vector candidates are fits of their own. Every search
returns one row a candidate, (model, params, score), score being the negative mean squared error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwright.operators import forest, neighbors, regression

SCORES = "model string, params string, score double"


def tune_linear(df: DataFrame, cols: list[str], ridges=(0.0, 0.1, 1.0, 10.0), label: str = "label", fold: str = "fold", folds: int = 5) -> DataFrame:
    """Ridge penalties of least squares, from one Gram matrix a fold."""
    own = [regression.gram(df.where(F.col(fold) == k), cols, label) for k in range(folds)]
    own = [g for g in own if g.n]
    rows = []
    for ridge in ridges:
        squares = total = 0.0
        for k, mine in enumerate(own):
            rest = None
            for j, other in enumerate(own):
                if j != k:
                    rest = other if rest is None else rest + other
            if rest is None:
                continue
            intercept, beta = rest.ols(ridge)
            shifted = intercept + float(np.dot(beta, mine.shift[:-1])) - mine.shift[-1]
            v = np.concatenate([[-shifted], -np.asarray(beta), [1.0]])
            squares, total = squares + float(v @ mine.m @ v), total + mine.n
        rows.append(("linear", f"ridge={ridge:g}", -squares / total if total else None))
    return df.sparkSession.createDataFrame(rows, SCORES)


def tune_knn(df: DataFrame, ks=tuple(range(3, 21, 2)), metrics=("euclidean", "manhattan"), key: str = "id", vec: str = "features", label: str = "label", fold: str = "fold", **limits) -> DataFrame:
    """Numbers of neighbours, plain and inverse-distance means, and metrics; one list a metric."""
    truth = df.select(F.col(key).alias("query_id"), F.col(label).cast("double").alias("y"))
    run = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    out = None
    for metric in metrics:
        near = neighbors.knn_join(df, df, max(ks), vec, label, key, exclude=fold, metric=metric, **limits)
        exact, inverse = F.col("distance") == 0, F.lit(1.0) / F.nullif(F.col("distance"), F.lit(0.0))
        # exact matches, if any, count alone
        zeros, zero_sum = F.sum(exact.cast("int")).over(run), F.sum(F.when(exact, F.col("label"))).over(run)
        means = {
            "uniform": F.avg("label").over(run),
            "distance": F.when(zeros > 0, zero_sum / zeros).otherwise(F.sum(F.col("label") * inverse).over(run) / F.sum(inverse).over(run)),
        }
        # a list shorter than k stands for every larger k
        last = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
        found = near.withColumns(means).withColumn("_n", last).join(truth, "query_id")
        tried = found.select("y", *means, F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: (k == F.col("rank")) | ((F.col("rank") == F.col("_n")) & (k > F.col("_n"))))).alias("k"))
        for name in means:
            params = F.concat(F.lit(f"metric={metric}, weights={name}, k="), F.col("k").cast("string"))
            one = tried.groupBy("k").agg(F.avg((F.col(name) - F.col("y")) * (F.col(name) - F.col("y"))).alias("mse"))
            one = one.select(F.lit("knn").alias("model"), params.alias("params"), (-F.col("mse")).alias("score"))
            out = one if out is None else out.unionByName(one)
    return out


def tune_forest(df: DataFrame, depths=(5, 10, 15), counts=(50, 100), leaves=(1, 5), takes=(None,), features: str = "features", label: str = "label", key="id", fold: str = "fold", folds: int = 5, **more) -> DataFrame:
    """Depths, tree numbers, leaf sizes and features a split; one growth for each pair of the last two."""
    out = None
    for leaf in leaves:
        for take in takes:
            model = forest.fit_forest(df, max(counts) * folds, max(depths), leaf, take, features=features, label=label, key=key, fold=fold, folds=folds, **more)
            scored = forest.out_of_fold(model, df, fold, sorted(depths), sorted(counts), label)
            params = F.concat(F.lit("depth="), F.col("depth").cast("string"), F.lit(", trees="), F.col("trees").cast("string"), F.lit(f", min_leaf={leaf}, take={model.cfg['take']}"))
            one = scored.select(F.lit("forest").alias("model"), params.alias("params"), (-F.col("mse")).alias("score"))
            out = one if out is None else out.unionByName(one)
    return out


def tune_svr(df: DataFrame, cols: list[str], cs=(0.1, 1.0, 10.0), epsilons=(0.1,), kernels=("rbf", "linear"), label: str = "label", fold: str = "fold", folds: int = 5, **more) -> DataFrame:
    """Costs, tube widths and kernels of support vector regression; a fit for each fold."""
    rows = []
    for kernel in kernels:
        for c in cs:
            for epsilon in epsilons:
                squares = total = 0.0
                for k in range(folds):
                    model = regression.fit_svr(df.where(F.col(fold) != k), cols, label, c, epsilon, kernel, **more)
                    held = model.predict(df.where(F.col(fold) == k), "_p")
                    error = F.col("_p") - F.col(label)
                    r = held.agg(F.sum(error * error).alias("s"), F.count(F.lit(1)).alias("n")).first()
                    squares, total = squares + (r["s"] or 0.0), total + r["n"]
                rows.append(("svr", f"kernel={kernel}, c={c:g}, epsilon={epsilon:g}", -squares / total if total else None))
    return df.sparkSession.createDataFrame(rows, SCORES)


def best_candidate(scores: DataFrame) -> DataFrame:
    """The best row of each model; of equal scores the first by name."""
    best = F.min(F.struct((-F.col("score")).alias("loss"), "params")).alias("b")
    return scores.where("score IS NOT NULL").groupBy("model").agg(best).select("model", "b.params", (-F.col("b.loss")).alias("score"))
