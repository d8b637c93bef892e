"""Regression models on the stacked matrix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.functions.numeric import null_if_not_finite
from tickwright.functions.position import exact_medians
from tickwright.operators import forest
from tickwright.operators.features import assemble
from tickwright.schema import INTERVAL_Z


# ---- Gram aggregates: everything least squares needs, in one pass -----------------------------


@dataclass
class Gram:
    """Counts, sums and products of [1, x - shift, y - shift]; the size depends on the columns only.

    The shift is near the column means, so means far from zero cost no digits.
    """

    cols: list[str]
    m: object  # (d + 2) x (d + 2) array
    shift: object  # d + 1 values

    @property
    def n(self) -> float:
        return float(self.m[0, 0])

    def __add__(self, other: "Gram") -> "Gram":
        """Both sides around this one's shift."""
        import numpy as np

        move = np.eye(len(self.m))
        move[1:, 0] = other.shift - self.shift
        return Gram(self.cols, self.m + move @ other.m @ move.T, self.shift)

    def comoments(self):
        """Sums of products of deviations from the means."""
        import numpy as np

        return self.m[1:, 1:] - np.outer(self.m[0, 1:], self.m[0, 1:]) / self.n

    def moments(self):
        """Means and population deviations of x, and of y."""
        import numpy as np

        var = np.maximum(np.diag(self.comoments()) / self.n, 0.0)
        return self.shift + self.m[0, 1:] / self.n, np.sqrt(var)

    def ols(self, ridge: float = 0.0):
        """Intercept and coefficients."""
        import numpy as np

        mean, _ = self.moments()
        cov = self.comoments()
        xx, xy = cov[:-1, :-1], cov[:-1, -1]
        beta = np.linalg.lstsq(xx + ridge * np.eye(len(xy)), xy, rcond=None)[0]
        return float(mean[-1] - mean[:-1] @ beta), beta

    def gradient_descent(self, lr: float = 0.01, epochs: int = 1000):
        """Batch gradient descent on z-scored columns, from the aggregates alone."""
        import numpy as np

        mean, std = self.moments()
        std = np.where(std == 0, 1.0, std)
        cov = self.comoments()
        zz, zy = cov[:-1, :-1] / np.outer(std[:-1], std[:-1]), cov[:-1, -1] / std[:-1]
        theta, bias = np.zeros(len(zy)), 0.0
        for _ in range(epochs):
            theta = theta - lr * (zz @ theta - zy) / self.n
            bias = bias - lr * (bias - mean[-1])
        return bias, theta, mean[:-1], std[:-1]


def gram(df: DataFrame, cols: list[str], label: str = "label", centre: bool = True) -> Gram:
    """The column means, then one pass of per-partition numpy products around them, summed
    position by position. Without ``centre`` the products are raw."""
    import numpy as np

    size = len(cols) + 2
    both = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate([*cols, label])])
    shift = np.zeros(size - 1)
    if centre:
        means = both.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))) for c in both.columns]).first()
        shift = np.array([0.0 if v is None or not np.isfinite(v) else v for v in means])

    def partial(batches):
        import pyarrow as pa

        acc = np.zeros((size, size))
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows)] + [c.to_numpy(zero_copy_only=False) for c in b.columns])
            x[:, 1:] -= shift
            acc += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size * size, dtype="int32")), pa.array(acc.ravel())], names=["pos", "v"]
        )

    rows = both.mapInArrow(partial, "pos int, v double")
    m = np.zeros(size * size)
    for r in rows.groupBy("pos").agg(F.sum("v").alias("v")).collect():  # (d + 2)² rows
        m[r["pos"]] = r["v"]
    return Gram(list(cols), m.reshape(size, size), shift)


def linear_expr(cols, intercept: float, beta) -> Column:
    """The fitted line as a column expression (stays in generated code)."""
    out = F.lit(float(intercept))
    for c, b in zip(cols, beta):
        out = out + F.col(c) * F.lit(float(b))
    return out


def coefficient_rows(spark, cols, intercept, beta) -> DataFrame:
    rows = [("intercept", float(intercept))] + [(c, float(b)) for c, b in zip(cols, beta)]
    return spark.createDataFrame(rows, "feature string, coefficient double")


def fit_linear(df: DataFrame, features: str = "features", label: str = "label"):
    """Ordinary least squares (scaling does not change its predictions)."""
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(featuresCol=features, labelCol=label, solver="normal", regParam=0.0).fit(df)


def linear_metrics(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """mse, rmse and R² of predictions, as one row."""
    e = F.col(label) - F.col(prediction)
    return df.agg(
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.count(label) * F.var_pop(label))).alias("r2"),
    )


def predict_interval(df: DataFrame, prediction: Column, rmse: float | Column) -> DataFrame:
    r = rmse if isinstance(rmse, Column) else F.lit(float(rmse))
    return df.withColumns(
        {"prediction": prediction, "low": prediction - r * INTERVAL_Z, "high": prediction + r * INTERVAL_Z}
    )


def fit_linear_incremental(batches, cols: list[str], label: str = "label") -> Gram:
    """Adds the aggregates batch by batch (also from ``foreachBatch``); the fit is exact."""
    total = None
    for b in batches:
        g = gram(b, cols, label)
        total = g if total is None else total + g
    return total


# ---- trees ------------------------------------------------------------------------------------------


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Infinities and NaN to NULL, then the exact column median; 0 for an all-NULL column."""
    clean = df.withColumns({c: null_if_not_finite(c) for c in cols})
    medians = {r["_c"]: r["_m"] for r in exact_medians(clean, cols).collect()}
    return clean.withColumns({c: F.coalesce(c, F.lit(medians.get(i, 0.0))) for i, c in enumerate(cols)})


def fit_tree(df: DataFrame, depth: int = 10, min_leaf: int = 5, subset: str = "sqrt", seed: int = 42):
    """A single regression tree with a feature subset per split."""
    from pyspark.ml.regression import RandomForestRegressor

    return RandomForestRegressor(
        numTrees=1, bootstrap=False, featureSubsetStrategy=subset, maxDepth=depth,
        minInstancesPerNode=min_leaf, subsamplingRate=1.0, seed=seed,
    ).fit(df)


def fit_forest(df: DataFrame, trees: int = 100, depth: int = 15, min_leaf: int = 5, seed: int = 42, key=("symbol", "date"), **more):
    """Bagged regression trees with a square-root feature subset per split; see ``forest.fit_forest``."""
    return forest.fit_forest(df, trees, depth, min_leaf, seed=seed, key=key, **more)


def tree_summary(spark, model) -> DataFrame:
    """Depth, leaves and features of each tree of a model."""
    trees = getattr(model, "trees", None) or [model]
    rows = [(i, int(x.depth), int(x.numNodes), int((x.numNodes + 1) // 2), int(x.numFeatures)) for i, x in enumerate(trees)]
    return spark.createDataFrame(rows, "tree int, depth int, nodes int, leaves int, features int")


def forest_uncertainty(model, df: DataFrame) -> DataFrame:
    """Mean and population deviation over the trees' predictions, all trees in one pass."""
    return model.transform(df).drop("votes")


def feature_importance(spark, model, names) -> DataFrame:
    values = model.importances
    return spark.createDataFrame([(c, float(v)) for c, v in zip(names, values)], "feature string, importance double")


# ---- support vector regression ------------------------------------------------------------------------


def _moments(df: DataFrame, cols):
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return [row[f"m{i}"] for i in range(len(cols))], [row[f"s{i}"] or 1.0 for i in range(len(cols))]


@dataclass
class SvrModel:
    """Weights over scaled columns, or over the kernel's values at ``landmarks`` (scaled) if there are any.

    ``gap`` is the duality gap as a share of the objective, ``passes`` the passes over the rows.
    """

    cols: list[str]
    mean: object
    std: object
    w: object
    b: float
    landmarks: object = None
    gamma: float = 0.0
    gap: float = 1.0
    passes: int = 0

    def inputs(self, x):
        """The columns that the weights belong to."""
        import numpy as np

        z = (x - self.mean) / self.std
        if self.landmarks is None:
            return z
        return np.exp(-self.gamma * squared_distances(z, self.landmarks))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Linear models stay a column expression; the kernel form scores Arrow batches."""
        if self.landmarks is None:
            scaled = [c / s for c, s in zip(self.w, self.std)]
            shift = self.b - sum(c * m for c, m in zip(scaled, self.mean))
            return df.withColumn(out, linear_expr(self.cols, shift, scaled))
        model = self

        @F.pandas_udf("double")
        def score(row):
            import pandas as pd

            return pd.Series(model.inputs(row.to_numpy(float)) @ model.w + model.b)

        return df.withColumn(out, score(F.struct(*[F.col(c).cast("double") for c in self.cols])))


def squared_distances(a, b):
    import numpy as np

    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T), 0.0)


def choose_landmarks(z, gamma: float, most: int, rest: float = 1e-7):
    """(rows, triangular factor) of a pivoted Cholesky factor of the kernel matrix of ``z``.

    The next landmark is always the row that the earlier ones explain worst; it ends when none is
    left above ``rest``, and the factor then is the whole kernel.
    """
    import numpy as np

    left, factor, rows = np.ones(len(z)), np.zeros((len(z), min(most, len(z)))), []
    for j in range(factor.shape[1]):
        i = int(left.argmax())
        if left[i] < rest:
            break
        kernel = np.exp(-gamma * squared_distances(z, z[i : i + 1])[:, 0])
        factor[:, j] = (kernel - factor[:, :j] @ factor[i, :j]) / np.sqrt(left[i])
        left = np.maximum(left - factor[:, j] ** 2, 0.0)
        rows.append(i)
    return rows, factor[rows, : len(rows)]


def svr_sums(rows: DataFrame, model: SvrModel, back, state, epsilon: float, width: float):
    """One pass: (Hessian, gradient, [loss, smooth loss, sum of g y, sum of |g|]) over all rows.

    The two hinges beyond ``epsilon`` are soft ones, width log(1 + exp(over / width)); g is the
    derivative. Tasks send one row for each row of the Hessian, which are added where they meet.
    """
    import numpy as np

    sent = rows.sparkSession.sparkContext.broadcast((model, back, state))
    size = len(state)

    def partial(batches):
        import pyarrow as pa

        m, to_features, now = sent.value
        hessian, gradient, sums = np.zeros((size, size)), np.zeros(size), np.zeros(4)
        for batch in batches:
            data = np.column_stack([col.to_numpy(zero_copy_only=False) for col in batch.columns])
            phi = m.inputs(data[:, :-1])
            phi = np.column_stack([phi if to_features is None else phi @ to_features, np.ones(len(data))])
            e = phi @ now - data[:, -1]
            above, below = (e - epsilon) / width, (-e - epsilon) / width
            up, down = (1.0 / (1.0 + np.exp(-np.clip(u, -500.0, 500.0))) for u in (above, below))
            g = up - down
            hessian += phi.T @ (phi * ((up * (1.0 - up) + down * (1.0 - down)) / width)[:, None])
            gradient += g @ phi
            soft = width * (np.logaddexp(0.0, above) + np.logaddexp(0.0, below))
            sums += [np.maximum(np.abs(e) - epsilon, 0.0).sum(), soft.sum(), g @ data[:, -1], np.abs(g).sum()]
        values = [*hessian, gradient, sums]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([v.tolist() for v in values])], ["i", "v"])

    def add(batches):
        import pyarrow as pa

        total: dict = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[i] = total.get(i, 0.0) + np.array(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["i", "v"])

    schema = "i int, v array<double>"
    found = {r["i"]: np.array(r["v"]) for r in rows.mapInArrow(partial, schema).repartition("i").mapInArrow(add, schema).collect()}
    sent.unpersist()
    return np.stack([found[i] for i in range(size)]), found[size], found[size + 1]


def fit_svr(
    df: DataFrame, cols: list[str], label: str = "label", c: float = 1.0, epsilon: float = 0.1, kernel: str = "rbf",
    components: int = 256, gamma: float | None = None, tol: float = 0.01, max_passes: int = 100, sample_rows: int = 4096,
) -> SvrModel:
    """Epsilon-insensitive regression by Newton steps on a loss that is smoothed less and less.

    It ends when the duality gap is below ``tol`` of the objective. Each step is one pass whose
    sums have the model's size; a step that does not lower the objective is halved. The ``rbf``
    kernel is spanned by at most ``components`` landmarks, chosen among ``sample_rows`` rows by a
    pivoted Cholesky factor (all rows, and so the exact kernel, if there are few); every row is a
    training row. ``gamma`` is one over the number of columns unless given. Without rows the model
    is constant 0. The input is read once per pass, so pass a stored frame.
    """
    import numpy as np

    mean, std = _moments(df, cols)
    rows = df.select(*[F.col(x).cast("double") for x in [*cols, label]])
    spread = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(F.col(label)).alias("s")).first()
    if not spread["n"]:
        return SvrModel(list(cols), np.zeros(len(cols)), np.ones(len(cols)), np.zeros(len(cols)), 0.0, gap=0.0)
    model = SvrModel(list(cols), np.array(mean), np.array(std), None, 0.0)
    back, size = None, len(cols)
    if kernel == "rbf":
        order = F.xxhash64(*rows.columns)
        picked = rows.orderBy(order, *rows.columns).limit(sample_rows).toPandas()[list(cols)].to_numpy(float)  # a bounded sample
        model.gamma = gamma or 1.0 / len(cols)
        z = (picked - model.mean) / model.std
        chosen, factor = choose_landmarks(z, model.gamma, components)
        model.landmarks, back, size = z[chosen], np.linalg.inv(factor).T, len(chosen)
    state = np.zeros(size + 1)
    state[-1] = float(next((r["_m"] for r in exact_medians(df, [label]).collect()), 0.0))
    width = max(0.5 * (spread["s"] or 0.0), 1e-9)
    keep = np.append(np.ones(size), 0.0)  # the intercept is free

    def measured(at):
        model.passes += 1
        hessian, gradient, (loss, smooth, gy, g1) = svr_sums(rows, model, back, at, epsilon, width)
        half = 0.5 * float(at[:-1] @ at[:-1])
        dual = -0.5 * c * c * float(gradient[:-1] @ gradient[:-1]) - c * (gy - at[-1] * gradient[-1]) - c * epsilon * g1
        primal = half + c * loss
        return half + c * smooth, keep * at + c * gradient, np.diag(keep) + c * hessian, (primal - dual) / max(abs(primal), 1e-12)

    value, slope, curve, gap = measured(state)
    while gap > tol and model.passes < max_passes:
        step = -np.linalg.lstsq(curve + 1e-10 * np.eye(len(state)), slope, rcond=None)[0]
        fall = -float(slope @ step)
        if fall <= 1e-3 * tol * max(value, 1e-12):  # as good as this smoothing allows
            width /= 3.0
            value, slope, curve, gap = measured(state)
            continue
        share = 1.0
        while model.passes < max_passes:
            found = measured(state + share * step)
            if found[0] <= value - 1e-4 * share * fall:
                break
            share /= 2.0
        state = state + share * step
        value, slope, curve, gap = found
    model.w, model.b, model.gap = state[:-1] if back is None else back @ state[:-1], float(state[-1]), float(gap)
    return model


# ---- tuning, training runs, registry ----------------------------------------------------------------------


def tune(estimator, grid, df: DataFrame, folds: int = 5, label: str = "label", parallelism: int = 4, seed: int = 42):
    """Grid search by mean squared error; returns (fitted CrossValidatorModel, score table)."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator

    cv = CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label, metricName="mse"),
        numFolds=folds, parallelism=parallelism, seed=seed,
    )
    fitted = cv.fit(df)
    rows = [
        (i, ", ".join(sorted(f"{p.name}={v}" for p, v in params.items())), -float(score))
        for i, (params, score) in enumerate(zip(grid, fitted.avgMetrics))
    ]
    table = df.sparkSession.createDataFrame(rows, "candidate int, params string, score double")
    return fitted, table


def train_run(matrix: DataFrame, features: list[str], name: str, fit, path: str, registry: str, held_out: list[str] | None = None) -> DataFrame:
    """Fit on the stacked matrix, save, validate, register the run.

    Without ``held_out`` each symbol's last rows validate; with it, all rows of the listed symbols
    do, and no row of theirs trains. Models without a writer of their own are not saved, their
    path only names the run. Returns the summary row that was appended to the registry table.
    """
    from tickwright.operators.features import chronological_split
    from tickwright.operators.metrics import validation_summary

    data = assemble(matrix, features)
    listed = F.col("symbol").cast("string").isin([str(x) for x in held_out or []])
    train = data.where(~listed) if held_out else chronological_split(data).where(F.col("split") == "train")
    model = fit(train)
    if hasattr(model, "write"):
        model.write().overwrite().save(path)
    scored = (model.transform if hasattr(model, "transform") else model.predict)(data.where(listed) if held_out else data)
    scored = scored.select("symbol", "date", F.col("label").alias("y"), F.col("prediction").alias("p"))
    row = validation_summary(scored, *[1.0] if held_out else []).select(
        F.lit(name).alias("model"),
        "symbols", "avg_r2", "avg_rmse", "avg_mae",
        F.lit(len(features)).alias("features"),
        F.lit(path).alias("path"),
        F.current_timestamp().alias("trained_at"),
    )
    row.write.mode("append").parquet(registry)
    return matrix.sparkSession.read.parquet(registry).where(F.col("path") == path)


def model_registry(spark, registry: str, name: str | None = None) -> DataFrame:
    """Saved models with their metrics."""
    rows = spark.read.parquet(registry)
    return rows if name is None else rows.where(F.col("model") == name)


# ---- latent regression ---------------------------------------------------------------------------------------


@dataclass
class LatentModel:
    """Linear encoder: scaled columns times ``components`` (d x k); decoder is the transpose."""

    cols: list[str]
    mean: object
    std: object
    components: object
    intercept: float = 0.0
    beta: object = None

    def _z(self) -> Column:
        return F.array(*[(F.col(c) - float(m)) / float(s) for c, m, s in zip(self.cols, self.mean, self.std)])

    def encode(self, df: DataFrame, out: str = "latent") -> DataFrame:
        """One linear expression of the columns for each axis."""
        axes = [axis / self.std for axis in self.components.T]
        return df.withColumn(out, F.array(*[linear_expr(self.cols, -float(self.mean @ w), w) for w in axes]))

    def reconstruct(self, df: DataFrame, latent: str = "latent", out: str = "reconstructed") -> DataFrame:
        """Scaled columns rebuilt from the code."""
        back = [F.array(*[F.lit(float(v)) for v in row]) for row in self.components]
        vals = [F.aggregate(F.zip_with(F.col(latent), b, lambda x, y: x * y), F.lit(0.0), lambda a, v: a + v) for b in back]
        return df.withColumn(out, F.array(*vals))

    def reconstruction_error(self, df: DataFrame, out: str = "error") -> DataFrame:
        """Mean squared difference between scaled columns and their reconstruction."""
        full = self.reconstruct(self.encode(df))
        sq = F.zip_with(self._z(), F.col("reconstructed"), lambda x, y: (x - y) * (x - y))
        return full.withColumn(out, F.aggregate(sq, F.lit(0.0), lambda a, v: a + v) / float(len(self.cols)))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Axes and weights fold into one linear expression of the columns."""
        weights = (self.components @ self.beta) / self.std
        return df.withColumn(out, linear_expr(self.cols, self.intercept - float(self.mean @ weights), weights))


def fit_latent_regression(df: DataFrame, cols: list[str], label: str = "label", k: int = 24) -> LatentModel:
    """The best linear autoencoder spans the leading principal axes; a line maps codes to labels.

    Both come from one Gram pass: its size is the number of columns squared.
    """
    import numpy as np

    g = gram(df, cols, label)
    mean, std = g.moments()
    std = np.where(std == 0, 1.0, std)
    cov = g.comoments() / np.outer(std, std)
    values, vectors = np.linalg.eigh(cov[:-1, :-1])
    order = np.argsort(values)[::-1][:k]
    axes = vectors[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    beta = np.linalg.lstsq(axes.T @ cov[:-1, :-1] @ axes, axes.T @ cov[:-1, -1], rcond=None)[0] * std[-1]
    return LatentModel(list(cols), mean[:-1], std[:-1], axes, float(mean[-1]), beta)
