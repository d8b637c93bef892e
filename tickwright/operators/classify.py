"""Classification models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.functions.position import with_running_totals
from tickwright.operators.forest import fit_forest


# ---- logistic regression ------------------------------------------------------------------------


def fit_logistic(df: DataFrame, features: str = "features", label: str = "label"):
    """Unregularised logistic regression on internally scaled columns, threshold 0.5."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(featuresCol=features, labelCol=label, regParam=0.0, maxIter=200, tol=1e-9).fit(df)


def predict_logistic(df: DataFrame, cols, mean, std, weights, intercept: float, threshold: float = 0.5) -> DataFrame:
    """Applies stored scaling and weights, then the sigmoid; a plain column expression."""
    z = F.lit(float(intercept))
    for c, m, s, w in zip(cols, mean, std, weights):
        z = z + (F.col(c) - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(w))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return df.withColumns({"probability": p, "prediction": F.when(p >= threshold, 1).otherwise(0)})


# ---- naive Bayes -----------------------------------------------------------------------------------


def gaussian_nb_fit(train: DataFrame, dims: int, vec: str = "features", label: str = "label") -> DataFrame:
    """Per class: prior and per-dimension mean and population deviation (one row per class)."""
    x = [F.col(vec)[i].cast("double") for i in range(dims)]
    total = train.agg(F.count(F.lit(1))).scalar()
    return train.groupBy(F.col(label).alias("label")).agg(
        (F.count(F.lit(1)) / total).alias("prior"),
        F.array(*[F.avg(c) for c in x]).alias("mean"),
        F.array(*[F.stddev_pop(c) for c in x]).alias("std"),
    )


def gaussian_nb_predict(test: DataFrame, model: DataFrame, vec: str = "features") -> DataFrame:
    """Class with the largest log posterior. The model is one array with a row per class."""
    classes = model.agg(F.array_sort(F.collect_list(F.struct("label", "prior", "mean", "std"))).alias("m")).scalar()
    v = F.col(vec).cast("array<double>")

    def log_density(p: Column) -> Column:
        x, m, s = p["x"], p["m"], p["s"]
        z = F.try_divide(x - m, s)
        normal = -F.log(F.greatest(s, F.lit(5e-324))) - F.lit(0.5 * math.log(2.0 * math.pi)) - z * z / 2.0
        return F.when(s > 0, normal).when(x == m, F.lit(0.0)).otherwise(F.lit(float("-inf")))

    def score(c: Column) -> Column:
        parts = F.zip_with(
            F.zip_with(v, c["mean"], lambda x, m: F.struct(x.alias("x"), m.alias("m"))),
            c["std"],
            lambda p, s: log_density({"x": p["x"], "m": p["m"], "s": s}),
        )
        total = F.aggregate(parts, F.log(c["prior"]), lambda a, b: a + b)
        return F.struct(total.alias("score"), (-c["label"]).alias("neg"))

    best = F.array_max(F.transform("_model", score))
    return (
        test.withColumn("_model", classes)
        .withColumn("_b", best)
        .withColumns({"prediction": -F.col("_b.neg"), "score": F.col("_b.score")})
        .drop("_model", "_b")
    )


def words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, n): whole texts, lower case, split at white space; counted on the map side."""
    tokens = F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("word")
    return df.select(key, tokens).where(F.col("word") != "").groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))


def multinomial_nb(
    train: DataFrame, test: DataFrame, classes: list, key: str = "doc_id", text: str = "text", label: str = "label"
) -> DataFrame:
    """Word-count naive Bayes with add-one smoothing; words never seen in training are skipped.

    Returns (key, prediction, score_<class>...). Documents of both sides are reduced to word
    counts before any shuffle on words.
    """
    # Keyed by (class, word) right away: a class or a word with most of the rows combines first.
    token = F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("word")
    seen = train.select(F.col(label).alias("label"), token).where(F.col("word") != "")
    per_word = seen.groupBy("word").agg(
        *[F.count_if(F.col("label") == c).alias(f"c{i}") for i, c in enumerate(classes)]
    )
    totals = per_word.agg(
        F.struct(F.count(F.lit(1)).alias("v"), *[F.sum(f"c{i}").alias(f"t{i}") for i in range(len(classes))]).alias("s")
    ).scalar()
    priors = train.agg(
        F.struct(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(label) == c).alias(f"p{i}") for i, c in enumerate(classes)]).alias("s")
    ).scalar()
    hits = words(test, key, text).join(per_word, "word").withColumn("_t", totals)
    logs = hits.groupBy(key).agg(
        *[
            F.sum(F.col("n") * F.log((F.col(f"c{i}") + 1.0) / (F.col(f"_t.t{i}") + F.col("_t.v")))).alias(f"l{i}")
            for i in range(len(classes))
        ]
    )
    scored = test.select(key).join(logs, key, "left").withColumn("_p", priors)
    score = {
        f"score_{c}": F.log(F.col(f"_p.p{i}") / F.col("_p.n")) + F.coalesce(f"l{i}", F.lit(0.0))
        for i, c in enumerate(classes)
    }
    out = scored.withColumns(score)
    best = F.array_max(F.array(*[F.struct(F.col(f"score_{c}").alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(classes)]))
    return out.select(key, *score, best["c"].alias("prediction"))


# ---- decision trees ------------------------------------------------------------------------------------


def impurity(counts: list[Column], total: Column, criterion: str) -> Column:
    out = F.lit(0.0) if criterion == "entropy" else F.lit(1.0)
    for c in counts:
        p = F.try_divide(c.cast("double"), total)
        if criterion == "entropy":
            out = out - F.when(p > 0, p * F.log2(F.when(p > 0, p).otherwise(F.lit(1.0)))).otherwise(F.lit(0.0))
        else:
            out = out - F.coalesce(p * p, F.lit(0.0))
    return out


def best_split(df: DataFrame, cols: list[str], label: str, classes: list, criterion: str = "entropy", min_leaf: int = 1) -> DataFrame:
    """Best threshold per feature: midpoints between distinct values, largest gain.

    Rows are reduced to class counts per distinct value; running counts come from bucketed
    prefix sums, so no feature is scanned in one task.
    """
    names = [f"k{i}" for i in range(len(classes))]
    total = df.agg(
        F.struct(F.count(label).alias("n"), *[F.count_if(F.col(label) == c).alias(k) for c, k in zip(classes, names)]).alias("s")
    ).scalar()
    out = None
    for c in cols:
        counts = (
            df.where(F.col(c).isNotNull())
            .groupBy(F.col(c).cast("double").alias("value"))
            .agg(*[F.count_if(F.col(label) == v).alias(f"_{k}") for v, k in zip(classes, names)])
        )
        run = with_running_totals(counts, F.col("value"), [], {k: F.col(f"_{k}") for k in names})
        run = run.withColumn("t", total)
        left = [F.col(k) for k in names]
        right = [F.col(f"t.{k}") - F.col(k) for k in names]
        nl = sum(left[1:], left[0])
        nr = F.col("t.n") - nl
        parent = impurity([F.col(f"t.{k}") for k in names], F.col("t.n"), criterion)
        gain = parent - (nl * impurity(left, nl, criterion) + nr * impurity(right, nr, criterion)) / F.col("t.n")
        split = (
            run.where(F.col("_next").isNotNull())
            .select(((F.col("value") + F.col("_next")) / 2.0).alias("threshold"), gain.alias("gain"), nl.alias("nl"), nr.alias("nr"))
            .where((F.col("nl") >= min_leaf) & (F.col("nr") >= min_leaf))
            .agg(F.max(F.struct(F.round("gain", 9).alias("g"), (-F.col("threshold")).alias("t"))).alias("b"))
            .select(F.lit(c).alias("feature"), (-F.col("b.t")).alias("threshold"), F.col("b.g").alias("gain"))
        )
        out = split if out is None else out.unionByName(split)
    return out


def accuracy(df: DataFrame, prediction: str = "prediction", label: str = "label") -> float:
    return df.agg(F.avg((F.col(prediction) == F.col(label)).cast("double"))).first()[0]


def fit_tree_classifier(train: DataFrame, valid: DataFrame, depths=(3, 5), leaves=(1, 5), criteria=("entropy", "gini"), seed: int = 42):
    """Grid over depth, leaf size and criterion by validation accuracy: (best model, table)."""
    from pyspark.ml.classification import DecisionTreeClassifier

    best, rows = None, []
    for depth in depths:
        for leaf in leaves:
            for criterion in criteria:
                model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=leaf, impurity=criterion, seed=seed).fit(train)
                score = float(accuracy(model.transform(valid)))
                rows.append((depth, leaf, criterion, score))
                if best is None or score > best[0]:
                    best = (score, model)
    table = train.sparkSession.createDataFrame(rows, "depth int, min_leaf int, criterion string, accuracy double")
    return best[1], table


def fit_forest_classifier(train: DataFrame, trees: int = 100, depth: int = 10, take: int | None = 3, seed: int = 42, **more):
    """A forest over labels 0, 1, ...; see ``forest.fit_forest``."""
    classes = more.pop("classes", None) or int(train.agg(F.max("label")).first()[0] or 0) + 1
    return fit_forest(train, trees, depth, take=take, classes=classes, seed=seed, **more)


def oob_error(df: DataFrame, trees: int = 100, depth: int = 10, take: int | None = 3, seed: int = 42, **more) -> DataFrame:
    """Share of rows that the trees whose bags lack them vote wrongly, and the rows with a vote."""
    voted = fit_forest_classifier(df, trees, depth, take, seed, **more).transform(df, out_of_bag=True).where("votes > 0")
    wrong = F.avg((F.col("prediction") != F.col("label")).cast("double"))
    return voted.agg(wrong.alias("oob_error"), F.count(F.lit(1)).alias("voted_rows"))


# ---- linear SVM and MLP -----------------------------------------------------------------------------------


def fit_linear_svm(train: DataFrame, valid: DataFrame, cs=(0.01, 0.1, 1.0, 10.0)):
    """Hinge loss with L2; C chosen by validation accuracy: (best model, table)."""
    from pyspark.ml.classification import LinearSVC

    n = train.count()
    best, rows = None, []
    for c in cs:
        model = LinearSVC(regParam=1.0 / (c * n), maxIter=100).fit(train)
        score = float(accuracy(model.transform(valid)))
        rows.append((float(c), score))
        if best is None or score > best[0]:
            best = (score, model)
    return best[1], train.sparkSession.createDataFrame(rows, "c double, accuracy double")


def fit_mlp_classifier(train: DataFrame, layers: list[int], max_iter: int = 100, seed: int = 42):
    """Feed-forward network with sigmoid hidden layers."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(layers=layers, maxIter=max_iter, seed=seed, blockSize=128).fit(train)
