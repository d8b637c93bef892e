"""Queries for the classification models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tickwright.functions.numeric import r6
from tickwright.operators import classify as cf
from tickwright.operators import features as ft
from tickwright.operators import neighbors as nn
from tickwright.session import materialize
from tickwright.sources import tables as t

from .p06_indicators import out
from .p11_joins import KNN, vectors
from .registry import query
from .registry import r6 as q6


def labelled_lines(spark, d):
    """Is a line returned? From quantity, price and discount."""
    line = t.table(spark, d, "lineitem")
    return line.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000.0).alias("p"), F.col("l_tax").alias("tax"),
        F.when(F.col("l_quantity") * (1.0 - F.col("l_discount")) + F.col("l_tax") * 100.0 > 25, 1.0).otherwise(0.0).alias("label"),
    )


@query("fit_logistic")
def fit_logistic(spark, d):
    data = ft.assemble(labelled_lines(spark, d), ["q", "p", "tax"])
    model = cf.fit_logistic(data)
    scored = model.transform(data)
    return scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


SIG = "1.0 / (1.0 + exp(-(0.1 + (q - 25.0) / 14.0 * 0.8 + (p - 50.0) / 30.0 * -0.3)))"


@query(
    "predict_logistic",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice / 1000.0 AS p FROM lineitem), z AS (SELECT *, {SIG} AS pr FROM s)
SELECT l_orderkey, l_linenumber, {q6('pr', 'probability')}, CAST(CASE WHEN pr >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS prediction FROM z""",
)
def predict_logistic(spark, d):
    scored = cf.predict_logistic(labelled_lines(spark, d), ["q", "p"], [25.0, 50.0], [14.0, 30.0], [0.8, -0.3], 0.1)
    return out(scored, ["probability"], ["l_orderkey", "l_linenumber", "prediction"])


@query(
    "gaussian_nb",
    f"""WITH u AS (SELECT vec_id AS id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
st AS (SELECT label AS c, i, avg(x) AS m, stddev_pop(x) AS s FROM u GROUP BY 1, 2), pr AS (SELECT label AS c, count(*) * 1.0 / (SELECT count(*) FROM embeddings) AS p FROM embeddings GROUP BY 1),
sc AS (SELECT u.id, st.c, any_value(ln(p)) + sum(-ln(s) - 0.5 * ln(2.0 * pi()) - power((x - m) / s, 2) / 2.0) AS score FROM u JOIN st USING (i) JOIN pr USING (c) GROUP BY 1, 2)
SELECT id, CAST(arg_max(c, row(score, -c)) AS INTEGER) AS prediction, {q6('max(score)', 'score')} FROM sc GROUP BY id""",
)
def gaussian_nb(spark, d):
    v = vectors(spark, d).withColumn("label", F.col("label").cast("int"))
    scored = cf.gaussian_nb_predict(v, cf.gaussian_nb_fit(v, 64))
    return out(scored, ["score"], ["id", "prediction"])


def labelled_documents(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", "text")
    return docs.join(t.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


def r3(e, name):
    return f"floor(({e}) * 1e3 + 0.5003) / 1e3 AS {name}"


@query(
    "multinomial_nb_text",
    f"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents), n AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2),
wc AS (SELECT quality AS c, word, sum(n) AS k FROM n JOIN labels USING (doc_id) GROUP BY 1, 2), tot AS (SELECT c, sum(k) AS t FROM wc GROUP BY c), vo AS (SELECT count(DISTINCT word) AS v FROM wc),
pr AS (SELECT quality AS c, count(*) * 1.0 / (SELECT count(*) FROM labels JOIN documents USING (doc_id)) AS p FROM labels JOIN documents USING (doc_id) GROUP BY 1), kn AS (SELECT DISTINCT word FROM wc),
ls AS (SELECT doc_id, tot.c, sum(n.n * ln((coalesce(wc.k, 0) + 1.0) / (t + v))) AS l FROM n JOIN kn USING (word) CROSS JOIN tot CROSS JOIN vo LEFT JOIN wc ON wc.c = tot.c AND wc.word = n.word GROUP BY 1, 2),
s AS (SELECT doc_id, pr.c, ln(p) + coalesce(l, 0.0) AS s FROM documents CROSS JOIN pr LEFT JOIN ls USING (doc_id, c))
SELECT doc_id, CAST(arg_max(c, row(s, -c)) AS INTEGER) AS prediction, {r3('max(CASE WHEN c = 0 THEN s END)', 'score_0')}, {r3('max(CASE WHEN c = 1 THEN s END)', 'score_1')} FROM s GROUP BY doc_id""",
)
def multinomial_nb_text(spark, d):
    """Document quality from whole texts: trained on the labelled, applied to all documents."""
    docs = t.table(spark, d, "documents")
    scored = cf.multinomial_nb(labelled_documents(spark, d), docs, [0, 1])
    rounded = {c: F.floor(F.col(c) * 1e3 + 0.5003) / 1e3 for c in ("score_0", "score_1")}
    return scored.withColumns(rounded).select("doc_id", "prediction", "score_0", "score_1")


VOTE = """vt AS (SELECT query_id, label, count(*) AS n, min(rank) AS r FROM nb WHERE rank <= 7 GROUP BY 1, 2)
SELECT query_id, arg_max(label, row(n, -r)) AS prediction FROM vt GROUP BY query_id"""


@query("knn_classify", f"WITH {KNN}, {VOTE}")
def knn_classify(spark, d):
    v = vectors(spark, d)
    return nn.knn_vote(nn.knn_join(v, v, 7, exclude="id"))


@query("knn_classify_manhattan", "WITH " + KNN.replace("list_distance(a.f, b.f)", "list_sum(list_transform(range(1, 65), lambda i: abs(a.f[i] - b.f[i])))") + ", " + VOTE)
def knn_classify_manhattan(spark, d):
    v = vectors(spark, d)
    return nn.knn_vote(nn.knn_join(v, v, 7, exclude="id", metric="manhattan"))


@query("knn_cv_choose_k")
def knn_cv_choose_k(spark, d):
    """Five-fold accuracy of k = 1, 3, 5, 7, 9."""
    v = materialize(ft.kfold(vectors(spark, d), "id", 5), "folds")
    near = materialize(nn.knn_join(v, v, 9, exclude="fold"), "near")
    truth = v.select(F.col("id").alias("query_id"), F.col("label").alias("y"), "fold")
    return out(nn.knn_accuracy_by_k(near, truth, [1, 3, 5, 7, 9]), ["score"], ["k"])


ENT = "(CASE WHEN {p} > 0 THEN -{p} * log2({p}) ELSE 0.0 END + CASE WHEN 1.0 - {p} > 0 THEN -(1.0 - {p}) * log2(1.0 - {p}) ELSE 0.0 END)"


def split_sql(feature, expr):
    return f"""{feature}0 AS (SELECT {expr} AS v, count(*) AS n, sum(y) AS k FROM src GROUP BY 1),
{feature}1 AS (SELECT v, lead(v) OVER (ORDER BY v) AS nv, sum(n) OVER (ORDER BY v) AS nl, sum(k) OVER (ORDER BY v) AS kl FROM {feature}0),
{feature}2 AS (SELECT (v + nv) / 2.0 AS th, nl, kl, tn - nl AS nr, tk - kl AS kr, tn, tk FROM {feature}1, tot WHERE nv IS NOT NULL),
{feature}3 AS (SELECT th, {ENT.format(p='(tk * 1.0 / tn)')} - (nl * {ENT.format(p='(kl * 1.0 / nl)')} + nr * {ENT.format(p='(kr * 1.0 / nr)')}) / tn AS gain FROM {feature}2 WHERE nl >= 5 AND nr >= 5),
{feature} AS (SELECT '{feature}' AS feature, arg_min(th, row(-round(gain, 9), th)) AS th, max(gain) AS gain FROM {feature}3)"""


@query(
    "best_split",
    f"""WITH src AS (SELECT l_quantity, l_extendedprice, CASE WHEN l_quantity * (1.0 - l_discount) + l_tax * 100.0 > 25 THEN 1 ELSE 0 END AS y FROM lineitem),
tot AS (SELECT count(*) AS tn, sum(y) AS tk FROM src), {split_sql('q', 'l_quantity')}, {split_sql('p', 'l_extendedprice / 1000.0')}
SELECT feature, {q6('th', 'threshold')}, {q6('gain', 'gain')} FROM q UNION ALL SELECT feature, {q6('th', 'threshold')}, {q6('gain', 'gain')} FROM p""",
)
def best_split(spark, d):
    rows = cf.best_split(labelled_lines(spark, d), ["q", "p"], "label", [0.0, 1.0], "entropy", 5)
    return out(rows, ["threshold", "gain"], ["feature"])


def vector_rows(spark, d):
    """Embeddings as ML vectors with a hash-ordered split: seven tenths to train, the rest to test."""
    v = ft.shuffled_split(vectors(spark, d), "id", 0.3)
    return materialize(v.withColumn("features", array_to_vector("features")), "vectors")


def parts(spark, d):
    v = vector_rows(spark, d)
    return v.where(F.col("split") == "train"), v.where(F.col("split") == "test")


@query("fit_tree_classifier")
def fit_tree_classifier(spark, d):
    train, valid = parts(spark, d)
    return cf.fit_tree_classifier(train, valid)[1]


@query("fit_forest_classifier")
def fit_forest_classifier(spark, d):
    train, valid = parts(spark, d)
    scored = cf.fit_forest_classifier(train).transform(valid)
    return scored.select("id", "label", "prediction")


@query("oob_error")
def oob_error(spark, d):
    return cf.oob_error(vector_rows(spark, d))


def binary(spark, d):
    """Even labels against odd ones."""
    train, valid = parts(spark, d)
    parity = {"label": (F.col("label") % 2).cast("double")}
    return train.withColumns(parity), valid.withColumns(parity)


@query("fit_linear_svm")
def fit_linear_svm(spark, d):
    return cf.fit_linear_svm(*binary(spark, d))[1]


@query("fit_mlp_classifier")
def fit_mlp_classifier(spark, d):
    train, valid = parts(spark, d)
    scored = cf.fit_mlp_classifier(train, [64, 16, 10]).transform(valid)
    return scored.select("id", "label", "prediction")


def neighbor_pairs(spark, d):
    """Each vector with the one after it and the one seven further on."""
    e = t.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id_a"), F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 7)).alias("id_b"))


PAIRS = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f FROM embeddings), p AS (SELECT a.id AS id_a, b.id AS id_b, a.f AS fa, b.f AS fb
 FROM v a JOIN v b ON b.id = a.id + 1 OR b.id = a.id + 7)"""


@query(
    "kernel_similarity",
    f"""WITH {PAIRS} SELECT id_a, id_b, {q6('exp(-power(list_distance(fa, fb), 2) / 2.0)', 'rbf')}, {q6('power(list_inner_product(fa, fb) + 1.0, 3)', 'polynomial')},
 {q6('list_inner_product(fa, fb)', 'linear')} FROM p""",
)
def kernel_similarity(spark, d):
    kinds = ("rbf", "polynomial", "linear")
    return out(nn.kernel_similarity(neighbor_pairs(spark, d), vectors(spark, d), kinds), kinds, ["id_a", "id_b"])


@query("pairwise_distance", f"WITH {PAIRS} SELECT id_a, id_b, {q6('list_distance(fa, fb)', 'distance')} FROM p")
def pairwise_distance(spark, d):
    return out(nn.pairwise_distance(neighbor_pairs(spark, d), vectors(spark, d)), ["distance"], ["id_a", "id_b"])
