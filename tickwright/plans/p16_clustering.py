"""Queries for clustering and decomposition."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tickwright.functions.numeric import r6
from tickwright.operators import cluster as cl
from tickwright.operators import features as ft
from tickwright.session import materialize
from tickwright.sources import tables as t

from .p06_indicators import out
from .p11_joins import DIST, POINTS, customer_points, vectors
from .registry import query
from .registry import r6 as q6

DIMS = 64


def ml_vectors(spark, d):
    return materialize(vectors(spark, d).withColumn("features", array_to_vector("features")), "vectors")


@query("kmeans")
def kmeans(spark, d):
    v = ml_vectors(spark, d)
    return cl.kmeans(v, 10).transform(v).select("id", "cluster")


CENTRES = [[0.0, 10.0], [20.0, 40.0], [45.0, 5.0], [70.0, 30.0], [95.0, 20.0], [20.0, 40.0]]
CASES = ", ".join(f"row((x - {a}) * (x - {a}) + (y - {b}) * (y - {b}), {i})" for i, (a, b) in enumerate(CENTRES))
ASSIGN = f"{POINTS}, asg AS (SELECT id, least({CASES}) AS m FROM pts)"


@query("kmeans_assign", f"WITH {ASSIGN} SELECT id, CAST(m[2] AS INTEGER) AS cluster, {q6('m[1]', 'dist2')} FROM asg")
def kmeans_assign(spark, d):
    return out(cl.kmeans_assign(customer_points(spark, d), CENTRES), ["dist2"], ["id", "cluster"])


@query("wcss", f"WITH {ASSIGN} SELECT {q6('sum(m[1])', 'wcss')}, {q6('avg(m[1])', 'avg_cost')} FROM asg")
def wcss(spark, d):
    return out(cl.wcss(cl.kmeans_assign(customer_points(spark, d), CENTRES)), ["wcss", "avg_cost"], [])


SIL = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f, label FROM embeddings),
s AS (SELECT a.id, a.label, b.label AS other, avg(list_distance(a.f, b.f)) AS m FROM v a JOIN v b ON true GROUP BY 1, 2, 3),
g AS (SELECT id, max(m) FILTER (label = other) AS a, min(m) FILTER (label <> other) AS b FROM s GROUP BY id)"""


@query("silhouette", f"WITH {SIL} SELECT id, {q6('a', 'a')}, {q6('b', 'b')}, {q6('(b - a) / greatest(a, b)', 'silhouette')} FROM g")
def silhouette(spark, d):
    return out(cl.silhouette(vectors(spark, d), label="label"), ["a", "b", "silhouette"], ["id"])


@query("choose_k")
def choose_k(spark, d):
    """Two to ten clusters, fitted on four fifths of the vectors and judged by the fifth that is held out."""
    v = materialize(ft.shuffled_split(ml_vectors(spark, d), "id", 0.2), "split")
    scores = cl.choose_k(v.where("split = 'train'"), v.where("split = 'test'"))
    return out(scores, ["train_wcss", "wcss", "silhouette"], ["k", "best_by_wcss", "recommended"])


@query(
    "elbow",
    f"""WITH {POINTS}, c AS (SELECT k, id % k AS j, count(*) * (var_pop(x) + var_pop(y)) AS s FROM pts, (SELECT unnest(range(1, 13)) AS k) GROUP BY 1, 2),
w AS (SELECT k, sum(s) AS wcss FROM c GROUP BY k), dd AS (SELECT k, abs(lead(wcss, 2) OVER (ORDER BY k) - 2 * lead(wcss) OVER (ORDER BY k) + wcss) AS d FROM w)
SELECT CAST(arg_max(k, row(d, -k)) + 1 AS INTEGER) AS best_k FROM dd WHERE d IS NOT NULL""",
)
def elbow(spark, d):
    """Costs of splitting the customers by key modulo k, for k from 1 to 12."""
    p = customer_points(spark, d).select("id", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"))
    rows = p.select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("k"))
    cost = rows.groupBy("k", (F.col("id") % F.col("k")).alias("j")).agg(
        (F.count(F.lit(1)) * (F.var_pop("x") + F.var_pop("y"))).alias("s")
    )
    return cl.elbow(cost.groupBy("k").agg(F.sum("s").alias("wcss")))


EPS, MIN_PTS = 1.5, 4
PLANE = (POINTS, f"{DIST} <= {EPS}")
FAR_EPS = 1.15
SPACE = ("pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f FROM embeddings)", f"list_distance(a.f, b.f) <= {FAR_EPS}")


def near_sql(points, within):
    return f"{points}, nc AS (SELECT a.id, count(*) AS neighbors FROM pts a JOIN pts b ON {within} GROUP BY a.id)"


NEAR = near_sql(*PLANE)


@query("neighborhood_counts", f"WITH {NEAR} SELECT id, neighbors FROM nc")
def neighborhood_counts(spark, d):
    return cl.neighborhood_counts(customer_points(spark, d), EPS)


@query("core_points", f"WITH {NEAR} SELECT id FROM nc WHERE neighbors >= {MIN_PTS}")
def core_points(spark, d):
    return cl.core_points(cl.neighborhood_counts(customer_points(spark, d), EPS), MIN_PTS)


@query("neighborhood_counts_embeddings", f"WITH {near_sql(*SPACE)} SELECT id, neighbors FROM nc")
def neighborhood_counts_embeddings(spark, d):
    """Neighbour counts in 64 dimensions."""
    return cl.neighborhood_counts(vectors(spark, d), FAR_EPS)


def components_sql(min_pts, points=PLANE[0], within=PLANE[1]):
    return f"""WITH RECURSIVE {near_sql(points, within)}, core AS (SELECT pts.* FROM pts JOIN nc USING (id) WHERE neighbors >= {min_pts}),
ed AS (SELECT a.id AS s, b.id AS d FROM core a JOIN core b ON {within}),
rc AS (SELECT id AS s, id AS d FROM core UNION SELECT rc.s, ed.d FROM rc JOIN ed ON ed.s = rc.d),
comp AS (SELECT s AS id, min(d) AS root FROM rc GROUP BY s), num AS (SELECT root, row_number() OVER (ORDER BY root) AS cluster FROM (SELECT DISTINCT root FROM comp)),
cc AS (SELECT core.*, cluster FROM core JOIN comp USING (id) JOIN num USING (root)),
bd AS (SELECT a.id, min(cluster) AS cluster FROM pts a JOIN cc b ON {within} WHERE a.id NOT IN (SELECT id FROM core) GROUP BY a.id),
lab AS (SELECT id, cluster FROM cc UNION ALL SELECT id, cluster FROM bd UNION ALL SELECT id, 0 FROM pts WHERE id NOT IN (SELECT id FROM core) AND id NOT IN (SELECT id FROM bd))"""


@query("dbscan", f"{components_sql(MIN_PTS)} SELECT id, cluster FROM lab")
def dbscan(spark, d):
    return cl.dbscan(customer_points(spark, d), EPS, MIN_PTS)


@query("dbscan_embeddings", f"{components_sql(MIN_PTS, *SPACE)} SELECT id, cluster FROM lab")
def dbscan_embeddings(spark, d):
    """Density clusters in 64 dimensions."""
    return cl.dbscan(vectors(spark, d), FAR_EPS, MIN_PTS)


@query("noise_ratio", f"{components_sql(MIN_PTS)} SELECT {q6('avg(CASE WHEN cluster = 0 THEN 1.0 ELSE 0.0 END)', 'noise_ratio')} FROM lab")
def noise_ratio(spark, d):
    return out(cl.noise_ratio(cl.dbscan(customer_points(spark, d), EPS, MIN_PTS)), ["noise_ratio"], [])


@query("single_linkage", f"{components_sql(1)} SELECT id, cluster FROM lab")
def single_linkage(spark, d):
    return cl.single_linkage(customer_points(spark, d), EPS)


@query("single_linkage_k")
def single_linkage_k(spark, d):
    """Single linkage down to ten clusters; tests compare the operator with Kruskal's algorithm."""
    return cl.single_linkage_k(customer_points(spark, d), 10)


@query("gmm")
def gmm(spark, d):
    p = customer_points(spark, d).withColumn("features", array_to_vector("features"))
    p = materialize(p, "points")
    return cl.gmm(p, 3).transform(p).select("id", "cluster")


@query("gmm_parameters")
def gmm_parameters(spark, d):
    p = materialize(customer_points(spark, d).withColumn("features", array_to_vector("features")), "points")
    model = cl.gmm(p, 3)
    rows = [(i, float(w), [float(x) for x in g.mean], [float(x) for x in g.cov.toArray().ravel()]) for i, (w, g) in enumerate(zip(model.weights, model.gaussians))]
    return spark.createDataFrame(rows, "cluster int, weight double, mean array<double>, covariance array<double>")


@query("pca")
def pca(spark, d):
    projected, _ = cl.pca(vectors(spark, d), 3)
    return projected.select("id", *[r6(F.col("projection")[i]).alias(f"pc{i + 1}") for i in range(3)])


@query("explained_variance_ratio")
def explained_variance_ratio(spark, d):
    _, values = cl.pca(vectors(spark, d), 5)
    return out(cl.explained_variance_ratio(spark, values, 5), ["variance", "ratio", "cumulative"], ["component"])


@query(
    "covariance_matrix",
    f"""WITH u AS (SELECT vec_id AS id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, {q6('covar_samp(a.x, b.x)', 'value')} FROM u a JOIN u b USING (id) GROUP BY a.i, b.i""",
)
def covariance_matrix(spark, d):
    return out(cl.covariance_matrix(vectors(spark, d)), ["value"], ["i", "j"])


@query("svd")
def svd(spark, d):
    values, _ = cl.svd(vectors(spark, d), 8)
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(values[:8])], "component int, singular_value double")


@query("svd_reconstruct")
def svd_reconstruct(spark, d):
    v = vectors(spark, d)
    _, axes = cl.svd(v, 8)
    rows = cl.svd_reconstruct(v, axes)
    return rows.select("id", F.transform("reconstructed", lambda x: r6(x)).alias("reconstructed"))


@query("svd_relative_error")
def svd_relative_error(spark, d):
    v = vectors(spark, d)
    _, axes = cl.svd(v, 8)
    return out(cl.relative_error(cl.svd_reconstruct(v, axes)), ["relative_error"], [])
