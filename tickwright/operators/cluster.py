"""Clustering and decomposition.

Density clustering and single linkage work on bounded units of a k-d tree in few dimensions (see
``units``) and on balls around pivots in many (see ``metric``): a unit, ball or ring that lies whole
within the distance counts by its weight and is one node of the graph, so crowded places cost no pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.functions.position import with_global_rank
from tickwright.operators import metric, units
from tickwright.operators.neighbors import BROADCAST_BYTES, BROADCAST_PAIRS, FEW_DIMS, GRID_QUERIES, TASK_PAIRS, grid, listed_distances
from tickwright.session import materialize

LOCAL_EDGES = 1 << 17
SUM_TILE = 1024
TREE_BYTES = 32 * 1024 * 1024
LINK_BYTES = 40
STAR_LINKS = 1 << 20
CENTRE_STEP = 1e-6


# ---- density ---------------------------------------------------------------------------------------


def eps_join(points: DataFrame, eps: float, key: str = "id", vec: str = "features") -> DataFrame:
    """Pairs of distinct positions within ``eps``, with the rows each position stands for.

    Copies of a position are folded into one row with a count first, so a group of copies
    costs one row and no pairs. ``neighborhood_counts`` answers without listing pairs.
    """
    at = metric.Layout(points, key, vec)
    return metric.eps_pairs(at.places, at.rings, at.members, eps)


def laid_out(points: DataFrame, key: str, vec: str) -> metric.Layout | units.Layout:
    """Units of a k-d tree for few dimensions, balls and rings for many."""
    rows, places = metric.folded(points, key, vec)
    if (places.agg(F.max(F.size("vec"))).first()[0] or 1) < FEW_DIMS:
        return units.Layout(rows, places)
    return metric.Layout(points, key, vec, (rows, places))


def neighborhood_counts(points: DataFrame, eps: float, key: str = "id", vec: str = "features") -> DataFrame:
    """Rows within ``eps`` of every row, itself included."""
    at = laid_out(points, key, vec)
    counts = at.counts_within(eps)
    return at.rows.join(counts, "pos").select("id", F.col("c").alias("neighbors"))


def core_points(counts: DataFrame, min_pts: int) -> DataFrame:
    return counts.where(F.col("neighbors") >= min_pts).select("id")


def connected_components(nodes: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, label) with the smallest node of each component, by min labels and pointer jumps.

    Up to ``LOCAL_EDGES`` edges (counted) are joined in one task. Beyond it, every round is written
    to the shared folder, which cuts the lineage and survives lost executors; rounds stop when no
    label changes.
    """
    edges = materialize(edges.select("src", "dst"), "edges")
    if edges.count() <= local_edges:
        kind = nodes.schema["node"].dataType.simpleString()

        def join(frames):
            parts = list(frames)  # at most ``local_edges`` rows
            pairs = pd.concat(parts) if parts else pd.DataFrame({"src": [], "dst": []})
            ids, place = np.unique(np.concatenate([pairs["src"].to_numpy(), pairs["dst"].to_numpy()]), return_inverse=True)
            label = metric.components(place[: len(pairs)], place[len(pairs) :], len(ids))
            yield pd.DataFrame({"node": ids, "label": ids[label]})

        found = edges.coalesce(1).mapInPandas(join, f"node {kind}, label {kind}")
        return materialize(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    both = materialize(
        edges.select("src", "dst").union(edges.select("dst", "src")).toDF("src", "dst").distinct(), "edges"
    )
    labels = materialize(nodes.select(F.col("node"), F.col("node").alias("label")), "labels")
    while True:
        near = (
            both.join(labels, both.src == labels.node)
            .groupBy(F.col("dst").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        hooked = labels.join(near, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        parent = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = materialize(
            hooked.join(parent, "label", "left").select("node", "old", F.least("label", "up").alias("label")), "labels"
        )
        labels = jumped.select("node", "label")
        if jumped.where(F.col("label") != F.col("old")).isEmpty():
            return labels


def dbscan(points: DataFrame, eps: float, min_pts: int, key: str = "id", vec: str = "features") -> DataFrame:
    """(id, cluster): clusters numbered by their first core point, 0 is noise.

    A border point joins the lowest-numbered cluster that reaches it.
    """
    at = laid_out(points, key, vec)
    marked = at.places
    if min_pts > 1:
        counts = at.counts_within(eps, min_pts)
        marked = marked.join(counts.withColumnRenamed("c", "near"), "pos").withColumn("core", F.col("near") >= min_pts).drop("near")
        marked = materialize(marked, "marked")
    else:
        marked = marked.withColumn("core", F.lit(True))
    cores = marked.where("core").drop("core")
    named, links = at.links_within(cores, eps)
    named, links = materialize(named, "nodes"), materialize(links, "links")
    nodes = named.select("node").union(links.select("src")).union(links.select("dst")).distinct()
    named = named.join(connected_components(nodes, links), "node")
    roots = materialize(named.groupBy("label").agg(F.min("first").alias("root")), "roots")
    ranked, _ = with_global_rank(roots, F.col("root"), [])
    ranked = ranked.select("label", F.col("_rank").cast("bigint").alias("c"))
    cluster_of = materialize(named.join(ranked, "label").select("pos", "c"), "clusters")
    found = cluster_of
    if min_pts > 1:
        found = found.unionByName(at.least_within(marked.where(~F.col("core")), cluster_of, eps))
    return at.rows.join(found, "pos", "left").select("id", F.coalesce("c", F.lit(0)).cast("bigint").alias("cluster"))


def noise_ratio(labels: DataFrame) -> DataFrame:
    return labels.agg(F.avg((F.col("cluster") == 0).cast("double")).alias("noise_ratio"))


def single_linkage(points: DataFrame, cut: float, key: str = "id", vec: str = "features") -> DataFrame:
    """Single-linkage clusters at height ``cut``: components of the graph of near points."""
    return dbscan(points, cut, 1, key, vec)


def spanning_tree(
    points: DataFrame, key: str = "id", vec: str = "features", broadcast_bytes: int = TREE_BYTES, block_rows: int = units.SMALL_ROWS
) -> tuple[DataFrame, DataFrame]:
    """((id, node) of all rows, (src, dst, distance) of a minimum spanning tree of the nodes).

    A node is the smallest id of a position; equal distances are in order of the two ids. Trees of units
    of about ``block_rows`` rows and the links between near units make the tree (see ``units``); the links that
    stay open then are sorted in one task up to ``broadcast_bytes``, else in rounds. Positions with a
    component that is not finite have no links.
    """
    rows = points.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    nodes = materialize(rows.groupBy("vec").agg(F.min("id").alias("node")), "nodes")
    of = materialize(rows.join(nodes, "vec").select("id", "node"), "node-of")
    placed = nodes.where(units.FINITE).where("node IS NOT NULL")
    return of, materialize(units.shortest_tree(placed, broadcast_bytes // LINK_BYTES, block_rows), "tree")


def tree_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``connected_components`` of links that are stored so that those of a place lie together.

    Every task first draws together the nodes that its own links connect, at most ``STAR_LINKS`` at a time. A node
    that only one such group holds takes the label of the group; the rest, few, are connected.
    """
    kind = nodes.schema["node"].dataType.simpleString()

    def star(parts):
        f = pd.concat(parts)
        names = np.concatenate([f["src"].to_numpy(), f["dst"].to_numpy()])
        root, node = metric.stars(names, np.arange(len(f)), np.arange(len(f)) + len(f))
        return pd.DataFrame({"src": root, "dst": node})

    def join(frames):
        parts = []
        for f in frames:
            parts.append(f)
            if sum(map(len, parts)) >= STAR_LINKS:
                yield star(parts)
                parts = []
        if parts:
            yield star(parts)

    stars = materialize(links.select("src", "dst").mapInPandas(join, f"src {kind}, dst {kind}"), "stars")
    roots = stars.select(F.col("src").alias("node"), F.lit(None).cast(kind).alias("root")).distinct()
    held = roots.unionByName(stars.select(F.col("dst").alias("node"), F.col("src").alias("root")))
    # more than one entry, or that of a root: the node connects groups
    held = held.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("root"))
    held = materialize(held.withColumn("inner", F.col("root").isNull() | (F.col("n") > 1)), "held")
    inner = held.where("inner").select("node")
    found = connected_components(inner, stars.join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    outer = held.where("NOT inner").select("node", "root").join(found.toDF("root", "label"), "root").select("node", "label")
    named = nodes.select("node").join(found.unionByName(outer), "node", "left")
    return materialize(named.select("node", F.coalesce("label", "node").alias("label")), "labels")


def cut_tree(of: DataFrame, tree: DataFrame, k: int) -> DataFrame:
    """(id, cluster) after the k - 1 longest links of a spanning tree go, clusters numbered by
    their smallest id. Of equal links those with the larger ids go first."""
    order = ["distance", "src", "dst"]
    cut = tree.orderBy(*[F.desc(c) for c in order]).limit(max(0, k - 1)).agg(F.min(F.struct(*order)).alias("l")).select("l.*").first()
    kept = tree
    if cut["src"] is not None:  # no join, which would deal the links out anew
        kept = tree.where(F.struct(*order) < F.struct(*[F.lit(cut[c]).cast(tree.schema[c].dataType).alias(c) for c in order]))
    labels = tree_components(of.select("node").distinct(), kept)
    ranked, _ = with_global_rank(labels.where("node = label").select("label"), F.col("label"), [])
    named = labels.join(ranked.select("label", F.col("_rank").cast("bigint").alias("cluster")), "label")
    return of.join(named, "node").select("id", "cluster")


def single_linkage_k(points: DataFrame, k: int, key: str = "id", vec: str = "features", **limits) -> DataFrame:
    """(id, cluster) of single linkage down to ``k`` clusters: a spanning tree without its k - 1
    longest links. With fewer distinct positions than ``k``, each is a cluster."""
    return cut_tree(*spanning_tree(points, key, vec, **limits), k)


# ---- k-means and scores ---------------------------------------------------------------------------------


def kmeans(df: DataFrame, k: int, seed: int = 42, init: str = "k-means||", features: str = "features", **more):
    """Lloyd iterations from random or k-means|| centres (``init``)."""
    from pyspark.ml.clustering import KMeans

    return KMeans(k=k, seed=seed, initMode=init, featuresCol=features, predictionCol="cluster", **more).fit(df)


def kmeans_assign(points: DataFrame, centroids: list[list[float]], vec: str = "features") -> DataFrame:
    """Nearest centroid (first on ties) and squared distance; centroids become literals."""
    if len(centroids) > 10000:
        raise ValueError("too many centroids for literals; fit with kmeans() and transform instead")
    table = F.array(
        *[
            F.struct(F.lit(i).alias("c"), F.array(*[F.lit(float(x)) for x in row]).alias("at"))
            for i, row in enumerate(centroids)
        ]
    )
    v = F.col(vec).cast("array<double>")

    def scored(c):
        sq = F.zip_with(v, c["at"], lambda x, y: (x - y) * (x - y))
        return F.struct(F.aggregate(sq, F.lit(0.0), lambda a, b: a + b).alias("d2"), c["c"].alias("c"))

    best = F.array_min(F.transform(table, scored))
    return points.withColumn("_b", best).withColumns({"cluster": F.col("_b.c"), "dist2": F.col("_b.d2")}).drop("_b")


def wcss(assigned: DataFrame) -> DataFrame:
    """Within-cluster sum of squares and average cost."""
    return assigned.agg(F.sum("dist2").alias("wcss"), F.avg("dist2").alias("avg_cost"))


def elbow(costs: DataFrame) -> DataFrame:
    """Best k from (k, wcss): largest absolute second difference, plus 2; 1 for fewer than 3.

    The table has one row per tried k, so it is handled as one sorted array.
    """
    w = F.transform(F.array_sort(F.collect_list(F.struct("k", "wcss"))), lambda s: s["wcss"])
    one = costs.agg(w.alias("w"))
    i = F.sequence(F.lit(0), F.size("w") - 3)
    diffs = F.transform(
        i, lambda j: F.struct(F.abs(F.get("w", j + 2) - F.get("w", j + 1) * 2.0 + F.get("w", j)).alias("d"), (-j).alias("j"))
    )
    best = -F.array_max(diffs)["j"] + 2
    return one.select(F.when(F.size("w") < 3, F.lit(1)).otherwise(best).cast("int").alias("best_k"))


def distance_sums(a, b, member):
    """``pair_distances(a, b) @ member``, by tiles of bounded size.

    Squared distances come from products around a common centre; pairs so close that this costs digits
    (and rows that are not finite) are measured by their difference.
    """
    centre = np.nan_to_num(b[:1].mean(0), posinf=0.0, neginf=0.0)
    x, y = a - centre, b - centre
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    total = np.zeros((len(a), member.shape[1]))
    left, right = np.column_stack([x, nx, np.ones(len(x))]), np.column_stack([-2.0 * y, np.ones(len(y)), ny]).T.copy()
    held = np.empty((SUM_TILE, SUM_TILE))
    for i in range(0, len(a), SUM_TILE):
        for j in range(0, len(b), SUM_TILE):
            p, q = left[i : i + SUM_TILE], right[:, j : j + SUM_TILE]
            with np.errstate(invalid="ignore", over="ignore"):
                d = np.matmul(p, q, out=held[: len(p), : q.shape[1]]) if q.shape[1] == SUM_TILE else p @ q
                near = 1e-5 * (nx[i : i + SUM_TILE, None].max() + ny[j : j + SUM_TILE].max())
                r, c = np.nonzero(~(d > near))
                d[r, c] = 0.0
                np.sqrt(d, out=d)
                d[r, c] = listed_distances(a[i : i + SUM_TILE], b[j : j + SUM_TILE], r, c, "euclidean")
                total[i : i + SUM_TILE] += d @ member[j : j + SUM_TILE]
    return total


def cluster_distance_sums(
    points: DataFrame, key: str, vec: str, label: str, broadcast_bytes: int = BROADCAST_BYTES, rows: int = GRID_QUERIES
) -> DataFrame:
    """Sum of distances from every row to each cluster: (id, label, other, total).

    The work is quadratic by definition, but only one sum per row, block and cluster leaves a
    task, and a task meets blocks of bounded size tile by tile. A checked small point set is broadcast.
    """
    p = points.select(
        F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v"), F.col(label).cast("int").alias("label")
    )
    size = p.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    n, dims = size["n"], size["d"] or 1
    schema = f"id {p.schema['id'].dataType.simpleString()}, label int, other int, total double"

    def frame(a, vectors, groups, member):
        total = distance_sums(np.vstack(a["v"].to_numpy()), vectors, member)
        k = len(groups)
        return pd.DataFrame(
            {
                "id": np.repeat(a["id"].to_numpy(), k),
                "label": np.repeat(a["label"].to_numpy(), k),
                "other": np.tile(groups, len(a)),
                "total": total.ravel(),
            }
        )

    def members(label):
        groups, inverse = np.unique(label, return_inverse=True)
        return groups, np.eye(len(groups))[inverse]

    def sums(a, b):
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({"id": [], "label": [], "other": [], "total": []})
        return frame(a, np.vstack(b["v"].to_numpy()), *members(b["label"].to_numpy()))

    if 0 < n * dims * 8 <= broadcast_bytes and n * n <= BROADCAST_PAIRS:
        side = p.toArrow()  # size checked above
        stored = np.vstack(side["v"].combine_chunks().to_numpy(zero_copy_only=False)), side["label"].to_pandas().to_numpy()
        sent = points.sparkSession.sparkContext.broadcast(stored)

        def scan(batches):
            vectors, label = sent.value
            for b in batches:
                if len(b):
                    yield frame(b, vectors, *members(label))

        tasks = math.ceil(n * n / TASK_PAIRS)
        return (p.repartition(tasks) if tasks > 1 else p).mapInPandas(scan, schema)
    chunks, blocks = max(1, math.ceil(n / rows)), max(1, math.ceil(n / (4 * rows)))
    met = grid(p, p, ["id", "v"], ["id", "v"], chunks, blocks, sums, schema)
    return met.groupBy("id", "label", "other").agg(F.sum("total").alias("total"))


def silhouette(points: DataFrame, key: str = "id", vec: str = "features", label: str = "cluster", **limits) -> DataFrame:
    """Per row: a (own-cluster mean, itself included), b (best other mean) and the score."""
    sums = cluster_distance_sums(points, key, vec, label, **limits)
    sizes = points.groupBy(F.col(label).cast("int").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    means = sums.join(sizes, "other").withColumn("mean", F.col("total") / F.col("n"))
    per = means.groupBy("id").agg(
        F.max(F.when(F.col("label") == F.col("other"), F.col("mean"))).alias("a"),
        F.min(F.when(F.col("label") != F.col("other"), F.col("mean"))).alias("b"),
    )
    return per.withColumn("silhouette", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))


def choose_k(train: DataFrame, valid: DataFrame, ks=range(2, 11), seed: int = 42, key: str = "id", passes: int = 100) -> DataFrame:
    """WCSS of both sets and silhouette of ``valid`` for every k, fitted on ``train`` alone, and the two choices.

    ``best_by_wcss`` marks the k with the smallest validation WCSS, ``recommended`` the one with the largest
    silhouette; of equal ones the first. Fits start from random rows and end once no centre moves
    or after ``passes``; they differ only in k.
    """
    from pyspark.ml.functions import vector_to_array

    fitted, held = (df.select(F.col(key), vector_to_array("features").alias("features")) for df in (train, valid))
    rows = []
    for k in ks:
        model = kmeans(train, k, seed, "random", maxIter=passes, tol=CENTRE_STEP)
        centres = [list(map(float, c)) for c in model.clusterCenters()]
        own = wcss(kmeans_assign(fitted, centres)).first()["wcss"]
        assigned = kmeans_assign(held, centres)
        cost = wcss(assigned).first()["wcss"]
        score = silhouette(assigned, key, "features", "cluster").agg(F.avg("silhouette")).first()[0]
        rows.append((int(k), own, cost, float(score or 0.0)))
    least = min((r for r in rows if r[2] is not None), key=lambda r: r[2], default=(None,))[0]
    best = max(rows, key=lambda r: r[3], default=(None,))[0]
    marked = [(*r, r[0] == least, r[0] == best) for r in rows]
    schema = "k int, train_wcss double, wcss double, silhouette double, best_by_wcss boolean, recommended boolean"
    return train.sparkSession.createDataFrame(marked, schema)


def gmm(df: DataFrame, k: int, max_iter: int = 100, tol: float = 0.01, seed: int = 42, features: str = "features"):
    """Gaussian mixture with full covariances."""
    from pyspark.ml.clustering import GaussianMixture

    return GaussianMixture(k=k, maxIter=max_iter, tol=tol, seed=seed, featuresCol=features, predictionCol="cluster").fit(df)


# ---- covariance, PCA, SVD ------------------------------------------------------------------------------------


def _spread(df: DataFrame, vec: str, dims: int) -> tuple[DataFrame, list[str]]:
    cols = [f"x{i}" for i in range(dims)]
    return df.select(*[F.col(vec)[i].cast("double").alias(c) for i, c in enumerate(cols)], F.lit(0.0).alias("label")), cols


def covariance_matrix(df: DataFrame, vec: str = "features", dims: int = 64) -> DataFrame:
    """Sample covariance as (i, j, value) rows, from one Gram pass."""
    values = _covariance(df, vec, dims)[1]
    rows = [(i, j, float(values[i, j])) for i in range(dims) for j in range(dims)]
    return df.sparkSession.createDataFrame(rows, "i int, j int, value double")


def _covariance(df: DataFrame, vec: str, dims: int):
    from tickwright.operators.regression import gram

    flat, cols = _spread(df, vec, dims)
    g = gram(flat, cols)
    return g.moments()[0][:-1], g.comoments()[:-1, :-1] / (g.n - 1.0)


def _axes(symmetric, k: int):
    """Leading eigenpairs with a fixed sign (largest component positive)."""
    values, vectors = np.linalg.eigh(symmetric)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order[:k]]
    top = np.abs(vectors).argmax(0)
    return values, vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def project(vec: Column, axes, centre=None) -> Column:
    """Row vector times a small matrix (columns of ``axes``), as array expressions."""
    v = vec if centre is None else F.zip_with(vec, F.array(*[F.lit(float(m)) for m in centre]), lambda x, m: x - m)
    out = []
    for col in axes.T:
        basis = F.array(*[F.lit(float(x)) for x in col])
        out.append(F.aggregate(F.zip_with(v, basis, lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b))
    return F.array(*out)


def pca(df: DataFrame, k: int, vec: str = "features", dims: int = 64) -> tuple[DataFrame, object]:
    """Adds ``projection`` (centred rows on the leading axes); returns all eigenvalues too."""
    mean, cov = _covariance(df, vec, dims)
    values, axes = _axes(cov, k)
    return df.withColumn("projection", project(F.col(vec).cast("array<double>"), axes, mean)), values


def explained_variance_ratio(spark, values, k: int) -> DataFrame:
    total = float(values.sum())
    rows = [(i, float(v), float(v) / total, float(values[: i + 1].sum()) / total) for i, v in enumerate(values[:k])]
    return spark.createDataFrame(rows, "component int, variance double, ratio double, cumulative double")


def svd(df: DataFrame, k: int, vec: str = "features", dims: int = 64):
    """Singular values and right vectors from the Gram matrix (rows far outnumber columns)."""
    from tickwright.operators.regression import gram

    flat, cols = _spread(df, vec, dims)
    g = gram(flat, cols, centre=False)
    values, axes = _axes(g.m[1:-1, 1:-1], k)
    return np.sqrt(np.maximum(values, 0.0)), axes


def svd_reconstruct(df: DataFrame, axes, vec: str = "features", out: str = "reconstructed") -> DataFrame:
    """Rank-k reconstruction of every row: x V Vᵀ."""
    code = df.withColumn("_code", project(F.col(vec).cast("array<double>"), axes))
    return code.withColumn(out, project(F.col("_code"), axes.T)).drop("_code")


def relative_error(df: DataFrame, vec: str = "features", approx: str = "reconstructed") -> DataFrame:
    """Frobenius norm of the difference over the norm of the data."""
    v = F.col(vec).cast("array<double>")
    diff = F.aggregate(F.zip_with(v, F.col(approx), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b)
    norm = F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda a, b: a + b)
    return df.agg(F.sqrt(F.try_divide(F.sum(diff), F.sum(norm))).alias("relative_error"))
