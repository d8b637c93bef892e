"""Exact nearest neighbours and distances to given partners.

Small training sides (checked against a byte limit) are broadcast and scanned by as many query tasks
as the number of pairs asks for. Larger ones are cut into cells around pivot rows, and a query visits
only the cells that the triangle inequality cannot rule out. Where it rules out little (many dimensions
without clusters), every bounded block of queries meets every bounded block of training rows instead,
so that a block travels once for each block of the other side, not once for each row. Pairs never
leave a task: only the k best of each block do. Inside a task a rounded matrix product (or rounded sums
for the Manhattan metric) with a bound of its error names the candidates; only they are measured exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwright.session import materialize

BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 4096
MAX_CELLS = 1024
GRID_BYTES = 32 * 1024 * 1024
GRID_QUERIES = 16384
KNN_BYTES = 4 * 1024 * 1024
KNN_BLOCK = 8 * 1024 * 1024
TASK_PAIRS = 1 << 28
SUM_ROWS = 32
BROADCAST_PAIRS = 1 << 36
GRID_SHARE = 8
FEW_DIMS = 8
RESULT = "query_id {0}, train_id {1}, distance double, label double"


def pair_distances(a, b, metric: str):
    """Distance matrix of two numpy blocks, by chunks of bounded size."""
    import numpy as np

    out = np.empty((len(a), len(b)))
    if a.shape[1] < FEW_DIMS:  # same sums in the same order, without a third axis
        for i in range(0, len(a), step := max(1, 250_000 // max(1, len(b)))):
            total = np.zeros((len(a[i : i + step]), len(b)))
            for x, y in zip(a[i : i + step].T, b.T):
                diff = x[:, None] - y[None, :]
                total += np.abs(diff) if metric == "manhattan" else diff * diff
            out[i : i + step] = total if metric == "manhattan" else np.sqrt(total)
        return out
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        diff = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.abs(diff).sum(2) if metric == "manhattan" else np.sqrt((diff * diff).sum(2))
    return out


def listed_distances(a, b, i, j, metric: str):
    """Distances of the pairs (a[i], b[j]), equal to the entries of ``pair_distances``."""
    import numpy as np

    out = np.empty(len(i))
    step = max(1, 2_000_000 // max(1, a.shape[1]))
    for at in range(0, len(i), step):
        diff = a[i[at : at + step]] - b[j[at : at + step]]
        out[at : at + step] = np.abs(diff).sum(1) if metric == "manhattan" else np.sqrt((diff * diff).sum(1))
    return out


class Rounded:
    """Cheap stand-ins for the distances of two blocks of finite rows.

    ``tile`` gives numbers that grow with the distance: off by at most ``slack`` (one value a row of the
    first block) from ``of(distance)``. Few dimensions are measured as they are. Otherwise squared
    Euclidean distances come from a float32 product of vectors that are centred and scaled to length 1 at
    most, Manhattan distances from sums of 16-bit integers.
    """

    def __init__(self, a, b, metric: str):
        import numpy as np

        self.a, self.b, self.metric = a, b, metric
        self.dims = d = a.shape[1]
        self.kind, self.slack, self.rows, self.cols, self.held = "plain", np.zeros(len(a)), 256, 1024, {}
        if d < FEW_DIMS or not len(a) or not len(b):
            return
        with np.errstate(all="ignore"):
            if metric == "manhattan":
                low = np.minimum(a.min(0), b.min(0))
                span = (np.maximum(a.max(0), b.max(0)) - low).max()
                levels = 32000 // d
                if levels < 8 or not 1e-150 < span < 1e150:
                    return
                self.scale = levels / span
                self.x = np.rint((a - low) * self.scale).astype("int16")
                self.y = np.ascontiguousarray(np.rint((b - low) * self.scale).astype("int16").T)
                self.kind, self.rows, self.cols = "sums", 8 * SUM_ROWS, 4096
                self.slack = np.full(len(a), d * 1.01)  # each component is off by half a level on both sides
                return
            centre = b.mean(0)
            x, y = a - centre, b - centre
            scale = max(np.sqrt((x * x).sum(1)).max(), np.sqrt((y * y).sum(1)).max())
            if not 1e-150 < scale < 1e150:
                return
            x, y, self.scale = x / scale, y / scale, 1.0 / scale
            nx, ny = (x * x).sum(1), (y * y).sum(1)
            self.x = np.column_stack([x, nx, np.ones(len(x))]).astype("float32")
            self.y = np.ascontiguousarray(np.column_stack([-2.0 * y, np.ones(len(y)), ny]).astype("float32").T)
            self.kind, self.rows, self.cols = "product", 512, 2048
            self.slack = (d + 16) * 2.0**-23 * (np.sqrt(nx) + np.sqrt(ny.max())) ** 2 + 1e-30

    def of(self, distance):
        """The number that stands for a distance."""
        if self.kind == "plain":
            return distance
        return distance * self.scale if self.kind == "sums" else (distance * self.scale) ** 2

    def tile(self, i: int, j: int):
        """Rows i to i + rows against rows j to j + cols; valid until the next call."""
        import numpy as np

        i_, j_ = slice(i, i + self.rows), slice(j, j + self.cols)
        if self.kind == "plain":
            return pair_distances(self.a[i_], self.b[j_], self.metric)
        x, y = self.x[i_], self.y[:, j_]
        shape = (len(x), y.shape[1])
        if shape not in self.held:  # memory that is used again for every tile of a shape
            self.held[shape] = np.empty(shape, x.dtype), np.empty((min(len(x), SUM_ROWS), shape[1]), x.dtype)
        total, diff = self.held[shape]
        if self.kind == "product":
            return np.matmul(x, y, out=total)
        total[:] = 0
        for i in range(0, len(x), SUM_ROWS):  # few rows at a time, whose sums stay near the core
            rows = total[i : i + SUM_ROWS]
            part = diff[: len(rows)]
            for k in range(self.dims):
                np.subtract(x[i : i + SUM_ROWS, k, None], y[None, k], out=part)
                np.abs(part, out=part)
                rows += part
        return total

    def top(self, limit):
        """The largest value of a tile's type that is within each limit, or a little more."""
        import numpy as np

        if self.kind == "product":  # rounded up, so that a limit in less digits leaves nothing out
            return np.nextafter(limit.astype("float32"), np.float32(np.inf))
        if self.kind == "sums":
            return np.floor(np.minimum(limit, np.iinfo("int16").max)).astype("int16")
        return limit


def nearest(a, b, ex_a, ex_b, k: int, metric: str):
    """(i, j, distance) of the k nearest rows b[j] of each a[i] whose ``ex`` differs; of equal distances
    the smaller j, in order of i and rank. Rows with a component that is not finite have no neighbours."""
    import numpy as np

    own_a, own_b = np.flatnonzero(np.isfinite(a).all(1)), np.flatnonzero(np.isfinite(b).all(1))
    a, b, ex_a, ex_b = a[own_a], b[own_b], ex_a[own_a], ex_b[own_b]
    near, parts = Rounded(a, b, metric), []
    for i in range(0, len(a), near.rows):
        q = len(a[i : i + near.rows])
        slack = 2.0 * near.slack[i : i + q]
        limit, found, held = np.full(q, np.inf), [], 0
        for step, j in enumerate(range(0, len(b), near.cols)):
            tile = near.tile(i, j)
            mask = None
            if step == 0 and tile.shape[1] > k:
                # the k-th number of the first rows that are allowed bounds all that follow
                mask = ex_a[i : i + q, None] != ex_b[None, j : j + near.cols]
                first = np.where(mask, tile, np.inf if tile.dtype.kind == "f" else np.iinfo(tile.dtype).max)
                kth = np.partition(first, k - 1, axis=1)[:, k - 1].astype(float)
                limit = np.where(mask.sum(1) >= k, kth + slack, np.inf)
            r, c = np.divmod(np.flatnonzero(tile <= near.top(limit)[:, None]), tile.shape[1])
            ok = ex_a[i + r] != ex_b[j + c]
            r, c = r[ok], c[ok]
            found.append((r, c + j, tile[r, c].astype(float)))
            held += len(r)
            if held > 4 * k * q + 65_536:
                found = [kept(found, limit, slack, k, a[i : i + q], b, metric)]
                held = len(found[0][0])
            elif step & (step + 1) == 0:
                found = [tightened(found, limit, slack, k)]
                held = len(found[0][0])
        if not found:
            continue
        r, c, v = (np.concatenate(x) for x in zip(*found))
        ok = v <= limit[r]
        r, c = r[ok], c[ok]
        d = listed_distances(a[i : i + q], b, r, c, metric)
        r, c, d = first_of(r, c, d, k)
        parts.append((own_a[r + i], own_b[c], d))
    if not parts:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    r, c, d = (np.concatenate(x) for x in zip(*parts))
    ok = np.isfinite(d)
    return r[ok], c[ok], d[ok]


def first_of(r, c, v, k: int):
    """The k entries of each row r with the smallest v (then c), in that order."""
    import numpy as np

    order = np.lexsort((c, v, r))
    r, c, v = r[order], c[order], v[order]
    begin = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, int)
    rank = np.arange(len(r)) - np.repeat(begin, np.diff(np.r_[begin, len(r)]))
    return r[rank < k], c[rank < k], v[rank < k]


def tightened(found, limit, slack, k: int):
    """Candidates within the limits, after the k-th of each row has lowered them (in place)."""
    import numpy as np

    r, c, v = (np.concatenate(x) for x in zip(*found))
    top_r, _, top_v = first_of(r, c, v, k)
    full = np.bincount(top_r, minlength=len(limit)) >= k
    kth = np.full(len(limit), -np.inf)
    np.maximum.at(kth, top_r, top_v)
    np.minimum(limit, np.where(full, kth + slack, np.inf), out=limit)
    ok = v <= limit[r]
    return r[ok], c[ok], v[ok]


def kept(found, limit, slack, k: int, a, b, metric: str):
    """The same, and of many candidates near the limit (copies) only the k that are exactly nearest."""
    r, c, v = tightened(found, limit, slack, k)
    if len(r) <= 2 * k * len(limit):
        return r, c, v
    import numpy as np

    order = np.lexsort((c, r))
    r, c, v = r[order], c[order], v[order]
    r2, c2, _ = first_of(r, c, listed_distances(a, b, r, c, metric), k)
    width = len(b)
    ok = np.isin(r * width + c, r2 * width + c2)
    return r[ok], c[ok], v[ok]


def codes(q, t):
    """Integers that are equal where the values of two columns are."""
    import pandas as pd

    both, _ = pd.factorize(pd.concat([pd.Series(q), pd.Series(t)], ignore_index=True))
    return both[: len(q)], both[len(q) :]


def best_of_block(q, t, k: int, metric: str):
    """The k nearest rows of a training block for each query row (ties by training id)."""
    import numpy as np
    import pandas as pd

    if len(q) == 0 or len(t) == 0:
        return pd.DataFrame({"query_id": [], "train_id": [], "distance": [], "label": []})
    t = t.sort_values("train_id", kind="stable")
    ex_q, ex_t = codes(q["ex"].to_numpy(), t["ex"].to_numpy())
    i, j, d = nearest(np.vstack(q["vec"].to_numpy()), np.vstack(t["vec"].to_numpy()), ex_q, ex_t, k, metric)
    return pd.DataFrame(
        {
            "query_id": q["query_id"].to_numpy()[i],
            "train_id": t["train_id"].to_numpy()[j],
            "distance": d,
            "label": t["label"].to_numpy(float)[j],
        }
    )


def knn_join(
    train: DataFrame,
    query: DataFrame,
    k: int,
    vec: str = "features",
    label: str = "label",
    key: str = "id",
    exclude: str | None = None,
    metric: str = "euclidean",
    broadcast_bytes: int = KNN_BYTES,
    block_rows: int = BLOCK_ROWS,
    grid_bytes: int = KNN_BLOCK,
    grid_queries: int = GRID_QUERIES,
) -> DataFrame:
    """(query_id, rank, train_id, distance, label) of the k nearest training rows.

    ``exclude`` names a column; training rows with the query's value are not considered
    (the key for leave-one-out, the fold for cross-validation). A NULL value excludes nothing.
    A Python worker holds about ten times ``broadcast_bytes`` or ``grid_bytes``, whatever the number of rows.
    """
    def shaped(df, name, spare):
        ex = F.col(exclude).cast("string") if exclude else F.lit(None).cast("string")
        return df.select(
            F.col(key).alias(name),
            F.col(vec).cast("array<double>").alias("vec"),
            F.coalesce(ex, F.lit(spare)).alias("ex"),
            (F.col(label).cast("double") if label in df.columns else F.lit(None).cast("double")).alias("label"),
        )

    t, q = shaped(train, "train_id", "~t"), shaped(query, "query_id", "~q").drop("label")
    schema = RESULT.format(q.schema["query_id"].dataType.simpleString(), t.schema["train_id"].dataType.simpleString())
    size = t.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    n, dims = size["n"], size["d"] or 1
    asked = q.count()
    if n * dims * 8 <= broadcast_bytes and n * asked <= BROADCAST_PAIRS:
        best = _knn_broadcast(t, q, k, metric, schema, math.ceil(n * asked / TASK_PAIRS))
    else:
        best = _knn_cells(t, q, k, metric, schema, n, asked, block_rows, max(1, grid_bytes // (8 * dims)), grid_queries)
    w = Window.partitionBy("query_id").orderBy("distance", "train_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _knn_broadcast(t: DataFrame, q: DataFrame, k: int, metric: str, schema: str, tasks: int) -> DataFrame:
    import numpy as np

    side = t.toArrow()  # size checked by the caller
    vec = side["vec"].combine_chunks() if side.num_rows else None
    if vec is not None and vec.null_count:
        raise ValueError("training rows without a vector")
    stored = (side.drop(["vec"]), np.vstack(vec.to_numpy(zero_copy_only=False)) if side.num_rows else None)
    sent = t.sparkSession.sparkContext.broadcast(stored)

    def scan(batches):
        rest, vectors = sent.value
        rest = rest.to_pandas()
        rest["vec"] = list(vectors) if vectors is not None else []
        for b in batches:
            yield best_of_block(b, rest, k, metric)

    if tasks > 1:
        q = q.repartition(tasks)
    return q.mapInPandas(scan, schema)


def grid(queries: DataFrame, members: DataFrame, by_query, by_member, chunks: int, blocks: int, fn, schema: str) -> DataFrame:
    """Runs ``fn(queries, members)`` on every bounded chunk of queries and every bounded block of members.

    ``by_query`` and ``by_member`` are the columns whose hash deals the rows out."""
    keys, n = ["chunk", "block"], min(4096, 2 * chunks * blocks)
    left = queries.withColumn("chunk", F.pmod(F.xxhash64(*by_query), F.lit(chunks)).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(n, *keys)
    right = members.withColumn("block", F.pmod(F.xxhash64(*by_member), F.lit(blocks)).cast("int"))
    right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(n, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(fn, schema)


def _knn_cells(t: DataFrame, q: DataFrame, k: int, metric: str, schema: str, n: int, asked: int, block_rows: int, grid_rows: int, grid_queries: int) -> DataFrame:
    import numpy as np
    import pandas as pd

    spark = t.sparkSession
    cells = min(MAX_CELLS, max(1, math.ceil(n / block_rows)))
    seeds = t.orderBy(F.xxhash64("train_id"), "train_id").limit(cells).select("vec").collect()
    pivots = spark.sparkContext.broadcast(np.array([r["vec"] for r in seeds], float))
    id_type = t.schema["train_id"].dataType.simpleString()

    def to_cell(batches):
        for b in batches:
            d = pair_distances(np.vstack(b["vec"].to_numpy()), pivots.value, metric)
            cell = d.argmin(1)
            yield b.assign(cell=cell.astype("int32"), reach=d[np.arange(len(d)), cell])

    placed = materialize(
        t.mapInPandas(to_cell, f"train_id {id_type}, vec array<double>, ex string, label double, cell int, reach double"),
        "cells",
    )
    # Rows of a cell a query can count on: all but the largest group it might exclude.
    stats = (
        placed.groupBy("cell", "ex")
        .agg(F.count(F.lit(1)).alias("c"), F.max("reach").alias("r"))
        .groupBy("cell")
        .agg(F.sum("c").alias("rows"), F.max("c").alias("ex"), F.max("r").alias("radius"))
        .collect()
    )
    rows, sure, radius = (np.zeros(len(seeds)) for _ in range(3))
    for s in stats:
        rows[s["cell"]], sure[s["cell"]], radius[s["cell"]] = s["rows"], s["rows"] - s["ex"], s["radius"]
    blocks = np.maximum(1, np.ceil(rows / block_rows)).astype(int)
    info = spark.sparkContext.broadcast((sure, radius, rows > 0, blocks))
    q_type = q.schema["query_id"].dataType.simpleString()
    chunks = max(1, math.ceil(asked / (2 * block_rows)))

    def meet(qb, tb):
        return best_of_block(qb, tb, k, metric)

    def reached(batches):
        sure_, radius_, used, blocks_ = info.value
        for b in batches:
            if not len(b):
                continue
            d = pair_distances(np.vstack(b["vec"].to_numpy()), pivots.value, metric)
            far = np.where(used, d + radius_, np.inf)
            order = np.argsort(far, axis=1)
            enough = np.cumsum(sure_[order], axis=1) >= k
            first = np.where(enough.any(1), enough.argmax(1), d.shape[1] - 1)
            limit = np.take_along_axis(far, order, 1)[np.arange(len(d)), first]
            limit = np.where(enough.any(1), limit, np.inf)
            near = used & (d - radius_ <= limit[:, None] * (1 + 1e-9) + 1e-12)
            yield b, near, blocks_

    def visited(batches):
        for _, near, blocks_ in reached(batches):
            yield pd.DataFrame({"visits": [int((near @ blocks_).sum())]})

    met = q.mapInPandas(visited, "visits bigint").agg(F.sum("visits")).first()[0] or 0
    if met * block_rows * GRID_SHARE > asked * n:
        return grid(q, t, ["query_id", "vec"], ["train_id", "vec"], math.ceil(asked / grid_queries), math.ceil(n / grid_rows), meet, schema)

    def visits(batches):
        for b, near, blocks_ in reached(batches):
            i, c = np.nonzero(near)
            reps = blocks_[c]
            i, c = np.repeat(i, reps), np.repeat(c, reps)
            sub = np.concatenate([np.arange(r) for r in reps]) if len(reps) else np.array([], int)
            for at in range(0, len(i), block_rows):
                s = slice(at, at + block_rows)
                yield b.iloc[i[s]].assign(cell=c[s].astype("int32"), sub=sub[s].astype("int32"))

    routed = q.mapInPandas(visits, f"query_id {q_type}, vec array<double>, ex string, cell int, sub int")
    routed = routed.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
    size = spark.createDataFrame([(i, int(b)) for i, b in enumerate(blocks)], "cell int, blocks int")
    cut = (
        placed.join(F.broadcast(size), "cell")  # at most MAX_CELLS rows
        .withColumn("sub", F.pmod(F.xxhash64("train_id"), F.col("blocks")).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    )
    keys = ["cell", "sub", "chunk"]
    return routed.groupBy(*keys).cogroup(cut.groupBy(*keys)).applyInPandas(meet, schema)


# ---- regression and classification by neighbours ------------------------------------------------


def knn_predict(neighbors: DataFrame) -> DataFrame:
    """Inverse-distance mean of the neighbours' labels; exact matches, if any, count alone."""
    exact = F.col("distance") == 0
    inverse = F.when(~exact, F.lit(1.0) / F.nullif(F.col("distance"), F.lit(0.0)))
    return neighbors.groupBy("query_id").agg(
        F.coalesce(
            F.avg(F.when(exact, F.col("label"))), F.sum(F.col("label") * inverse) / F.sum(inverse)
        ).alias("prediction")
    )


def knn_distances(neighbors: DataFrame) -> DataFrame:
    """Prediction with the k distances in rank order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "distance"))), lambda s: s["distance"])
    d = neighbors.groupBy("query_id").agg(ordered.alias("distances"))
    return knn_predict(neighbors).join(d, "query_id")


def knn_vote(neighbors: DataFrame) -> DataFrame:
    """Majority label; ties go to the label seen first among the nearest."""
    votes = neighbors.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("r"))
    return votes.groupBy("query_id").agg(F.max_by("label", F.struct("n", -F.col("r"))).alias("prediction"))


def knn_errors_by_k(neighbors: DataFrame, truth: DataFrame, k_max: int, ks: list[int]) -> DataFrame:
    """Squared error of the inverse-distance mean for every k, from one neighbour list."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    inverse = F.lit(1.0) / F.greatest(F.col("distance"), F.lit(1e-12))
    prefix = neighbors.withColumn("p", F.sum(F.col("label") * inverse).over(w) / F.sum(inverse).over(w))
    scored = prefix.where(F.col("rank").isin(ks)).select("query_id", F.col("rank").alias("k"), "p")
    joined = scored.join(truth, "query_id")
    return joined.groupBy("k").agg(F.avg(-(F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))).alias("score"))


def knn_accuracy_by_k(neighbors: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """Accuracy of the majority vote for every k, from one neighbour list."""
    at = neighbors.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where(F.col("rank") <= F.col("k"))
    votes = at.groupBy("k", "query_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("r"))
    won = votes.groupBy("k", "query_id").agg(F.max_by("label", F.struct("n", -F.col("r"))).alias("p"))
    hit = won.join(truth, "query_id").withColumn("hit", (F.col("p") == F.col("y")).cast("double"))
    return hit.groupBy("k", "fold").agg(F.avg("hit").alias("a")).groupBy("k").agg(F.avg("a").alias("score"))


def best_k(scores: DataFrame) -> DataFrame:
    """The k with the best score (smallest on ties)."""
    return scores.agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("best_k"), F.max("score").alias("best_score"))


# ---- distances and kernels of given pairs -------------------------------------------------------


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def with_vectors(pairs: DataFrame, points: DataFrame, key: str = "id", vec: str = "features") -> DataFrame:
    """Pairs (id_a, id_b) with both vectors attached by two equi joins."""
    a = points.select(F.col(key).alias("id_a"), F.col(vec).cast("array<double>").alias("va"))
    b = points.select(F.col(key).alias("id_b"), F.col(vec).cast("array<double>").alias("vb"))
    return pairs.join(a, "id_a").join(b, "id_b")


def pairwise_distance(pairs: DataFrame, points: DataFrame, key: str = "id", vec: str = "features") -> DataFrame:
    """Euclidean distance of the listed pairs; all pairs are never formed."""
    return with_vectors(pairs, points, key, vec).select(
        "id_a", "id_b", euclidean(F.col("va"), F.col("vb")).alias("distance")
    )


def kernel_similarity(
    pairs: DataFrame, points: DataFrame, kinds=("rbf",), key: str = "id", vec: str = "features", sigma: float = 1.0, degree: int = 3
) -> DataFrame:
    """One column for each kernel (rbf, polynomial, linear) of the listed pairs.

    The vectors are attached once, whatever the number of kernels.
    """
    a, b = F.col("va"), F.col("vb")
    d = euclidean(a, b)
    known = {
        "rbf": F.exp(-(d * d) / F.lit(2.0 * sigma * sigma)),
        "polynomial": F.pow(dot(a, b) + F.lit(1.0), F.lit(float(degree))),
        "linear": dot(a, b),
    }
    if unknown := set(kinds) - set(known):
        raise ValueError(f"unknown kernels {sorted(unknown)}")
    return with_vectors(pairs, points, key, vec).select("id_a", "id_b", *[known[k].alias(k) for k in kinds])


# ---- the training set of the neighbour model ------------------------------------------------------


def knn_training_set(df: DataFrame, cols: list[str], key: str, max_samples: int | None = None, sigmas: float = 10.0) -> DataFrame:
    """Finite values, no row beyond ``sigmas`` deviations; all rows unless a sample is asked for."""
    from tickwright.functions.numeric import nan_to_num
    from tickwright.operators.features import outlier_filter, subsample

    clean = df.withColumns({c: nan_to_num(c) for c in cols})
    kept = outlier_filter(clean, cols, sigmas)
    return kept if max_samples is None else subsample(kept, key, max_samples)


def scale_like(train: DataFrame, rows: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """``rows`` z-scored with the population statistics of ``train``, as one array column."""
    from tickwright.functions.numeric import ratio

    from tickwright.operators.features import _stats

    stats = _stats(train, cols, F.avg, F.stddev_pop)
    return rows.withColumn(out, F.array(*[ratio(F.col(c) - F.lit(m), F.lit(s), 0.0) for c, (m, s) in zip(cols, stats)]))
