"""All points within a distance, in any number of dimensions, without listing pairs.

Equal positions are folded first, so copies cost one row. Positions lie in balls around pivot rows
and, inside a ball, in rings of similar distance to its pivot; both are few (``MAX_BALLS``,
``MAX_RINGS``) and their bounds reach every task. The triangle inequality then sorts the balls and
rings of a query into three kinds: too far, wholly within the distance, and mixed. Whole ones count
by their stored weight and stand for all their members, so two dense balls never meet row by row;
only for mixed rings does a query travel, to blocks of bounded size. A block sends counts, minima or
a spanning forest, never its pairs (``eps_pairs`` is the one that lists them, by request). Where most
rings are mixed for most queries (many dimensions without clusters), bounded blocks of queries meet
bounded blocks of members instead, so that no query is copied for each ring.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwright.operators.neighbors import GRID_BYTES, GRID_QUERIES, GRID_SHARE, Rounded, grid, listed_distances, pair_distances
from tickwright.session import materialize

BLOCK_ROWS = 1024
QUERY_ROWS = 2048
BALL_ROWS = 256
MAX_BALLS = 1024
MAX_RINGS = 64
SLACK = 1e-9
ROUTE_VALUES = 1 << 20
MIN_BLOCKS = 16


def stack(vectors):
    return np.vstack(vectors.to_numpy()).astype(float) if len(vectors) else np.empty((0, 1))


def folded(points: DataFrame, key: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """((id, pos) of all rows, (pos, first, w, vec) of distinct positions), both stored."""
    rows = points.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    places = rows.groupBy("vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).cast("bigint").alias("w"))
    places = materialize(places.withColumn("pos", F.monotonically_increasing_id()), "positions")
    return materialize(rows.join(places, "vec").select("id", "pos"), "rows"), places.select("pos", "first", "w", "vec")


class Rings:
    """Bounds of all balls and rings: pivots, and by ring (slot) its ball, least and largest distance
    to the pivot, weight and number of blocks."""

    def __init__(self, pivots, cuts, rows):
        self.pivots, self.cuts = pivots, cuts
        rows = sorted(rows, key=lambda r: (r["ball"], r["ring"]))
        self.slot = {(r["ball"], r["ring"]): i for i, r in enumerate(rows)}
        self.ball = np.array([r["ball"] for r in rows], int)
        self.low, self.high = (np.array([r[c] for r in rows], float) for c in ("low", "high"))
        self.weight = np.array([r["w"] for r in rows], np.int64)
        self.blocks = np.array([math.ceil(r["n"] / BLOCK_ROWS) for r in rows], int)
        self.radius, self.ball_weight = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
        np.maximum.at(self.radius, self.ball, self.high)
        np.add.at(self.ball_weight, self.ball, self.weight)
        self.first = np.searchsorted(self.ball, np.arange(len(pivots) + 1))

    def sort_out(self, vectors, eps: float):
        """(whole balls by query as a matrix, (query, slot) of other whole rings, (query, slot) of mixed rings)."""
        d = pair_distances(vectors, self.pivots, "euclidean")
        far, near = eps * (1 + SLACK) + SLACK * d, eps * (1 - SLACK) - SLACK * d
        used = self.radius >= 0
        whole = used & (d + self.radius <= near)
        # a member is nearer to its own pivot than to the query's, so its ball cannot lie much farther
        reach = used & ~whole & (d - self.radius <= far) & (d <= d.min(1, keepdims=True) + 2 * far)
        q, ball = np.nonzero(reach)
        size = self.first[ball + 1] - self.first[ball]
        q, slot = np.repeat(q, size), spread(self.first[ball], size)
        at = d[q, self.ball[slot]]
        bound_far, bound_near = far[q, self.ball[slot]], near[q, self.ball[slot]]
        inside = at + self.high[slot] <= bound_near
        mixed = ~inside & (at - bound_far <= self.high[slot]) & (at + bound_far >= self.low[slot])
        return whole, (q[inside], slot[inside]), (q[mixed], slot[mixed])


def spread(starts, sizes):
    """starts[0], starts[0] + 1, ... (sizes[0] numbers), starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def into_rings(places: DataFrame) -> tuple[DataFrame, object, list]:
    """Places with (ball, ring), stored; the pivots; and each ball's ring cuts."""
    spark = places.sparkSession
    n = places.count()
    wanted = min(MAX_BALLS, max(1, math.ceil(n / BALL_ROWS)))
    pivots = np.array([r["vec"] for r in places.orderBy(F.xxhash64("pos"), "pos").limit(wanted).select("vec").collect()], float)
    sent = spark.sparkContext.broadcast(pivots)
    kinds = {f.name: f.dataType.simpleString() for f in places.schema.fields}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())

    def to_ball(batches):
        for b in batches:
            if len(b):
                d = pair_distances(stack(b["vec"]), sent.value, "euclidean")
                ball = d.argmin(1)
                yield b.assign(ball=ball.astype("int32"), reach=d[np.arange(len(d)), ball])

    placed = materialize(places.mapInPandas(to_ball, f"{schema}, ball int, reach double"), "balls")
    shares = [i / MAX_RINGS for i in range(1, MAX_RINGS)]
    cuts: list = [[] for _ in range(wanted)]
    for r in placed.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("reach", shares, 2000).alias("cuts")).collect():
        rings = min(MAX_RINGS, math.ceil(r["n"] / BLOCK_ROWS))
        cuts[r["ball"]] = sorted({r["cuts"][round(i * MAX_RINGS / rings) - 1] for i in range(1, rings)})
    return placed, pivots, cuts


def with_ring(placed: DataFrame, cuts: list) -> DataFrame:
    """Adds ``ring``: the number of the ball's cuts below the row's distance to the pivot."""
    table = [(i, [float(x) for x in c]) for i, c in enumerate(cuts)]
    known = F.broadcast(placed.sparkSession.createDataFrame(table, "ball int, cuts array<double>"))  # MAX_BALLS rows
    below = F.size(F.filter("cuts", lambda c: c < F.col("reach")))
    return placed.join(known, "ball").withColumn("ring", below).drop("cuts")


class Layout:
    """Rows, distinct positions, their balls and rings, stored once for several questions."""

    def __init__(self, points: DataFrame, key: str = "id", vec: str = "features", known: tuple[DataFrame, DataFrame] | None = None):
        self.rows, places = known or folded(points, key, vec)
        placed, self.pivots, self.cuts = into_rings(places)
        self.places = with_ring(placed, self.cuts)
        self.rings, self.members = self.of(self.places)

    def of(self, places: DataFrame) -> tuple[Rings, DataFrame]:
        """Bounds and blocks of some of the positions."""
        rings = rings_of(places, self.pivots, self.cuts)
        return rings, with_block(places, rings)

    def counts_within(self, eps: float, enough: int | None = None) -> DataFrame:
        return counts_within(self.places, self.rings, self.members, eps)

    def links_within(self, cores: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
        """((pos, first, node) of the cores, their links)."""
        self.cores = self.of(cores)
        return cores.select("pos", "first", F.col("pos").alias("node")), links_within(cores, *self.cores, eps)

    def least_within(self, asking: DataFrame, found: DataFrame, eps: float) -> DataFrame:
        """The smallest ``c`` found (pos, c) for a core within ``eps``."""
        rings, members = self.cores
        return least_within(asking, rings, members.join(found, "pos"), eps)


def rings_of(members: DataFrame, pivots, cuts) -> Rings:
    """Bounds of the rings of (ball, ring, reach, w); at most MAX_BALLS x MAX_RINGS rows come back."""
    stats = members.groupBy("ball", "ring").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.min("reach").alias("low"), F.max("reach").alias("high")
    )
    return Rings(pivots, cuts, stats.collect())


def with_block(members: DataFrame, rings: Rings) -> DataFrame:
    """Members with (slot, sub): their ring's number and a bounded block of it."""
    table = [(b, r, i, int(rings.blocks[i])) for (b, r), i in rings.slot.items()]
    slots = members.sparkSession.createDataFrame(table, "ball int, ring int, slot int, blocks int")
    placed = members.join(F.broadcast(slots), ["ball", "ring"])  # at most MAX_BALLS x MAX_RINGS rows
    return placed.withColumn("sub", F.pmod(F.xxhash64("pos"), F.col("blocks")).cast("int"))


def meet(queries: DataFrame, members: DataFrame, fn, schema: str) -> DataFrame:
    """Runs ``fn(queries, members)`` for each block and bounded share of the queries sent to it."""
    share = queries.groupBy("slot", "sub").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).cast("int").alias("chunks"))
    share = materialize(share, "shares")
    asked = queries.join(share, ["slot", "sub"]).withColumn("chunk", F.pmod(F.xxhash64("pos"), F.col("chunks")).cast("int"))
    there = members.join(share, ["slot", "sub"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keys = ["slot", "sub", "chunk"]
    return asked.drop("chunks").groupBy(*keys).cogroup(there.drop("chunks").groupBy(*keys)).applyInPandas(fn, schema)


def crowded(queries: DataFrame, rings: Rings, eps: float) -> bool:
    """Do the mixed rings of all queries hold a large share of all pairs?"""
    sent = queries.sparkSession.sparkContext.broadcast(rings)

    def visits(batches):
        r = sent.value
        step = max(1, 4_000_000 // max(1, len(r.ball)))
        for b in batches:
            for at in range(0, len(b), step):
                _, _, (_, slot) = r.sort_out(stack(b["vec"].iloc[at : at + step]), eps)
                yield pd.DataFrame({"asked": [len(b.iloc[at : at + step])], "blocks": [int(r.blocks[slot].sum())]})

    met = queries.select("vec").mapInPandas(visits, "asked bigint, blocks bigint").agg(F.sum("asked"), F.sum("blocks")).first()
    blocks = int(rings.blocks.sum())
    return blocks > MIN_BLOCKS and (met[1] or 0) * GRID_SHARE > (met[0] or 0) * blocks


def in_grid(queries: DataFrame, members: DataFrame, columns: list[str], rings: Rings, fn, schema: str) -> DataFrame:
    """``fn`` on all bounded blocks of queries (pos, vec) and members (pos, vec and ``columns``)."""
    asked, n, dims = queries.count(), members.count(), rings.pivots.shape[1]
    chunks, blocks = max(1, math.ceil(asked / GRID_QUERIES)), max(1, math.ceil(n * dims * 8 / GRID_BYTES))
    asking, there = (df.select(*[F.col(c).alias(c) for c in ["pos", "vec", *more]]) for df, more in ((queries, []), (members, columns)))
    return grid(asking, there, ["pos"], ["pos"], chunks, blocks, fn, schema)


def tiles_within(a, b, eps: float):
    """(i, j, whether a[i + r] and b[j + c] lie within ``eps``) for tiles of all pairs, as ``pair_distances`` has it."""
    own_a, own_b = np.isfinite(a).all(1), np.isfinite(b).all(1)
    near = Rounded(np.where(own_a[:, None], a, 0.0), np.where(own_b[:, None], b, 0.0), "euclidean")
    at = near.of(eps)
    for i in range(0, len(a), near.rows):
        ia = slice(i, i + near.rows)
        for j in range(0, len(b), near.cols):
            jb = slice(j, j + near.cols)
            tile, slack = near.tile(i, j), near.slack[ia, None] + 1e-6 * at
            if near.kind == "plain":
                hit = tile <= eps
            else:
                hit = tile <= (at + slack).astype("float32")
                r, c = np.divmod(np.flatnonzero(hit & (tile >= (at - slack).astype("float32"))), hit.shape[1])
                hit[r, c] = listed_distances(a[ia], b[jb], r, c, "euclidean") <= eps
            yield i, j, hit & own_a[ia, None] & own_b[None, jb]


def routes(queries: DataFrame, rings: Rings, eps: float, local, columns: str) -> DataFrame:
    """Runs ``local(batch, whole balls, whole rings)`` on queries (pos, vec) and sends them on.

    The result has the columns of ``local``'s frame and, in rows with ``slot``, (pos, vec, slot, sub)
    for each block of a mixed ring.
    """
    sent = queries.sparkSession.sparkContext.broadcast(rings)

    def run(batches):
        r = sent.value
        for b in batches:
            step = max(1, 4_000_000 // max(1, len(r.pivots), len(r.ball)))
            for at in range(0, len(b), step):
                part = b.iloc[at : at + step]
                whole, inside, (q, slot) = r.sort_out(stack(part["vec"]), eps)
                yield local(part, r, whole, inside)
                size = r.blocks[slot]
                q, slot, sub = np.repeat(q, size), np.repeat(slot, size), spread(np.zeros(len(size), int), size)
                rows = max(1, ROUTE_VALUES // r.pivots.shape[1])
                for first in range(0, len(q), rows):
                    s = slice(first, first + rows)
                    yield pd.DataFrame({"pos": part["pos"].to_numpy()[q[s]], "vec": part["vec"].to_numpy()[q[s]], "slot": slot[s], "sub": sub[s]})

    names = [c.split()[0] for c in columns.split(", ")]

    def filled(batches):
        for frame in run(batches):
            if len(frame):
                frame = frame if "vec" in frame else frame.assign(vec=None)
                yield frame.reindex(columns=[*names, "vec", "slot", "sub"]).astype({c: "Int64" for c in [*names, "slot", "sub"]})

    return queries.select("pos", "vec").mapInPandas(filled, f"{columns}, vec array<double>, slot int, sub int")


def counts_within(places: DataFrame, rings: Rings, members: DataFrame, eps: float) -> DataFrame:
    """(pos, c): weight of all members within ``eps`` of each place."""
    if crowded(places, rings, eps):
        def total(q, m):
            c, w = np.zeros(len(q), np.int64), m["w"].to_numpy() if len(m) else None
            for i, j, hit in tiles_within(stack(q["vec"]), stack(m["vec"]), eps) if len(q) and len(m) else ():
                c[i : i + len(hit)] += hit @ w[j : j + hit.shape[1]]
            return pd.DataFrame({"pos": q["pos"].to_numpy(), "c": c})

        return in_grid(places, members, ["w"], rings, total, "pos bigint, c bigint").groupBy("pos").agg(F.sum("c").alias("c"))

    def local(part, r, whole, inside):
        c = whole @ r.ball_weight
        np.add.at(c, inside[0], r.weight[inside[1]])
        return pd.DataFrame({"pos": part["pos"].to_numpy(), "c": c})

    sent = materialize(routes(places, rings, eps, local, "pos bigint, c bigint"), "count-routes")

    def count(q, m):
        if not len(q) or not len(m):
            return pd.DataFrame({"pos": [], "c": []})
        d = pair_distances(stack(q["vec"]), stack(m["vec"]), "euclidean")
        return pd.DataFrame({"pos": q["pos"].to_numpy(), "c": (d <= eps) @ m["w"].to_numpy()})

    met = meet(sent.where("slot IS NOT NULL").select("pos", "vec", "slot", "sub"), members.select("slot", "sub", "w", "vec"), count, "pos bigint, c bigint")
    return sent.where("slot IS NULL").select("pos", "c").unionByName(met).groupBy("pos").agg(F.sum("c").alias("c"))


def components(a, b, n: int):
    """Smallest node of each node's component, for edges between nodes 0 to n - 1."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label[label] != label).any():
            label = label[label]


def rooted(a, b, n: int):
    """Edges from each node to the smallest one of its component, that connect what the given edges do."""
    label = components(a, b, n)
    own = np.flatnonzero(label != np.arange(n))
    return label[own], own


def stars(nodes, a, b):
    """(src, dst) that connect what edges between nodes a and b connect; at most one for each node."""
    nodes, place = np.unique(np.concatenate([nodes[a], nodes[b]]), return_inverse=True)
    label = components(place[: len(a)], place[len(a) :], len(nodes))
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[own]], nodes[own]


def links_within(cores: DataFrame, rings: Rings, members: DataFrame, eps: float) -> DataFrame:
    """(src, dst): enough links to connect all members that a chain of steps within ``eps`` connects.

    A ball or ring that lies whole within ``eps`` of some member is one node (a negative number) to
    which all its members are linked.
    """
    if crowded(cores, rings, eps):
        def forest(q, m):
            if not len(q) or not len(m):
                return pd.DataFrame({"src": [], "dst": []})
            nodes = np.concatenate([q["pos"].to_numpy(), m["pos"].to_numpy()])
            src, dst, held = [], [], 0
            for i, j, hit in tiles_within(stack(q["vec"]), stack(m["vec"]), eps):
                r, c = np.divmod(np.flatnonzero(hit), hit.shape[1])
                src, dst, held = [*src, r + i], [*dst, c + j + len(q)], held + len(r)
                if held > 4 * len(nodes):  # what the links found so far connect
                    src, dst = ([x] for x in rooted(np.concatenate(src), np.concatenate(dst), len(nodes)))
                    held = 0
            a, b = stars(nodes, np.concatenate(src), np.concatenate(dst))
            return pd.DataFrame({"src": a, "dst": b})

        return in_grid(cores, members, [], rings, forest, "src bigint, dst bigint")

    balls = len(rings.pivots)

    def local(part, r, whole, inside):
        q, ball = np.nonzero(whole)
        rows = np.concatenate([q, inside[0]])
        groups = -1 - np.concatenate([ball, balls + inside[1]])
        nodes = np.concatenate([part["pos"].to_numpy(), groups])
        src, dst = stars(nodes, rows, np.arange(len(groups)) + len(part))
        return pd.DataFrame({"src": src, "dst": dst})

    sent = routes(cores, rings, eps, local, "src bigint, dst bigint, pos bigint")
    sent = materialize(sent, "link-routes")

    def link(q, m):
        if not len(q) or not len(m):
            return pd.DataFrame({"src": [], "dst": []})
        d = pair_distances(stack(q["vec"]), stack(m["vec"]), "euclidean")
        i, j = np.nonzero(d <= eps)
        src, dst = stars(np.concatenate([q["pos"].to_numpy(), m["pos"].to_numpy()]), i, j + len(q))
        return pd.DataFrame({"src": src, "dst": dst})

    met = meet(sent.where("slot IS NOT NULL").select("pos", "vec", "slot", "sub"), members.select("slot", "sub", "pos", "vec"), link, "src bigint, dst bigint")
    local_links = sent.where("slot IS NULL").select("src", "dst")
    # groups that some member covers; at most MAX_BALLS x (MAX_RINGS + 1)
    covered = local_links.select(F.explode(F.array("src", "dst")).alias("g")).where("g < 0").distinct()
    groups = [-1 - F.col("ball").cast("bigint"), -1 - balls - F.col("slot").cast("bigint")]
    own = members.select("pos", F.explode(F.array(*groups)).alias("g")).join(F.broadcast(covered), "g")
    return local_links.unionByName(met).unionByName(own.select(F.col("g").alias("src"), F.col("pos").alias("dst")))


def least_within(places: DataFrame, rings: Rings, members: DataFrame, eps: float) -> DataFrame:
    """(pos, c): the smallest ``c`` of the members within ``eps`` of each place; places without one are absent."""
    none = np.iinfo(np.int64).max
    if crowded(places, rings, eps):
        def smallest(q, m):
            c, of = np.full(len(q), none), m["c"].to_numpy() if len(m) else None
            for i, j, hit in tiles_within(stack(q["vec"]), stack(m["vec"]), eps) if len(q) and len(m) else ():
                r, k = np.divmod(np.flatnonzero(hit), hit.shape[1])
                np.minimum.at(c, r + i, of[k + j])
            return pd.DataFrame({"pos": q["pos"].to_numpy()[c < none], "c": c[c < none]})

        return in_grid(places, members, ["c"], rings, smallest, "pos bigint, c bigint").groupBy("pos").agg(F.min("c").alias("c"))

    by_slot = np.full(len(rings.ball), none)
    for r in members.groupBy("slot").agg(F.min("c").alias("c")).collect():  # one row a ring
        by_slot[r["slot"]] = r["c"]
    by_ball = np.full(len(rings.pivots), none)
    np.minimum.at(by_ball, rings.ball, by_slot)

    def local(part, r, whole, inside):
        c = np.where(whole, by_ball, none).min(1, initial=none)
        np.minimum.at(c, inside[0], by_slot[inside[1]])
        found = c < none
        return pd.DataFrame({"pos": part["pos"].to_numpy()[found], "c": c[found]})

    sent = materialize(routes(places, rings, eps, local, "pos bigint, c bigint"), "least-routes")

    def least(q, m):
        if not len(q) or not len(m):
            return pd.DataFrame({"pos": [], "c": []})
        d = pair_distances(stack(q["vec"]), stack(m["vec"]), "euclidean")
        c = np.where(d <= eps, m["c"].to_numpy(), none).min(1)
        return pd.DataFrame({"pos": q["pos"].to_numpy()[c < none], "c": c[c < none]})

    met = meet(sent.where("slot IS NOT NULL").select("pos", "vec", "slot", "sub"), members.select("slot", "sub", "c", "vec"), least, "pos bigint, c bigint")
    return sent.where("slot IS NULL").select("pos", "c").unionByName(met).groupBy("pos").agg(F.min("c").alias("c"))


def eps_pairs(places: DataFrame, rings: Rings, members: DataFrame, eps: float) -> DataFrame:
    """All pairs of distinct positions within ``eps``: (id_a, id_b, copies_a, copies_b, distance).

    The pairs are the result here, so every ring in reach is met, whole or not.
    """
    kind = places.schema["first"].dataType.simpleString()

    def pairs(q, m):
        empty = pd.DataFrame({"id_a": [], "id_b": [], "copies_a": [], "copies_b": [], "distance": []})
        if not len(q) or not len(m):
            return empty
        d = pair_distances(stack(q["vec"]), stack(m["vec"]), "euclidean")
        i, j = np.nonzero((d <= eps) & (q["first"].to_numpy()[:, None] < m["first"].to_numpy()[None, :]))
        return pd.DataFrame({"id_a": q["first"].to_numpy()[i], "id_b": m["first"].to_numpy()[j], "copies_a": q["w"].to_numpy()[i], "copies_b": m["w"].to_numpy()[j], "distance": d[i, j]})

    def local(part, r, whole, inside):
        # whole balls and rings are sent on like the mixed ones
        q, ball = np.nonzero(whole)
        size = r.first[ball + 1] - r.first[ball]
        q, slot = np.concatenate([np.repeat(q, size), inside[0]]), np.concatenate([spread(r.first[ball], size), inside[1]])
        size = r.blocks[slot]
        q, sub = np.repeat(q, size), spread(np.zeros(len(size), int), size)
        return pd.DataFrame({"pos": part["pos"].to_numpy()[q], "vec": part["vec"].to_numpy()[q], "slot": np.repeat(slot, size), "sub": sub})

    sent = routes(places, rings, eps, local, "pos bigint")
    asked = sent.join(places.select("pos", "first", "w"), "pos")
    there = members.select("slot", "sub", "first", "w", "vec")
    return meet(asked, there, pairs, f"id_a {kind}, id_b {kind}, copies_a bigint, copies_b bigint, distance double")
