"""Random forests whose trees all grow together, one pass over the rows a level.

Features are cut into at most ``BINS`` quantile bins once. A row's bootstrap weight in a tree is a
Poisson(1) number hashed from its key and the tree, so every pass, every retry and the out-of-bag
vote see the same bags, and no bag is stored. Nodes with many rows are split level by level: tasks
fill histograms of (tree, node, feature, bin), Spark adds them up, and one best split a node comes
back. As soon as a node has at most ``local_rows`` rows its rows are sent to one task, which grows
the rest of that branch with the same code. The driver only starts levels, never a fit of one tree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwright.session import materialize

BINS = 32
LOCAL_ROWS = 20_000
# histogram numbers that a task holds at once
PASS_CELLS = 1 << 23
TREE = "tree int, node bigint, feature int, bin int, value double, n double, gain double"
NAMES = [c.split()[0] for c in TREE.split(", ")]
POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(25)])


def mixed(*keys) -> np.ndarray:
    """64 random-looking bits of integer keys."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in keys:
            out = out ^ (np.asarray(k).astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) + (out << np.uint64(6)) + (out >> np.uint64(2)))
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return out


def bag_weights(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Times that each row is in a tree's bag: Poisson(1), the same on every run."""
    u = (mixed(seed, tree, keys) >> np.uint64(11)).astype(float) / 2.0**53
    return np.searchsorted(POISSON, u, "right").astype(float)


def train_weights(keys: np.ndarray, folds: np.ndarray, tree: int, cfg: dict) -> np.ndarray:
    """Bag weights without the fold that the tree must not see."""
    w = bag_weights(keys, tree, cfg["seed"])
    return np.where(folds == tree % cfg["folds"], 0.0, w) if cfg["folds"] else w


def subsets(tree, nodes: np.ndarray, features: int, take: int, seed: int) -> np.ndarray:
    """The sorted features that each node may split on, by hash of (tree, node)."""
    if take >= features:
        return np.tile(np.arange(features), (len(nodes), 1))
    rank = mixed(seed + 1, np.asarray(tree)[..., None], nodes[:, None], np.arange(features)[None])
    return np.sort(np.argsort(rank, axis=1, kind="stable")[:, :take], axis=1)


def histograms(x, slot, stats, allowed) -> np.ndarray:
    """Sums of the rows' stats by (slot, allowed feature, bin)."""
    k, take = allowed.shape
    out = np.zeros((k, take, BINS, stats.shape[1]))
    at = np.arange(len(x))
    for j in range(take):
        cell = slot * BINS + x[at, allowed[slot, j]]
        for s in range(stats.shape[1]):
            out[:, j, :, s] = np.bincount(cell, stats[:, s], k * BINS).reshape(k, BINS)
    return out


def weight_of(stats, classes: int) -> np.ndarray:
    return stats.sum(-1) if classes else stats[..., 0]


def impurity(stats, classes: int, criterion: str) -> np.ndarray:
    """Gini or entropy of class sums; variance of (weight, sum, sum of squares)."""
    n = np.maximum(weight_of(stats, classes), 1e-300)
    if not classes:
        return np.maximum(stats[..., 2] / n - (stats[..., 1] / n) ** 2, 0.0)
    p = stats / n[..., None]
    if criterion == "entropy":
        return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(-1)
    return 1.0 - (p * p).sum(-1)


def best_splits(sums: np.ndarray, allowed: np.ndarray, classes: int, criterion: str, min_leaf: float):
    """(feature or -1, bin, gain) of each slot: rows up to the bin go left. Of equal gains the first
    feature and bin count; a slot that no split improves stays whole."""
    left = np.cumsum(sums, axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left
    n, nl, nr = weight_of(whole, classes), weight_of(left, classes), weight_of(right, classes)
    gain = impurity(whole, classes, criterion) - (nl * impurity(left, classes, criterion) + nr * impurity(right, classes, criterion)) / np.maximum(n, 1e-300)
    gain = np.round(np.where((nl >= min_leaf) & (nr >= min_leaf), gain, -1.0), 12).reshape(len(sums), -1)
    best = gain.argmax(1)
    top = gain[np.arange(len(sums)), best]
    feature = allowed[np.arange(len(sums)), best // BINS]
    return np.where(top > 0, feature, -1), best % BINS, top


def value_of(total: np.ndarray, classes: int) -> np.ndarray:
    if classes:
        return total.argmax(-1).astype(float)
    return total[..., 1] / np.maximum(total[..., 0], 1e-300)


def stats_of(y: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray:
    if classes:
        return np.eye(classes)[y.astype(int)] * w[:, None]
    return np.stack([w, w * y, w * y * y], 1)


def grow_branch(x, y, w, tree: int, node: int, cfg: dict) -> list[tuple]:
    """All nodes of a branch as rows of ``TREE``; leaves have feature -1."""
    stats = stats_of(y, w, cfg["classes"])
    ids, slot, rows = np.array([node], np.int64), np.zeros(len(x), np.int64), []
    while len(ids):
        total = np.stack([np.bincount(slot, stats[:, s], len(ids)) for s in range(stats.shape[1])], 1)
        n, value = weight_of(total, cfg["classes"]), value_of(total, cfg["classes"])
        feature = np.full(len(ids), -1)
        cut, gain = np.zeros(len(ids), int), np.zeros(len(ids))
        if int(ids[0]).bit_length() <= cfg["depth"]:
            step = max(1, PASS_CELLS // (cfg["take"] * BINS * stats.shape[1]))
            order = np.argsort(slot, kind="stable")
            bounds = np.searchsorted(slot[order], np.arange(0, len(ids) + step, step))
            for a, (p, q) in zip(range(0, len(ids), step), zip(bounds, bounds[1:])):
                part, own = slice(a, a + step), order[p:q]
                allowed = subsets(tree, ids[part], x.shape[1], cfg["take"], cfg["seed"])
                feature[part], cut[part], gain[part] = best_splits(histograms(x[own], slot[own] - a, stats[own], allowed), allowed, cfg["classes"], cfg["criterion"], cfg["min_leaf"])
        rows += zip([tree] * len(ids), ids.tolist(), feature.tolist(), cut.tolist(), value.tolist(), n.tolist(), np.where(feature >= 0, gain, 0.0).tolist())
        split = feature >= 0
        number = np.cumsum(split) - 1
        on = split[slot]
        x, stats, slot = x[on], stats[on], slot[on]
        right = x[np.arange(len(x)), feature[slot]] > cut[slot]
        slot = 2 * number[slot] + right
        ids = np.stack([2 * ids[split], 2 * ids[split] + 1], 1).ravel()
    return rows


class Forest:
    """Trees as flat arrays: at each place a feature (-1 in leaves), a bin, the left child, a value."""

    def __init__(self, table: pd.DataFrame, cuts: list, cfg: dict, key, features: str):
        self.cuts, self.cfg, self.key, self.features = cuts, cfg, key, features
        t = table.sort_values(["tree", "node"], kind="stable")
        tree, node = t["tree"].to_numpy(np.int64), t["node"].to_numpy(np.int64)
        self.tree, self.node = tree, node
        self.feature, self.bin = t["feature"].to_numpy(np.int32), t["bin"].to_numpy(np.int32)
        self.value, self.n, self.gain = (t[c].to_numpy(float) for c in ("value", "n", "gain"))
        self.roots = np.searchsorted(tree, np.arange(cfg["trees"]))
        self.left = np.zeros(len(t), np.int64)
        for k, (a, b) in enumerate(zip(self.roots, [*self.roots[1:], len(t)])):
            inner = a + np.flatnonzero(self.feature[a:b] >= 0)
            self.left[inner] = a + np.searchsorted(node[a:b], 2 * node[inner])

    @property
    def importances(self) -> np.ndarray:
        """Share of each feature in the weighted gains of a tree, averaged over the trees."""
        out = np.zeros((self.cfg["trees"], self.cfg["width"]))
        inner = self.feature >= 0
        np.add.at(out, (self.tree[inner], self.feature[inner]), (self.n * self.gain)[inner])
        out = out / np.maximum(out.sum(1, keepdims=True), 1e-300)
        return out.sum(0) / max(out.sum(), 1e-300)

    def tree_values(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        """Each tree's value (column) for binned rows, from its first ``depth`` levels of splits only
        if that is given: a tree grown to a smaller depth is the top of a deeper one."""
        out = np.empty((len(x), self.cfg["trees"]))
        for k, root in enumerate(self.roots):
            place, todo, level = np.full(len(x), root), np.arange(len(x)), 0
            while level != depth and len(todo := todo[self.feature[place[todo]] >= 0]):
                level += 1
                p = place[todo]
                place[todo] = self.left[p] + (x[todo, self.feature[p]] > self.bin[p])
            out[:, k] = self.value[place]
        return out

    def transform(self, df: DataFrame, out_of_bag: bool = False) -> DataFrame:
        """Adds ``prediction``, ``uncertainty`` (deviation of the trees' values) and ``votes`` (trees asked).

        Classes get the majority, the smaller class of equal ones. ``out_of_bag`` asks only trees
        whose bag lacks the row; a row in all bags has no prediction. All trees answer in one pass.
        """
        sent = df.sparkSession.sparkContext.broadcast(self)
        key = row_key(self.key) if out_of_bag else F.lit(0).cast("bigint")

        @F.pandas_udf("prediction double, uncertainty double, votes int")
        def answers(features: pd.Series, key: pd.Series) -> pd.DataFrame:
            m = sent.value
            values = m.tree_values(binned(features, m.cuts))
            asked = np.ones(values.shape, bool)
            if out_of_bag:
                asked = np.stack([bag_weights(key.to_numpy(), t, m.cfg["seed"]) == 0 for t in range(m.cfg["trees"])], 1)
            votes = asked.sum(1)
            if m.cfg["classes"]:
                tally = np.stack([((values == c) & asked).sum(1) for c in range(m.cfg["classes"])], 1)
                prediction, spread = tally.argmax(1).astype(float), 1.0 - tally.max(1) / np.maximum(votes, 1)
            else:
                n = np.maximum(votes, 1)
                prediction = (values * asked).sum(1) / n
                spread = np.sqrt((((values - prediction[:, None]) ** 2) * asked).sum(1) / n)
            none = votes == 0
            return pd.DataFrame({"prediction": pd.Series(prediction).mask(none), "uncertainty": pd.Series(spread).mask(none), "votes": votes.astype("int32")})

        named = df.withColumn("_a", answers(as_array(df, self.features), key))
        return named.withColumns({c: F.col(f"_a.{c}") for c in ("prediction", "uncertainty", "votes")}).drop("_a")


def out_of_fold(model: Forest, df: DataFrame, fold: str, depths: list[int], counts: list[int], label: str = "label") -> DataFrame:
    """(depth, trees, mse) over all rows, each predicted by trees that have not seen its fold.

    The trees of a model grown with ``folds`` stand for forests of every smaller depth and number
    of trees a fold, so the whole grid is scored in one pass.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def errors(batches):
        m = sent.value
        total, n = np.zeros((len(depths), len(counts))), 0
        for b in batches:
            if not len(b):
                continue
            x, y, own = binned(b["x"], m.cuts), b["y"].to_numpy(), b["f"].to_numpy()
            n += len(b)
            for i, depth in enumerate(depths):
                values = m.tree_values(x, depth).reshape(len(x), -1, m.cfg["folds"])
                mine = values[np.arange(len(x)), :, own]
                for j, count in enumerate(counts):
                    total[i, j] += ((mine[:, :count].mean(1) - y) ** 2).sum()
        yield pd.DataFrame([(d, c, total[i, j], n) for i, d in enumerate(depths) for j, c in enumerate(counts)], columns=["depth", "trees", "sse", "n"])

    rows = df.where(F.col(label).isNotNull()).select(as_array(df, model.features).alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("f"))
    sums = rows.mapInPandas(errors, "depth int, trees int, sse double, n bigint").groupBy("depth", "trees").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"))
    return sums.select("depth", "trees", F.try_divide("sse", "n").alias("mse"))


def row_key(key: str | tuple[str, ...]):
    return F.xxhash64(*[key] if isinstance(key, str) else key)


def as_array(df: DataFrame, features: str):
    if df.schema[features].dataType.typeName() == "array":
        return F.col(features).cast("array<double>")
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(features))


def binned(features: pd.Series, cuts: list) -> np.ndarray:
    """Bins of each row's features: the number of cuts below a value (NaN is above all)."""
    x = np.vstack(features.to_numpy()) if len(features) else np.empty((0, len(cuts)))
    return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1).astype(np.uint8)


def quantile_cuts(df: DataFrame, features, width: int) -> list[np.ndarray]:
    shares = [i / BINS for i in range(1, BINS)]
    row = df.select(features.alias("f")).agg(*[F.percentile_approx(F.col("f")[j], shares, 10_000).alias(f"c{j}") for j in range(width)]).first()
    return [np.unique([c for c in row[f"c{j}"] or [] if c is not None and c == c]) for j in range(width)]


def fit_forest(
    df: DataFrame,
    trees: int = 100,
    depth: int = 15,
    min_leaf: int = 1,
    take: int | None = None,
    classes: int = 0,
    criterion: str = "gini",
    seed: int = 42,
    features: str = "features",
    label: str = "label",
    key: str | tuple[str, ...] = "id",
    local_rows: int = LOCAL_ROWS,
    fold: str | None = None,
    folds: int = 0,
) -> Forest:
    """A forest of ``trees`` trees; ``take`` features a split (the root of their number unless given).

    ``classes`` > 0 grows classifiers of labels 0 to classes - 1, else regression trees. Rows with a
    NULL label or feature vector do not train. ``key`` decides a row's bags: rows of equal key share
    them. The model, at most trees x 2^depth nodes, comes to the driver. With ``fold``, a column of
    numbers below ``folds``, tree t trains without fold t % ``folds`` (see ``out_of_fold``).
    """
    array = as_array(df, features)
    rows = df.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    head = rows.select(F.size(array).alias("d")).first()
    width = head["d"] if head else 1
    cuts = quantile_cuts(rows, array, width)
    cfg = {"trees": trees, "depth": depth, "min_leaf": min_leaf, "take": min(width, take or max(1, int(math.sqrt(width)))), "classes": classes, "criterion": criterion, "seed": seed, "width": width, "folds": folds}

    def to_bins(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"h": b["h"], "x": [r.tobytes() for r in binned(b["x"], cuts)], "y": b["y"], "f": b["f"]})

    own_fold = F.col(fold).cast("int") if fold else F.lit(-1)
    plain = rows.select(row_key(key).alias("h"), array.alias("x"), F.col(label).cast("double").alias("y"), own_fold.alias("f"))
    data = materialize(plain.mapInPandas(to_bins, "h bigint, x binary, y double, f int"), "binned")
    n = data.count()
    frontier = {t: np.array([1], np.int64) for t in range(trees)} if n else {}
    done: list[tuple] = []  # inner nodes found by the passes over all rows
    level = {t: {1: n} for t in frontier}
    local: dict[int, list[int]] = {}
    while level:
        big = [(t, v) for t, nodes in level.items() for v, size in nodes.items() if size > local_rows and v.bit_length() <= depth]
        for t, nodes in level.items():
            local.setdefault(t, []).extend(v for v, size in nodes.items() if not (size > local_rows and v.bit_length() <= depth))
        level = {}
        step = max(1, PASS_CELLS // (cfg["take"] * BINS * (classes or 3)))
        for at in range(0, len(big), step):
            for r in split_pass(data, big[at : at + step], done, cfg).collect():
                if r["feature"] < 0:
                    local.setdefault(r["tree"], []).append(r["node"])
                    continue
                done.append(tuple(r[c] for c in NAMES))
                level.setdefault(r["tree"], {}).update({2 * r["node"]: r["rows_left"], 2 * r["node"] + 1: r["rows_right"]})
    inner = pd.DataFrame(done, columns=NAMES)
    branches = grow_branches(data, inner, local, cfg).toPandas() if n else pd.DataFrame(columns=NAMES)
    if not n:
        branches = pd.DataFrame([(t, 1, -1, 0, 0.0, 0.0, 0.0) for t in range(trees)], columns=NAMES)
    # a node whose bag holds none of its rows has no branch of its own
    return Forest(with_empty_leaves(pd.concat([inner, branches], ignore_index=True) if done else branches, trees), cuts, cfg, key, features)


def with_empty_leaves(table: pd.DataFrame, trees: int) -> pd.DataFrame:
    known = set(zip(table["tree"], table["node"]))
    inner = table[table["feature"] >= 0]
    wanted = {(t, v) for t, p in zip(inner["tree"], inner["node"]) for v in (2 * p, 2 * p + 1)} | {(t, 1) for t in range(trees)}
    missing = sorted(wanted - known)
    if not missing:
        return table
    above = dict(zip(zip(table["tree"], table["node"]), table["value"]))
    return pd.concat([table, pd.DataFrame([(t, v, -1, 0, above.get((t, v // 2), 0.0), 0.0, 0.0) for t, v in missing], columns=NAMES)], ignore_index=True)


class Frontier:
    """Finds the open node of each row: walks the inner nodes found so far."""

    def __init__(self, inner: list[tuple], opened: dict[int, list[int]]):
        self.inner: dict[int, dict] = {}
        for t, v, f, b, *_ in inner:
            self.inner.setdefault(t, {})[v] = (f, b)
        self.opened = {t: np.sort(np.array(v, np.int64)) for t, v in opened.items() if len(v)}
        self.flat = {}
        for t, nodes in self.inner.items():
            ids = np.sort(np.array(list(nodes), np.int64))
            self.flat[t] = ids, np.array([nodes[i][0] for i in ids.tolist()]), np.array([nodes[i][1] for i in ids.tolist()])

    def places(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, place of their open node in ``opened``) for rows that reach an open node."""
        node = np.ones(len(x), np.int64)
        if tree in self.flat:
            ids, feature, cut = self.flat[tree]
            todo = np.arange(len(x))
            while len(todo):
                at = np.minimum(np.searchsorted(ids, node[todo]), len(ids) - 1)
                todo, at = todo[ids[at] == node[todo]], at[ids[at] == node[todo]]
                node[todo] = 2 * node[todo] + (x[todo, feature[at]] > cut[at])
        opened = self.opened[tree]
        at = np.minimum(np.searchsorted(opened, node), len(opened) - 1)
        rows = np.flatnonzero(opened[at] == node)
        return rows, at[rows]


def matrix_of(x: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)


def split_pass(data: DataFrame, big: list[tuple[int, int]], done: list[tuple], cfg: dict) -> DataFrame:
    """The best split of each open (tree, node), from one pass over all rows."""
    opened: dict[int, list[int]] = {}
    for t, v in big:
        opened.setdefault(t, []).append(v)
    sent = data.sparkSession.sparkContext.broadcast(Frontier(done, opened))

    def count(batches):
        f = sent.value
        sums: dict[int, np.ndarray] = {}
        rows_in: dict[int, np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            x, keys, y, own = matrix_of(b["x"]), b["h"].to_numpy(), b["y"].to_numpy(), b["f"].to_numpy()
            for t, nodes in f.opened.items():
                rows, slot = f.places(x, t)
                w = train_weights(keys[rows], own[rows], t, cfg)
                rows, slot, w = rows[w > 0], slot[w > 0], w[w > 0]
                allowed = subsets(t, nodes, cfg["width"], cfg["take"], cfg["seed"])
                found = histograms(x[rows], slot, stats_of(y[rows], w, cfg["classes"]), allowed)
                number = histograms(x[rows], slot, np.ones((len(rows), 1)), allowed)
                sums[t] = sums.get(t, 0) + found
                rows_in[t] = rows_in.get(t, 0) + number
        for t in sums:
            k = len(sums[t])
            yield pd.DataFrame({"tree": t, "node": f.opened[t], "sums": list(sums[t].reshape(k, -1)), "rows": list(rows_in[t].reshape(k, -1))})

    def choose(batches):
        totals: dict[tuple[int, int], list] = {}
        for b in batches:
            for t, v, s, r in zip(b["tree"], b["node"], b["sums"], b["rows"]):
                own = totals.setdefault((t, v), [0.0, 0.0])
                own[0], own[1] = own[0] + np.asarray(s), own[1] + np.asarray(r)
        out = []
        for (t, v), (s, r) in totals.items():
            allowed = subsets(t, np.array([v]), cfg["width"], cfg["take"], cfg["seed"])
            s, r = s.reshape(1, cfg["take"], BINS, -1), r.reshape(cfg["take"], BINS)
            feature, cut, gain = best_splits(s, allowed, cfg["classes"], cfg["criterion"], cfg["min_leaf"])
            total = s[0, 0].sum(0)
            j = int(np.flatnonzero(allowed[0] == feature[0])[0]) if feature[0] >= 0 else 0
            left = int(r[j, : cut[0] + 1].sum())
            out.append((t, v, int(feature[0]), int(cut[0]), float(value_of(total, cfg["classes"])), float(weight_of(total, cfg["classes"])), float(gain[0]), left, int(r[j].sum()) - left))
        if out:
            yield pd.DataFrame(out, columns=[*NAMES, "rows_left", "rows_right"])

    counted = data.mapInPandas(count, "tree int, node bigint, sums array<double>, rows array<double>")
    return counted.repartition("tree", "node").mapInPandas(choose, f"{TREE}, rows_left bigint, rows_right bigint")


def grow_branches(data: DataFrame, inner: pd.DataFrame, opened: dict[int, list[int]], cfg: dict) -> DataFrame:
    """Sends the bagged rows of each open node to one task that grows its branch."""
    sent = data.sparkSession.sparkContext.broadcast(Frontier(list(inner.itertuples(index=False, name=None)), opened))

    def deal(batches):
        f = sent.value
        for b in batches:
            if not len(b):
                continue
            x, keys, own = matrix_of(b["x"]), b["h"].to_numpy(), b["f"].to_numpy()
            for t, nodes in f.opened.items():
                rows, at = f.places(x, t)
                w = train_weights(keys[rows], own[rows], t, cfg)
                rows, at, w = rows[w > 0], at[w > 0], w[w > 0]
                yield pd.DataFrame({"tree": np.int32(t), "node": nodes[at], "x": b["x"].to_numpy()[rows], "y": b["y"].to_numpy()[rows], "w": w})

    def grow(group):
        first = group.iloc[0]
        # the same rows in any order give the same sums only up to rounding; order them
        x, y, w = matrix_of(group["x"]), group["y"].to_numpy(), group["w"].to_numpy()
        order = np.lexsort((w, y, *x.T[:4]))
        return pd.DataFrame(grow_branch(x[order], y[order], w[order], int(first["tree"]), int(first["node"]), cfg), columns=NAMES)

    dealt = data.mapInPandas(deal, "tree int, node bigint, x binary, y double, w double")
    return dealt.groupBy("tree", "node").applyInPandas(grow, TREE)
