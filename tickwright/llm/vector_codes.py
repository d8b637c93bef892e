"""Codes of vectors from one small codebook for each part, by dual-tree Lloyd rounds.

Components become integers, vectors are cut into equal parts, and every part position has its own
codebook. A task reads vectors in blocks. For each part position it builds a tree over the block's
parts (halved at the widest side, with boxes and cached sums) and a tree over the codebook's
entries, and descends both together: a pair of nodes goes when another pair of the same part node
must be nearer, by the distance bounds of their boxes and, between two entries, by the one corner
of the box where the nearer could lose. A part node with one entry left is assigned whole, its
cached sum is added; in leaves with several left the integer distances decide, ties to the lower
index. All bounds are integers, so the result is that of comparing every part with every entry.

Spark adds the tasks' sums of each (part, entry); codebooks of ``parts`` x ``entries`` entries are
all that the driver and the tasks exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwright.session import materialize

SCALE = 256
# components from here on have squared distances that a long cannot hold
LARGEST = float(1 << 18)
BLOCK_NUMBERS = 1 << 20
LEAF = 16
LABELS_SENT = 100_000


class Halves:
    """Points in the order of a tree that halves its nodes; node i of a level is a range of them."""

    def __init__(self, points: np.ndarray, leaf: int):
        n, d = points.shape
        self.depth = max(0, int(np.log2(max(n // leaf, 1))))
        self.order = np.arange(n)
        self.bounds, self.low, self.high = [], [], []
        for level in range(self.depth + 1):
            bounds = (np.arange((1 << level) + 1) * n) >> level
            low, high = np.minimum.reduceat(points, bounds[:-1]), np.maximum.reduceat(points, bounds[:-1])
            self.bounds.append(bounds), self.low.append(low), self.high.append(high)
            if level < self.depth:
                size = np.diff(bounds)
                side = np.repeat((high - low).argmax(1), size)
                sort = np.lexsort((points[np.arange(n), side], np.repeat(np.arange(1 << level), size)))
                points, self.order = points[sort], self.order[sort]
        self.points = points
        self.sums = np.concatenate([np.zeros((1, d), np.int64), np.cumsum(points, axis=0)])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] numbers), starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def first_of(owner: np.ndarray) -> np.ndarray:
    """Places where a sorted array begins a new value."""
    return np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, np.int64)


def nearest_corner(tree: Halves, level: int, node: np.ndarray, entry: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Pairs (part node, entry) that may hold the nearest entry of a part; ``node`` is sorted."""
    low, high = tree.low[level][node], tree.high[level][node]
    middle = ((low + high - 2 * entries[entry]) ** 2).sum(1)
    start = first_of(node)
    sizes = np.diff(np.append(start, len(node)))
    best = np.repeat(np.minimum.reduceat(middle, start), sizes) == middle
    place = np.flatnonzero(best)
    chosen = np.repeat(entry[place[first_of(node[place])]], sizes)
    mine, other = entries[chosen], entries[entry]
    # where in the box the chosen entry does worst against the other one
    corner = np.where(mine > other, low, high)
    margin = (mine * mine - other * other - 2 * corner * (mine - other)).sum(1)
    return (entry == chosen) | (margin > 0) | ((margin == 0) & (entry < chosen))


def assign(tree: Halves, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry of each part in tree order, parts of each entry, their sums, parts that were compared one by one)."""
    k, d = entries.shape
    forest = Halves(entries, 1)
    label = np.empty(len(tree.points), np.int64)
    counts, sums = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
    node, other, level, depth = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    single = False
    while True:
        if single:
            pass
        elif depth < forest.depth:
            node, other = np.repeat(node, 2), np.stack([2 * other, 2 * other + 1], 1).ravel()
            depth += 1
        else:  # the leaves' own entries
            bounds = forest.bounds[depth]
            size = bounds[other + 1] - bounds[other]
            node, other, single = np.repeat(node, size), forest.order[spread(bounds[other], size)], True
            sort = np.lexsort((other, node))
            node, other = node[sort], other[sort]
        low, high = tree.low[level][node], tree.high[level][node]
        if single:
            from_low = from_high = entries[other]
        else:
            from_low, from_high = forest.low[depth][other], forest.high[depth][other]
        gap = np.maximum(np.maximum(from_low - high, low - from_high), 0)
        reach = np.maximum(high - from_low, from_high - low)
        start = first_of(node)
        most = np.minimum.reduceat((reach * reach).sum(1), start)
        keep = (gap * gap).sum(1) <= np.repeat(most, np.diff(np.append(start, len(node))))
        node, other = node[keep], other[keep]
        if single:
            keep = nearest_corner(tree, level, node, other, entries)
            node, other = node[keep], other[keep]
            start = first_of(node)
            alone = np.diff(np.append(start, len(node))) == 1
            if alone.any():
                done, to, bounds = node[start[alone]], other[start[alone]], tree.bounds[level]
                a, b = bounds[done], bounds[done + 1]
                label[spread(a, b - a)] = np.repeat(to, b - a)
                np.add.at(counts, to, b - a)
                np.add.at(sums, to, tree.sums[b] - tree.sums[a])
                keep = np.repeat(~alone, np.diff(np.append(start, len(node))))
                node, other = node[keep], other[keep]
            if not len(node) or level == tree.depth:
                break
        if level < tree.depth:
            start = first_of(node)
            sizes = np.diff(np.append(start, len(node)))
            # both halves of each node, each with all that is left to it
            again = np.repeat(start, 2), np.repeat(sizes, 2)
            node, other = np.repeat(np.stack([2 * node[start], 2 * node[start] + 1], 1).ravel(), again[1]), other[spread(*again)]
            level += 1
    if not len(node):
        return label, counts, sums, 0
    start, bounds = first_of(node), tree.bounds[level]
    choices = np.diff(np.append(start, len(node)))
    left = node[start]
    size = bounds[left + 1] - bounds[left]
    part = spread(bounds[left], size)
    many = np.repeat(choices, size)
    owner, entry = np.repeat(part, many), other[spread(np.repeat(start, size), many)]
    distance = ((tree.points[owner] - entries[entry]) ** 2).sum(1)
    least = np.repeat(np.minimum.reduceat(distance, first_of(owner)), many)
    place = np.flatnonzero(distance == least)
    place = place[first_of(owner[place])]
    label[part] = entry[place]
    np.add.at(counts, entry[place], 1)
    np.add.at(sums, entry[place], tree.points[part])
    return label, counts, sums, len(part)


def blocks(batches, dims: int):
    """(arrow columns, integer components) of the batches, in blocks of bounded size."""
    rows = max(LEAF, BLOCK_NUMBERS // dims)
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            held.append(piece)
            size += piece.num_rows
            if size >= rows:
                yield whole(pa.Table.from_batches(held), dims)
                held, size = [], 0
    if size:
        yield whole(pa.Table.from_batches(held), dims)


def whole(table, dims: int):
    table = table.combine_chunks()
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return table, np.floor(SCALE * flat.astype(np.float64)).astype(np.int64).reshape(-1, dims)


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    """((id, vector, label) that take part, components of a vector)."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    rows = rows.where((F.size("vector") > 0) & (F.size("vector") % parts == 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").select(F.size("vector")).first()
    dims = first[0] if first else parts
    return rows.where(F.size("vector") == dims), dims


def lloyd_round(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, component) after one round over all rows."""
    import pyarrow as pa

    parts, entries, width = books.shape

    def run(batches):
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for _, numbers in blocks(batches, parts * width):
            for p in range(parts):
                _, n, s, _ = assign(Halves(numbers[:, p * width : (p + 1) * width], LEAF), books[p])
                counts[p] += n
                sums[p] += s
        part, entry = np.nonzero(counts)
        if len(part):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(sums[part, entry].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), lists], ["part", "entry", "n", "sums"])

    found = rows.select("vector").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    books = books.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact).collect():
        books[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of each row."""
    import pyarrow as pa

    parts, _, width = books.shape
    digits = np.array([f"{i:02x}" for i in range(256)], "S2")

    def run(batches):
        for table, numbers in blocks(batches, parts * width):
            codes, error = np.empty((len(numbers), parts), np.int64), np.zeros(len(numbers), np.int64)
            for p in range(parts):
                tree = Halves(numbers[:, p * width : (p + 1) * width], LEAF)
                label = assign(tree, books[p])[0]
                codes[tree.order, p] = label
                error[tree.order] += ((tree.points - books[p][label]) ** 2).sum(1)
            text = digits[codes].view(f"S{2 * parts}").ravel().astype(f"U{2 * parts}")
            ready = pa.table([table.column("id"), table.column("label"), pa.array(text), pa.array(error)], ["id", "label", "code", "error"])
            yield from ready.combine_chunks().to_batches()

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    labels_sent: int = LABELS_SENT,
) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error, label_error) of each vector, codebooks by part, entry, component).

    A vector takes part unless it is null, holds a null or non-finite component or one of 2^18 or
    more either way (its squared distances exceed a long), or cannot be cut into ``parts`` equal
    parts; vectors of another length than that of the smallest id are left out too. Codebooks begin
    as the vectors of the ``entries`` smallest ids (null ids last, equal ids by components), fewer
    if there are fewer. Rows that repeat are coded each. ``label_error`` sums ``error`` over rows
    of equal label, nulls together, and stops at the largest long. No rows give no codes and empty
    codebooks. At most 256 entries.
    """
    rows, dims = usable(vectors, id_col, vector_col, label_col, parts)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    books = np.array([[int(np.floor(SCALE * float(x))) for x in r["vector"]] for r in first], np.int64).reshape(len(first), parts, dims // parts).swapaxes(0, 1)
    if not first:
        kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
        return rows.sparkSession.createDataFrame([], f"id {kinds['id']}, label {kinds['label']}, code string, error bigint, label_error bigint"), books
    for _ in range(rounds):
        books = lloyd_round(rows, books)
    coded = materialize(encode(rows, books), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint")
    labels = materialize(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "label-errors")
    if labels.count() <= labels_sent:
        labels = F.broadcast(labels)
    return coded.join(labels, coded["label"].eqNullSafe(labels["of"])).drop("of"), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in order of part, entry and place, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
