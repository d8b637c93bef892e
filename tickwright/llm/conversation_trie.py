"""The prefix trie of conversations, by a splitter skeleton.

A conversation is a path of turns, each a 16-byte digest of its role and text, so byte order of
whole paths is the order of the trie and the members of a node are neighbours. Splitters, taken
from a sample of the paths, deal the sorted paths into shards. A node whose members lie in several
shards is a prefix of the splitter between them; these prefixes, the trie of the splitters' paths,
are the skeleton, which every task gets. A shard walks its sorted paths with one stack, finishes
every node outside the skeleton, and sends partial sums of the skeleton nodes that it meets. Their
reduction gives the skeleton's own rows and the parents of the nodes right below it.

Copies of one conversation are dealt by their id as well, so a group of any size is spread. Only
its list of ids has to be hashed in order: shards send it in pieces and one task reads the pieces
of a node as a stream. A conversation is one row of 16 bytes (and a word count) a turn, its texts
never move.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.session import materialize

KEY = 16
SHARD_BYTES = 64 << 20
SAMPLED = 32
# the skeleton goes to the driver and to every task: at most this many nodes
SKELETON_NODES = 1 << 18
SPLITTER_TURNS = 1024
CHUNK_BYTES = 1 << 20
WORDS = "[^\\x20\\x09-\\x0D]+"
NONE = hashlib.sha256(b"").hexdigest()

PARTS = (
    "kind int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string, node binary, parent binary, words bigint, shard int, seq bigint, chunk binary"
)
NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
DONE, PARTIAL, ENDS = 0, 1, 2


def turn_key(role: Column, text: Column) -> Column:
    """32 hex digits that stand for (role, text)."""
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)


def rebuild(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """(id, path, words) of each conversation from rows (conv_id, turn, role, text).

    A conversation c takes its first h = crc32(c) % ``heads`` turns from conversation c - c %
    ``group`` (as many as that one has) and the rest from its own turns after the first h. Turns
    are in order of ``turn``, null first; rows with equal turn are in order of their digest and
    each counts. Null role or text is the empty string. Rows without conv_id are left out, other
    columns are not read. ``path`` joins the turns' digests, ``words`` counts each turn's words.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        F.col("turn").isNotNull().alias("given"),
        F.coalesce("turn", F.lit(0)).cast("bigint").alias("turn"),
        turn_key(role, text).alias("key"),
        F.regexp_count(text, F.lit(WORDS)).alias("words"),
    )
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("id"), turn.alias("t"))
    rows = rows.withColumn("first", F.col("id") - F.col("id") % group)
    own = rows.repartition("first").groupBy("first", "id").agg(F.array_sort(F.collect_list("t")).alias("own"))
    lead = own.where("id = first").select("first", F.slice("own", 1, heads - 1).alias("lead"))
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % heads).cast("int")
    empty = F.slice("own", 1, 0)
    turns = F.concat(F.slice(F.coalesce("lead", empty), F.lit(1), h), F.slice("own", h + 1, F.size("own")))
    both = own.join(lead, "first", "left").select("id", turns.alias("t"))
    path = F.unhex(F.array_join(F.transform("t", lambda t: t["key"]), ""))
    return both.select("id", path.alias("path"), F.transform("t", lambda t: t["words"]).alias("words"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    most = min(len(a), len(b)) // KEY
    if a[: most * KEY] == b[: most * KEY]:
        return most
    low = 0
    while low < most:  # of the two halves look at the first that differs
        middle = (low + most) // 2
        if a[low * KEY : (middle + 1) * KEY] == b[low * KEY : (middle + 1) * KEY]:
            low = middle + 1
        else:
            most = middle
    return low


def skeleton_size(paths: list[bytes]) -> int:
    """Nodes of the trie of sorted paths, the root included."""
    return 1 + sum(len(b) // KEY - common(a, b) for a, b in zip([b"", *paths], paths))


def choose_splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """Sorted (path, id) that cut the paths into about ``shards`` equal parts.

    Paths are cut to the same number of turns, ``SPLITTER_TURNS`` at first, until their trie has at
    most ``SKELETON_NODES`` nodes. The sample only sets the sizes of the parts.
    """
    total = paths.count()
    share = min(1.0, shards * SAMPLED / max(total, 1))
    at_once = max(1, min(SPLITTER_TURNS, (1 << 22) // shards))
    chosen = paths.where(F.xxhash64("id").bitwiseAND((1 << 30) - 1) < int(share * (1 << 30)) + 1)
    step = max(1, round(min(total, shards * SAMPLED) / shards))
    # the sample has about SAMPLED rows a shard
    ordered = chosen.select(F.substring("path", 1, at_once * KEY).alias("path"), "id").selectExpr("path", "id", "row_number() OVER (ORDER BY path, id) AS r")
    cuts = [(bytes(r["path"]), r["id"]) for r in ordered.where(F.col("r") % step == 0).collect()]
    turns = at_once
    while turns and skeleton_size([p for p, _ in cuts]) > SKELETON_NODES:
        turns //= 2
        cuts = sorted({(p[: turns * KEY], i) for p, i in cuts})
    return cuts


class Node:
    __slots__ = ("children", "depth", "ends", "key", "leaves", "least", "n", "pending", "saved", "seq", "words")

    def __init__(self, depth: int, words: int, key: bytes | None):
        self.depth, self.words, self.key = depth, words, key
        self.n = self.children = self.leaves = self.saved = self.seq = 0
        self.least = None
        self.ends = None
        self.pending: list[tuple] = []


def node_key(path: bytes, depth: int) -> bytes:
    return hashlib.sha256(path[: depth * KEY]).digest()


class Walk:
    """One stack over the sorted paths of a shard; rows of ``PARTS`` collect in ``rows``."""

    def __init__(self, shard: int, cuts: list[tuple[bytes, int]]):
        self.shard = shard
        self.near = [cuts[i][0] for i in (shard - 1, shard) if 0 <= i < len(cuts)]
        self.rows: list[tuple] = []
        self.before = b""
        self.stack = [Node(0, 0, node_key(b"", 0))]

    def add(self, conv: int, path: bytes, words) -> None:
        shared = common(self.before, path)
        while len(self.stack) > shared + 1:
            self.close()
        if len(path) // KEY > shared:
            edge = max([common(path, cut) for cut in self.near], default=0)
            for depth in range(shared + 1, len(path) // KEY + 1):
                self.stack.append(Node(depth, words[depth - 1], node_key(path, depth) if depth <= edge else None))
        self.before = path
        top = self.stack[-1]
        top.n += 1
        top.least = conv if top.least is None else min(top.least, conv)
        name = str(conv).encode()
        if top.key is not None:
            top.ends = name if top.ends is None else top.ends + b"," + name
            if len(top.ends) >= CHUNK_BYTES:
                self.send_ends(top)
        elif top.ends is None:
            top.ends = hashlib.sha256(name)
        else:
            top.ends.update(b"," + name)

    def send_ends(self, v: Node) -> None:
        self.rows.append((ENDS, *[None] * 8, v.key, None, None, self.shard, v.seq, v.ends))
        v.seq, v.ends = v.seq + 1, None

    def close(self) -> None:
        v = self.stack.pop()
        up = self.stack[-1] if self.stack else None
        if up:
            up.n += v.n
            up.least = v.least if up.least is None else min(up.least, v.least)
        if v.key is not None:
            if v.ends is not None:
                self.send_ends(v)
            self.rows.append((PARTIAL, v.least, v.depth, None, v.n, v.children, v.leaves, v.saved, None, v.key, up.key if up else None, v.words, *[None] * 3))
            return
        self.rows += [(DONE, *row[:2], v.least, *row[2:], None, None, None, *[None] * 3) for row in v.pending]
        leaves, saved = v.leaves if v.children else 1, v.saved + (v.n - 1) * v.words
        row = v.least, v.depth, v.n, v.children, leaves, saved, v.ends.hexdigest() if v.ends else NONE
        up.children += 1
        up.leaves += leaves
        up.saved += saved
        if up.key is None:
            up.pending.append(row)
        else:
            self.rows.append((DONE, *row[:2], None, *row[2:], None, up.key, None, *[None] * 3))

    def finish(self) -> None:
        while self.stack:
            self.close()


def walk_shards(sorted_paths: DataFrame, cuts: list[tuple[bytes, int]]) -> DataFrame:
    import pyarrow as pa

    names = [x.split()[0] for x in PARTS.split(", ")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in PARTS.split(", ")])
    sent = sorted_paths.sparkSession.sparkContext.broadcast(cuts)

    def run(batches):
        def rows_of(walk):
            rows, walk.rows = walk.rows, []
            return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

        walk = None
        for batch in batches:
            for shard, conv, path, words in zip(*[batch.column(c).to_pylist() for c in ("shard", "id", "path", "words")]):
                if walk is None or walk.shard != shard:
                    if walk:
                        walk.finish()
                        yield rows_of(walk)
                    walk = Walk(shard, sent.value)
                walk.add(conv, path, words)
                if len(walk.rows) >= 4096:
                    yield rows_of(walk)
        if walk:
            walk.finish()
            yield rows_of(walk)

    return sorted_paths.mapInArrow(run, PARTS)


def hash_streams(chunks: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, shard, seq, chunk): each node's pieces as one stream, comma-joined."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for frame in frames:
            done = []
            for key, chunk in zip(frame["node"], frame["chunk"]):
                if key == node:
                    state.update(b"," + chunk)
                    continue
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256(chunk)
            if done:
                yield pd.DataFrame(done, columns=["node", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "ends_sha256"])

    ordered = chunks.select("node", "shard", "seq", "chunk").repartition("node").sortWithinPartitions("node", "shard", "seq")
    return ordered.mapInPandas(run, "node binary, ends_sha256 string")


def reduce_skeleton(parts: DataFrame) -> list[tuple]:
    """(node, *NODES) of the skeleton, from the deepest up. Its size has a bound, see ``choose_splitters``."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    ends = hash_streams(parts.where(F.col("kind") == ENDS))
    partial = parts.where(F.col("kind") == PARTIAL).groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), *sums)
    nodes = {bytes(r["node"]): r.asDict() for r in partial.join(ends, "node", "left").collect()}
    for v in nodes.values():
        if v["parent"] is not None:
            nodes[bytes(v["parent"])]["n_children"] += 1
    rows = []
    for key, v in sorted(nodes.items(), key=lambda x: -x[1]["depth"]):
        v["n_leaves"] += not v["n_children"]
        v["saved_tokens"] += (v["n_convs"] - 1) * v["words"]
        up = nodes[bytes(v["parent"])] if v["parent"] is not None else None
        if up:
            up["n_leaves"] += v["n_leaves"]
            up["saved_tokens"] += v["saved_tokens"]
        rows.append((key, v["conv_id"], v["depth"], up and up["conv_id"], v["n_convs"], v["n_children"], v["n_leaves"], v["saved_tokens"], v["ends_sha256"] or NONE))
    return rows


def prefix_trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """One row of (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256) for each node of the trie of the rebuilt conversations (see ``rebuild``).

    The root is there whenever a conversation is; an empty table has no nodes.
    """
    spark = conversations.sparkSession
    paths = materialize(rebuild(conversations), "paths")
    if not shards:
        size = paths.agg(F.sum(F.octet_length("path"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    cuts = choose_splitters(paths, shards)
    sent = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def shard_of(path: pd.Series, conv: pd.Series) -> pd.Series:
        return pd.Series([bisect_left(sent.value, pair) for pair in zip(path, conv)], dtype="int32")

    dealt = paths.withColumn("shard", shard_of("path", "id")).repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", "path", "id")
    parts = materialize(walk_shards(dealt, cuts), "trie-parts")
    types = "node binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    skeleton = spark.createDataFrame(reduce_skeleton(parts), types)
    above = F.broadcast(skeleton.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")))
    done = parts.where(F.col("kind") == DONE).join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return done.select(NODES).unionByName(skeleton.select(NODES))
