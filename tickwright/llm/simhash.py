"""Near-duplicate documents by 64-bit similarity fingerprints.

Fingerprints link at ``BITS`` (4) or fewer differing bits, so linked ones agree in at least four
of their eight bytes. That is the guaranteed minimum of the count filter. The inverted index is
built over byte positions: a list holds the distinct fingerprints with given bytes at three given
positions, and the position triples are chosen so that any four positions contain one of them.
Fingerprints that meet in a list are tallied over all eight bytes, pairs below the minimum go, and
the rest are verified by their bits.

Equal fingerprints are one entry of the index, so copies cost nothing. Long lists are cut into
blocks and each pair of blocks is a group of its own, so no task holds more than two blocks. A
group returns a spanning forest of its links, never all pairs. Components come from rounds of
minimum labels, each written to the shared folder.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.llm.text import stored
from tickwright.operators.cluster import connected_components
from tickwright.session import materialize

SHINGLE = 4
HASH_SEED = 42
BITS = 4
MIN_BYTES = 8 - BITS
BLOCK = 2048
CHUNK = 1 << 16


def position_triples() -> list[tuple[int, int, int]]:
    """Triples of the eight byte positions such that every four positions contain one.

    Positions lie in three classes on a ring; a triple lies in one class, or has two in one class
    and one in the next. Four positions always have three in a class or two beside a next one.
    """
    return [t for t in combinations(range(8), 3) if len({p % 3 for p in t}) == 1 or any([p % 3 for p in t].count(k) == 2 and (k + 1) % 3 in [p % 3 for p in t] for k in range(3))]


TRIPLES = position_triples()


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint; zero without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        starts = [0, len(joined) + 1]
        step = 1
    else:
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))
        step = width
    n = len(starts) - step
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for begin in range(0, n, CHUNK):
        end = min(n, begin + CHUNK)
        hashes = np.array([digest(joined[a : b - 1], HASH_SEED) for a, b in zip(starts[begin:end], starts[begin + step : end + step])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", width: int = SHINGLE, name: str = "fp") -> DataFrame:
    """All columns of ``docs`` and the fingerprint; only the text goes to Python."""
    from collections.abc import Iterator

    import pandas as pd

    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, width) for t in texts.tolist()], dtype="int64")

    prints.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(name, F.pandas_udf(prints, "long")(F.col(text_col)))


def list_keys(fp: Column) -> Column:
    """Keys of the lists that a fingerprint belongs to."""
    byte = [F.shiftrightunsigned(fp, 8 * k).bitwiseAND(255) for k in range(8)]
    return F.array(*[F.lit(i << 24) + byte[a] * 65_536 + byte[b] * 256 + byte[c] for i, (a, b, c) in enumerate(TRIPLES)])


def forest(prints: np.ndarray, block: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all links connect. Within a pair of blocks only links across count
    (links inside a block are found where the block meets itself)."""
    order = np.argsort(prints)
    prints, block = prints[order], block[order]
    across = bool(block.any()) and not block.all()
    unsigned = prints.view(np.uint64)
    label = np.arange(len(prints))
    out = []
    for r in range(1, len(prints)):
        diff = unsigned[:r] ^ unsigned[r]
        shared = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        near = np.flatnonzero((shared >= MIN_BYTES) & ((block[:r] != block[r]) if across else True))
        near = near[np.bitwise_count(diff[near]) <= BITS]
        if len(near):
            roots, first = np.unique(label[near], return_index=True)
            out += [(int(prints[near[k]]), int(prints[r])) for k, root in zip(first, roots) if root != label[r]]
            joined = np.isin(label, np.append(roots, label[r]))
            label[joined] = min(int(roots[0]), int(label[r]))
    return out


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(src, dst): enough links of the distinct fingerprints (fp) to connect all that are linked."""
    import pyarrow as pa

    postings = prints.select("fp", F.explode(list_keys(F.col("fp"))).alias("key"))
    sizes = materialize(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "list-sizes")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = postings.join(sizes, "key").withColumn("blocks", blocks).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "own")
    groups = rows.groupBy("key", "i", "j").agg(F.collect_list("fp").alias("fps"), F.collect_list((F.col("own") == F.col("j")) & (F.col("i") < F.col("j"))).alias("side"))

    def link(batches):
        for batch in batches:
            out = []
            for fps, side in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += forest(np.array(fps, np.int64), np.array(side))
            src, dst = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return groups.select("fps", "side").mapInArrow(link, "src bigint, dst bigint").distinct()


def fingerprint_components(rows: DataFrame) -> DataFrame:
    """(fp, label, component_id) of rows (id, fp): the smallest id that links reach."""
    prints = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    links = materialize(fingerprint_links(prints), "links")
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    labels = connected_components(nodes, links).select(F.col("node").alias("fp"), "label")
    prints = prints.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = prints.groupBy("label").agg(F.min("least").alias("component_id"))
    return materialize(prints.select("fp", "label").join(ids, "label").select("fp", "label", "component_id"), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    Null and empty texts have fingerprint zero and link to each other. Null ids never name a
    component unless it has no other. Repeated rows each get their row; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialize(with_fingerprints(rows, "text", width).select("id", "fp"), "document-fingerprints")
    found = fingerprint_components(rows)
    return rows.join(found, "fp").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each component, that with the smallest id (null ids last)."""
    numbered = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    numbered = stored(with_fingerprints(numbered, "text", width).drop("text"), "numbered-documents")
    found = fingerprint_components(numbered.select("id", "fp"))
    narrow = numbered.select("number", "id", "fp").join(found, "fp")
    best = narrow.groupBy("label").agg(F.min_by("number", F.struct(F.col("id").isNull(), "id", "number")).alias("number"))
    best = materialize(best.select("number"), "kept-documents")
    return numbered.join(best.hint("shuffle_hash"), "number", "left_semi").select("row.*")
