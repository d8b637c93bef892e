"""Removal of lines that several documents share.

A line's key is the stripped line in lower case (A-Z). Keys of ``min_chars`` code points or more
that at least two documents hold lose all their lines but those in the smallest document.

Plan: the lines become 128-bit hashes with document and position, without text. A first
aggregate, combined before its shuffle, finds the keys with the most lines; at most ``HOT_KEYS``
of them are decided by that aggregate alone, so no key's rows meet in one task. All others are
range-partitioned by hash with a secondary sort by document and position, and one pass over each
partition takes first occurrences. Only dropped positions travel back; each document gets its
kept lines as a run-length bitmap, which is applied to the text in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwright.llm.text import WHITE, ascii_lower, keyed, lines_of, same_document
from tickwright.session import materialize

HOT_KEYS = 4096
HOT_LINES = 1_000


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, mark, pos, h1, h2) of every line whose key is long enough."""
    lines = docs.select("id", "mark", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    key = ascii_lower(F.btrim(F.col("line"), F.lit(WHITE)))
    lines = lines.select("id", "mark", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
    return lines.select("id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def repeated_positions(lines: DataFrame) -> DataFrame:
    """(id, mark, pos) of the lines that an earlier document holds."""
    hot = (
        lines.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
        .where(F.col("n") >= HOT_LINES)
        .orderBy(F.desc("n"), "h1", "h2")
        .limit(HOT_KEYS)
    )
    hot = F.broadcast(materialize(hot.select("h1", "h2", "first"), "hot-lines"))
    order = [F.asc_nulls_last("id"), F.asc("pos")]
    cold = lines.join(hot, ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", *order)
    first = F.first("id").over(Window.partitionBy("h1", "h2").orderBy(*order))
    cold = cold.withColumn("first", first)
    both = cold.select("id", "mark", "pos", "first").unionByName(lines.join(hot, ["h1", "h2"]).select("id", "mark", "pos", "first"))
    return both.where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "mark", "pos")


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """Bitmap of kept lines as runs [from, to), given the sorted dropped positions."""
    starts = F.filter(dropped, lambda x, i: (i == 0) | (F.get(dropped, i - 1) != x - 1))
    ends = F.filter(dropped, lambda x, i: F.coalesce(F.get(dropped, i + 1) != x + 1, F.lit(True)))
    begin = F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x + 1))
    stop = F.concat(starts, F.array(n_lines))
    runs = F.zip_with(begin, stop, lambda a, b: F.struct(a.alias("from"), b.alias("to")))
    return F.filter(runs, lambda r: r["to"] > r["from"])


def kept_text(text: Column, runs: Column) -> Column:
    """The lines that a run bitmap keeps, joined by newlines."""
    lines = lines_of(text)
    return F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["from"] + 1, r["to"] - r["from"]))), "\n")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(id, mark, dropped) for documents that lose lines: their sorted positions.

    Null ids count as one document that comes last. An empty table gives no rows.
    """
    lines = materialize(line_hashes(keyed(docs, id_col, text_col), min_chars), "line-hashes")
    return repeated_positions(lines).groupBy("id", "mark").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """All columns of ``docs`` and (n_lines, n_dropped, keep_runs, kept_text).

    ``n_lines`` counts lines before dropping; a null or empty text is one empty line and stays as
    it is (its kept text is empty). Rows that repeat an id hold their lines together; input
    columns with one of the new names are replaced.
    """
    new = ["n_lines", "n_dropped", "keep_runs", "kept_text"]
    docs = docs.drop(*new)
    dropped = dropped_lines(docs, id_col, text_col, min_chars)
    # the table's own columns travel in one struct, so none of their names can clash
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.struct("*").alias("row"))
    text = F.col("row")[text_col]
    joined = rows.join(dropped.hint("shuffle_hash"), same_document(rows, dropped), "left").select("row", "dropped")
    n_lines = F.size(lines_of(text))
    joined = joined.withColumn("n_lines", n_lines.cast("long")).withColumn(
        "keep_runs", keep_runs(F.coalesce("dropped", F.array().cast("array<int>")), n_lines)
    )
    new = F.struct(
        "n_lines",
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        "keep_runs",
        F.when(F.col("dropped").isNull(), F.coalesce(text, F.lit(""))).otherwise(kept_text(text, F.col("keep_runs"))).alias("kept_text"),
    )
    return joined.select("row", new.alias("new")).select("row.*", "new.*")
