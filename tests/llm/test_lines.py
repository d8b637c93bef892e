import hashlib

from pyspark.sql import functions as F

from tickwright.llm.line_dedup import dedup_lines, keep_runs, kept_text

STRIP = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_chars=10):
    first = {}
    order = lambda i: (i is None, i or 0)
    for i, text in rows:
        for line in (text or "").split("\n"):
            k = lower(line.strip(STRIP))
            if len(k) >= min_chars and (k not in first or order(i) < order(first[k])):
                first[k] = i
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(lower(x.strip(STRIP)), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in df.collect()), key=repr)


def test_odd_rows_match_brute_force(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    out = dedup_lines(odd_docs)
    assert got(out) == brute(rows)
    assert set(odd_docs.columns) <= set(out.columns)


def test_clashing_columns_and_empty_table(odd_docs, no_docs):
    clash = odd_docs.select("doc_id", "text", F.lit("a").alias("n_lines"), F.lit(1).alias("id"), F.lit(2).alias("row"), F.lit(3).alias("dropped"))
    out = dedup_lines(clash)
    assert got(out) == got(dedup_lines(odd_docs)) and {"id", "row", "dropped"} <= set(out.columns)
    assert dedup_lines(no_docs).count() == 0


def test_hot_line_goes_the_aggregate_way(spark, monkeypatch):
    import tickwright.llm.line_dedup as m

    rows = [(i, f"a line that all of them hold\nown line number {i} of it") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    assert got(dedup_lines(docs)) == want
    monkeypatch.setattr(m, "HOT_LINES", 100)
    assert got(dedup_lines(docs)) == want


def test_runs(spark):
    df = spark.createDataFrame([([0, 1, 4], "a\nb\nc\nd\ne\nf"), ([], "a\nb"), ([0], "a")], "d array<int>, t string")
    rows = df.select(keep_runs(F.col("d"), F.size(F.split("t", "\n"))).alias("k"), "t").withColumn("kept", kept_text(F.col("t"), F.col("k"))).collect()
    assert [[tuple(x) for x in r["k"]] for r in rows] == [[(2, 4), (5, 6)], [(0, 2)], []]
    assert [r["kept"] for r in rows] == ["c\nd\nf", "a\nb", ""]


def test_whole_table_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert got(dedup_lines(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(hashlib.sha256(b"").hexdigest()) == 64
