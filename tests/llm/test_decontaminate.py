import re

import pytest

from tickwright.llm.decontaminate import build_index, mark_contaminated, phrases_of, proximity_matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - width + 1)):
            if w:
                windows.setdefault(tuple(w[s : s + width]), set()).add(item)
    out = []
    for i, text in docs:
        w = words(text)
        hit, named = set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    named |= windows[k]
        named = sorted(str(x) for x in named if x is not None)
        out.append((i, len(w), len(hit), named, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in df.collect()), key=repr)


ITEMS = [(1, "one two three"), (10, "Alpha beta ALPHA beta alpha gamma"), (2, "a " * 20), (3, None), (4, "..."), (None, "only words here"), (5, "one two three"), (5, "one two three")]


def docs_of(spark):
    rows = [
        (1, "zero one two three four"), (2, "one, two! THREE one two three"), (3, "alpha beta alpha beta alpha gamma " + "x " * 500),
        (4, "a " * 13), (5, "a " * 40), (6, None), (7, ""), (8, "one two"), (None, "only words here"), (9, "one two three"), (9, "one two three"),
        (9, "other text of the same id"), (10, "one two ähre three"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), rows


def test_odd_rows_match_brute_force(spark):
    docs, rows = docs_of(spark)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert got(mark_contaminated(docs, items)) == brute(rows, ITEMS)


@pytest.mark.parametrize("limit", [0, 100_000])
def test_plans_agree(spark, small, monkeypatch, limit):
    import tickwright.llm.decontaminate as m

    monkeypatch.setattr(m, "BROADCAST_ROWS", limit)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    want = brute([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert got(mark_contaminated(docs, items)) == want


def test_empty_tables_and_clashing_columns(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert mark_contaminated(no_docs, items).count() == 0
    out = mark_contaminated(odd_docs.withColumnRenamed("score", "items"), items.limit(0))
    assert out.count() == odd_docs.count() and out.where("contaminated or n_hit > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x green"), (2, "green red"), (3, "red " + "x " * 30 + "green"), (4, "red")], "doc_id bigint, text string")
    phrases = phrases_of(spark.createDataFrame([(1, "red green")], "item_id bigint, text string"), "item_id", "text", 13).select("phrase", "words")
    _, postings, terms = build_index(docs, phrases)
    near = lambda k: sorted({r["id"] for r in proximity_matches(postings, terms, k).collect()})
    assert near(1) == [2] and near(3) == [1, 2] and near(40) == [1, 2, 3]
