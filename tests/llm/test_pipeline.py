"""The pipeline's stages against plain Python, each on its own input."""

import pytest
from pyspark.sql import functions as F

from tickwright.llm.text import stored

import corpus_pipeline as pipeline
import test_decontaminate
import test_lines
import test_simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, small), name)
        out.append(docs)
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_return_documents(steps):
    assert all(s.columns == COLUMNS for s in steps[:5])
    assert all(s.dtypes == steps[0].dtypes for s in steps[:5])


def test_language_stage_keeps_clean_texts(steps):
    kept = dict(texts(steps[1]))
    for i, t in texts(steps[0]):
        assert (i in kept) == any(c.isalpha() for c in t or "")


def test_line_stage(steps):
    want = {i: t for i, _, _, t in test_lines.brute(texts(steps[1]))}
    assert dict(texts(steps[2])) == want
    assert steps[2].where("n_chars <> char_length(text)").count() == 0


def test_duplicate_stage(steps):
    rows = [(i, test_simhash.brute_print(t)) for i, t in texts(steps[2])]
    want = {c for _, _, c in test_simhash.brute_components(rows)}
    assert {i for i, _ in texts(steps[3])} == want


def test_benchmark_stage(spark, small, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    want = {i for i, _, _, _, bad in test_decontaminate.brute(texts(steps[3]), items) if not bad}
    assert {i for i, _ in texts(steps[4])} == want


def test_packing_stage(steps):
    pieces = steps[5].collect()
    assert {r["doc_id"] for r in pieces} == {i for i, _ in texts(steps[4])}
    total = {}
    for r in pieces:
        total.setdefault(r["doc_id"], [r["doc_tokens"], 0])[1] += r["length"]
    assert all(a == b for a, b in total.values())


def test_run_gives_the_same_pieces(spark, small, steps):
    pick = ["doc_id", "doc_tokens"]
    assert sorted(pipeline.run(spark, small).select(*pick).distinct().collect()) == sorted(steps[5].select(*pick).distinct().collect())


@pytest.fixture(scope="module")
def odd(spark, odd_docs):
    """Columns named like those that the operators add, nulls, repeated rows, unlearned languages."""
    rows = odd_docs.drop("score").withColumns({"score": F.lit("own score"), "items": F.col("source"), "n_lines": F.lit("many"), "row": F.col("doc_id"), "contaminated": F.lit(7), "lang_pred": F.lit("xx")})
    more = spark.createDataFrame([(40, "漢字かな交じり文 " * 5, None, "s", 1), (41, "Кириллица здесь", None, "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return rows.unionByName(more, allowMissingColumns=True)


def test_stages_leave_other_columns_alone(spark, small, odd):
    docs = odd
    for name, stage in pipeline.STAGES[:-1]:
        before = {}
        for r in docs.collect():
            before.setdefault(r["doc_id"], []).append({c: r[c] for c in odd.columns if c not in ("text", "n_chars")})
        docs = stored(stage(spark, docs, small), name)
        assert docs.columns == odd.columns and dict(docs.dtypes) == dict(odd.dtypes)
        for r in docs.collect():
            assert {c: r[c] for c in odd.columns if c not in ("text", "n_chars")} in before[r["doc_id"]]
    kept = [r["doc_id"] for r in docs.collect()]
    assert len(kept) == len(set(kept)) and 3 not in kept and 6 not in kept
    assert pipeline.STAGES[-1][1](spark, docs, small).count() >= len(kept)


def test_empty_table(spark, small, steps):
    docs = steps[0].limit(0)
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, small), name)
    assert docs.count() == 0
