"""Corpus cleaning from raw documents to training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is stored before the next one
reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwright.llm.decontaminate import mark_contaminated
from tickwright.llm.language_id import UNKNOWN, identify, learn
from tickwright.llm.line_dedup import dedup_lines
from tickwright.llm.packing import pack
from tickwright.llm.simhash import first_of_each_group
from tickwright.llm.text import stored

# below this cosine a text resembles no learned language; short clean texts stay well above
LEAST_COSINE = 0.03


def narrowed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): all other columns in a struct, so that no operator's column can clash."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("row"))


def widened(found: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of ``documents`` again, some with new values."""
    own = {c: F.col(c) if c in ("doc_id", "text") else F.col("row").getField(c) for c in columns}
    return found.select(*[(own | new)[c].alias(c) for c in columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; letterless and null texts go."""
    found = identify(narrowed(docs), learn(docs))
    return widened(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_COSINE)), docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that an earlier one holds."""
    kept = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return widened(dedup_lines(narrowed(docs)), docs.columns, text=kept, n_chars=F.char_length(kept).cast("long"))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return first_of_each_group(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    marked = mark_contaminated(narrowed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return widened(marked.where(~F.col("contaminated")), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", duplicate_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

# token ids and fingerprints are beyond SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
