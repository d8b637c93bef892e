"""Index files and instrument maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwright.schema import DIM_COLUMNS


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index CSV as text columns; fails when there is no ``symbol`` column."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    if "symbol" not in df.columns:
        raise ValueError("index file has no symbol column")
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in DIM_COLUMNS + ["category"]])


def list_symbols(dim: DataFrame, category: str | None = None) -> DataFrame:
    """(category, symbol) rows; all categories when none is named."""
    rows = dim.select("category", "symbol").distinct()
    return rows if category is None else rows.where(F.col("category") == category)


INSTRUMENT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("exchange", "instrument_type", "trading_symbol", "isin")]
)
INSTRUMENT_DOC = T.StructType([T.StructField("data", T.MapType(T.StringType(), INSTRUMENT))])


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    """Equity instruments: upper-case symbol and ISIN, the last entry of a symbol wins."""
    docs = (
        spark.read.schema(INSTRUMENT_DOC)
        .json(path)
        .select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), "data")
    )
    entries = docs.select(
        "file", "block", F.posexplode(F.map_values("data")).alias("pos", "item")
    ).select(
        F.struct("file", "block", "pos").alias("at"),
        F.upper(F.trim("item.trading_symbol")).alias("symbol"),
        F.trim("item.isin").alias("isin"),
        F.col("item.exchange").alias("exchange"),
        F.col("item.instrument_type").alias("kind"),
    )
    return (
        entries.where(
            (F.col("exchange") == "NSE_EQ")
            & (F.col("kind") == "EQ")
            & (F.length("symbol") > 0)
            & (F.length("isin") > 0)
        )
        .groupBy("symbol")
        .agg(F.max_by("isin", "at").alias("isin"))
    )


def read_validation_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(category, symbol) of a JSON object that lists the held-out symbols of each category."""
    listed = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", listed).alias("m"))
    return text.select(F.explode("m").alias("category", "symbols")).select("category", F.explode("symbols").alias("symbol")).distinct()
