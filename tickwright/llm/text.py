"""Column expressions shared by the text operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.session import scratch_path

WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z, every other letter stays. Pure ASCII takes the faster builtin."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def lines_of(text: Column) -> Column:
    """The lines of a text; null counts as one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def words_of(text: Column) -> Column:
    """Lower-cased words without ASCII signs; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, text): all that the operators read of a document.

    ``mark`` is a hash of the text. Rows that repeat id and text are one document to every
    operator, rows that repeat the id alone are not mixed up. Other columns never get in.
    """
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))


def same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & (left["mark"] == right["mark"])


def stored(df: DataFrame, name: str, level: int = 3, page_bytes: int = 1 << 20) -> DataFrame:
    """Like ``materialize``, with the dense compression that tables of whole texts need."""
    path = scratch_path(df.sparkSession, name)
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": str(level), "parquet.page.size": str(page_bytes)}
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
