"""Token counts: Arrow batches in, lengths out."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwright.llm.tokens import by_bytes, default_tokenizer, encoder


def count_tokens(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """All columns of ``docs`` and (n_bytes, n_tokens, over_limit).

    Null counts as the empty text. Only the text column goes to Python and only lengths come back;
    batches are cut by bytes, long texts at safe boundaries (see ``tokens``). Input columns with
    one of the new names are replaced.
    """
    path = tokenizer or default_tokenizer()

    @F.pandas_udf("long")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for texts in batches:
            texts = texts.tolist()
            counts = [own.counts_of(texts[part]) for part in by_bytes(texts)]
            yield pd.Series(np.concatenate(counts) if counts else [], dtype="int64")

    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    out = docs.withColumn("n_bytes", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"))
    return out.withColumn("n_tokens", lengths(text_col)).withColumn("over_limit", F.col("n_tokens") > limit)
