"""Data-quality rules, for all symbols in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.functions.numeric import ratio
from tickwright.functions.windows import by_symbol
from tickwright.schema import (
    HORIZON_DAYS,
    MAX_GAP_DAYS,
    MAX_MOVE,
    MIN_TRAINING_ROWS,
    PRICE_MAX,
    PRICE_MIN,
)

PRICES = ("open", "high", "low", "close")


def quality_facts(bars: DataFrame) -> DataFrame:
    """Per symbol the figures all rules need: one window and one aggregate on the same key."""
    w = by_symbol()
    moved = bars.withColumns(
        {
            "_move": F.abs(ratio("close", F.lag("close").over(w)) - F.lit(1.0)),
            "_gap": F.date_diff("date", F.lag("date").over(w)),
        }
    )
    return moved.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("date", *PRICES)],
        F.min("close").alias("min_close"),
        F.max("close").alias("max_close"),
        F.max("_move").alias("max_move"),
        F.max("_gap").alias("max_gap"),
        F.count_if(F.col("high") == F.col("low")).alias("flat_bars"),
    )


def dq_min_rows(n: int = MIN_TRAINING_ROWS) -> Column:
    return F.col("row_count") >= n


def dq_no_nulls() -> Column:
    nulls = [F.col(f"null_{c}") for c in ("date", *PRICES)]
    return sum(nulls[1:], nulls[0]) == 0


def dq_price_range(low: float = PRICE_MIN, high: float = PRICE_MAX) -> Column:
    return F.coalesce((F.col("min_close") >= low) & (F.col("max_close") <= high), F.lit(True))


def dq_max_move(limit: float = MAX_MOVE) -> Column:
    return ~F.coalesce(F.col("max_move") > limit, F.lit(False))


def dq_date_gaps(days: int = MAX_GAP_DAYS) -> Column:
    """True when a gap is too long (a warning, not a failure)."""
    return F.coalesce(F.col("max_gap") > days, F.lit(False))


def quality_report(bars: DataFrame) -> DataFrame:
    """The facts with one flag per rule and the verdict."""
    return quality_facts(bars).withColumns(
        {
            "enough_rows": dq_min_rows(),
            "no_nulls": dq_no_nulls(),
            "in_range": dq_price_range(),
            "moves_ok": dq_max_move(),
            "gap_warning": dq_date_gaps(),
            "passed": dq_min_rows() & dq_no_nulls() & dq_price_range() & dq_max_move(),
        }
    )


def validate_quality(bars: DataFrame) -> DataFrame:
    """Bars of the symbols that pass the four hard rules.

    The verdicts join back on the symbol; hash partitioning by symbol is reused.
    """
    good = quality_report(bars).where("passed").select("symbol")
    return bars.join(good, "symbol", "left_semi")


def validate_predictions(df: DataFrame) -> DataFrame:
    """Predictions of the symbols all of whose rows are valid."""
    ok = (
        F.col("predicted_price").isNotNull()
        & (F.col("predicted_price") > 0)
        & F.col("horizon").isin(*HORIZON_DAYS)
    )
    if {"confidence_low", "confidence_high"} <= set(df.columns):
        ok = ok & ~F.coalesce(F.col("confidence_low") > F.col("confidence_high"), F.lit(False))
    good = df.groupBy("symbol").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("_ok")).where("_ok")
    return df.join(good.select("symbol"), "symbol", "left_semi")


def validate_weights(weights: DataFrame, by: list[str], tolerance: float = 0.01) -> DataFrame:
    """Do the weights sum to one within the tolerance?"""
    return weights.groupBy(*by).agg(F.sum("weight").alias("total")).withColumn(
        "valid", F.abs(F.col("total") - 1.0) <= tolerance
    )


def job_outcome(results: DataFrame) -> DataFrame:
    """Totals and success rate of a job; ``results`` has symbol and ok."""
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("ok")).alias("success"),
        F.count_if(~F.col("ok")).alias("failed"),
        (F.count_if(F.col("ok")) * F.lit(100.0) / F.count(F.lit(1))).alias("success_rate"),
    )


def job_failures(results: DataFrame) -> DataFrame:
    """The failed symbols as rows, so the list may be any length."""
    return results.where(~F.col("ok")).select("symbol")
