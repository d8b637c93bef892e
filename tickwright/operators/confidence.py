"""Confidence scores (0 to 100) and their components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwright.functions.numeric import clip, col, piecewise, ratio
from tickwright.schema import ACCURACY_MULTIPLIERS, ENSEMBLE_WEIGHTS, SINGLE_WEIGHTS


def multiplier(model: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ACCURACY_MULTIPLIERS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, model), F.lit(1.0))


def accuracy_single(r2, model) -> Column:
    """Score of one model from its R²; negative R² maps to 0..10."""
    r = F.coalesce(F.nullif(col(r2), F.lit(0.0)), F.lit(0.5))
    score = F.when(r < 0, (r + 1.0) * 10.0).otherwise(r * 100.0 * multiplier(col(model)))
    return clip(score, 0.0, 100.0)


def accuracy_share(r2, model) -> Column:
    """A model's contribution to the ensemble accuracy, on the 0..1 scale."""
    r = col(r2)
    return F.when(r < 0, F.greatest((r + 1.0) * 0.1, F.lit(0.0))).otherwise(r * multiplier(col(model)))


def accuracy_ensemble(r2: str = "accuracy", model: str = "model") -> Column:
    """Aggregate: mean share of the group's models times 100; 50 without models."""
    return F.coalesce(clip(F.avg(accuracy_share(r2, model)) * 100.0, 0.0, 100.0), F.lit(50.0))


def agreement_from_cv(cv: Column) -> Column:
    return piecewise(
        cv,
        [
            (0.02, F.lit(100.0)),
            (0.05, F.lit(100.0) - (cv - 0.02) * 500.0),
            (0.10, F.lit(85.0) - (cv - 0.05) * 300.0),
            (0.20, F.lit(70.0) - (cv - 0.10) * 300.0),
            (0.50, F.lit(40.0) - (cv - 0.20) * 100.0),
        ],
        F.lit(10.0),
    )


def agreement(price: str = "price") -> Column:
    """Aggregate: score of the spread between model prices."""
    mean = F.avg(price)
    cv = ratio(F.stddev_pop(price), F.abs(mean))
    return (
        F.when(F.count(price) < 2, F.lit(70.0))
        .when(mean == 0, F.lit(50.0))
        .otherwise(clip(agreement_from_cv(cv), 0.0, 100.0))
    )


def volatility_from_annual(v: Column) -> Column:
    score = piecewise(
        v,
        [
            (0.15, F.lit(100.0) - v * 100.0),
            (0.30, F.lit(85.0) - (v - 0.15) * 100.0),
            (0.50, F.lit(70.0) - (v - 0.30) * 100.0),
            (1.00, F.lit(50.0) - (v - 0.50) * 60.0),
        ],
        F.lit(20.0) - F.least(F.lit(20.0), (v - 1.0) * 10.0),
    )
    return clip(score, 0.0, 100.0)


def volatility_score(bars: DataFrame, days: int = 252, min_rows: int = 30) -> DataFrame:
    """Per symbol: annualised deviation of the returns among the last closes, and its score."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    recent = bars.select("symbol", "date", "close").withColumn("_back", back).where(F.col("_back") <= days)
    w = Window.partitionBy("symbol").orderBy(F.desc("_back"))
    moved = recent.withColumn("_r", ratio("close", F.lag("close").over(w)) - 1.0)
    out = moved.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_n"), (F.stddev_pop("_r") * math.sqrt(252.0)).alias("annual_volatility")
    )
    score = F.when(F.col("_n") < min_rows, F.lit(50.0)).otherwise(volatility_from_annual(F.col("annual_volatility")))
    return out.select("symbol", "annual_volatility", score.alias("volatility_score"))


def time_decay_score(days) -> Column:
    d = col(days)
    score = piecewise(
        d,
        [
            (1, F.lit(100.0)),
            (7, F.lit(100.0) - (d - 1) * 10.0 / 6.0),
            (30, F.lit(90.0) - (d - 7) * 10.0 / 23.0),
            (365, F.lit(80.0) - (d - 30) * 15.0 / 335.0),
            (1825, F.lit(65.0) - (d - 365) * 20.0 / 1460.0),
        ],
        F.lit(45.0) - F.least(F.lit(20.0), (d - 1825) * 0.01),
    )
    return clip(score, 0.0, 100.0)


def confidence_single(accuracy, volatility, decay) -> Column:
    w = SINGLE_WEIGHTS
    return clip(
        col(accuracy) * w["accuracy"] + col(volatility) * w["volatility"] + col(decay) * w["decay"], 0.0, 100.0
    )


def confidence_ensemble(accuracy, agreement_score, volatility, decay) -> Column:
    w = ENSEMBLE_WEIGHTS
    return clip(
        col(accuracy) * w["accuracy"]
        + col(agreement_score) * w["agreement"]
        + col(volatility) * w["volatility"]
        + col(decay) * w["decay"],
        0.0,
        100.0,
    )
