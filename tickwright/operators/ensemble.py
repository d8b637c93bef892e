"""Ensembles over (keys, model, price): weighted means, spreads and ranges.

Each is one aggregate over the models of a key, so it combines on the map side and never
gathers a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.functions.numeric import clip, col, ratio
from tickwright.schema import INTERVAL_Z, MODEL_WEIGHTS, UNKNOWN_MODEL_WEIGHT


def price_from_pct(current, pct) -> Column:
    return col(current) * (F.lit(1.0) + col(pct) / F.lit(100.0))


def base_weight(model: Column, unknown: float) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MODEL_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, model), F.lit(unknown))


def weighted_price(price: str, weight: Column) -> Column:
    """Aggregate: weighted mean, or the plain mean when the weights sum to zero."""
    total = F.sum(weight)
    return F.when(total > 0, ratio(F.sum(F.col(price) * weight), total)).otherwise(F.avg(price))


def ensemble_fixed(df: DataFrame, by, only: str | None = None) -> DataFrame:
    """Configured weights; a named model counts alone."""
    rows = df if only is None else df.where(F.col("model") == only)
    weight = F.lit(1.0) if only else base_weight(F.col("model"), 0.0)
    return rows.groupBy(*by).agg(weighted_price("price", weight).alias("ensemble_price"))


def adjusted_weight(model: str = "model", accuracy: str = "accuracy") -> Column:
    """Configured weight raised by the model's R² (0.5 when unknown)."""
    boost = F.lit(0.5) + F.coalesce(F.col(accuracy), F.lit(0.5))
    return base_weight(F.col(model), UNKNOWN_MODEL_WEIGHT) * boost


def ensemble_accuracy_adjusted(df: DataFrame, by) -> DataFrame:
    return df.groupBy(*by).agg(weighted_price("price", adjusted_weight()).alias("ensemble_price"))


def inverse_rmse() -> Column:
    return F.when(F.col("rmse") > 0, F.lit(1.0) / F.nullif(F.col("rmse"), F.lit(0.0))).otherwise(F.lit(0.0))


def inverse_rmse_weights(df: DataFrame, by) -> DataFrame:
    """Adds ``weight``: share of 1/rmse; equal shares when no model has a positive rmse."""
    totals = df.groupBy(*by).agg(F.sum(inverse_rmse()).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    weight = F.when(F.col("_sum") > 0, ratio(inverse_rmse(), F.col("_sum"))).otherwise(F.lit(1.0) / F.col("_n"))
    return df.join(totals, list(by)).withColumn("weight", weight).drop("_sum", "_n")


def ensemble_inverse_rmse(df: DataFrame, by) -> DataFrame:
    weight = inverse_rmse()
    return df.groupBy(*by).agg(weighted_price("price", weight).alias("ensemble_price"))


def variance_confidence(df: DataFrame, by) -> DataFrame:
    """100 (1 - sqrt(sum of w (p - mean)²) / |mean|); 50 for fewer than two models or mean 0.

    The centred sum is expanded into sums of w, wp and wp² around a per-group shift (the
    smallest price), which keeps it one aggregate without cancellation.
    """
    shift = df.groupBy(*by).agg(F.min("price").alias("_lo"))
    x = F.col("price") - F.col("_lo")
    w = F.col("weight")
    sums = df.join(shift, list(by)).groupBy(*by).agg(
        F.count("price").alias("_n"),
        F.avg("price").alias("_mean"),
        F.avg(x).alias("_mx"),
        F.sum(w).alias("_w"),
        F.sum(w * x).alias("_wx"),
        F.sum(w * x * x).alias("_wxx"),
    )
    variance = F.col("_wxx") - F.col("_mx") * F.col("_wx") * 2.0 + F.col("_mx") * F.col("_mx") * F.col("_w")
    spread = F.sqrt(F.greatest(variance, F.lit(0.0)))
    score = clip((F.lit(1.0) - ratio(spread, F.abs("_mean"))) * 100.0, 0.0, 100.0)
    value = F.when((F.col("_n") < 2) | (F.col("_mean") == 0), F.lit(50.0)).otherwise(score)
    return sums.select(*by, value.alias("confidence"))


def interval_bounds(price: Column, spread: Column, models: Column, legacy_bounds: bool = False) -> tuple[Column, Column]:
    """Low and high bound of an ensemble price from the models' population deviation."""
    one = models < 2
    low, high = price - spread * INTERVAL_Z, price + spread * INTERVAL_Z
    if legacy_bounds:
        low, high = F.greatest(low, price * 0.5), F.greatest(high, price * 1.5)
    else:
        low = F.greatest(low, F.lit(0.0))
    return F.when(one, price * 0.9).otherwise(low), F.when(one, price * 1.1).otherwise(high)


def confidence_interval(df: DataFrame, by, legacy_bounds: bool = False) -> DataFrame:
    """Accuracy-adjusted ensemble with its interval."""
    g = df.groupBy(*by).agg(
        weighted_price("price", adjusted_weight()).alias("ensemble_price"),
        F.stddev_pop("price").alias("_sd"),
        F.count("price").alias("_n"),
    )
    low, high = interval_bounds(F.col("ensemble_price"), F.col("_sd"), F.col("_n"), legacy_bounds)
    return g.select(*by, "ensemble_price", low.alias("confidence_low"), high.alias("confidence_high"))


def price_range(df: DataFrame, by) -> DataFrame:
    """Weighted price with ±1.96 population deviations, the lower end at least 0."""
    g = df.groupBy(*by).agg(
        F.sum(F.col("price") * F.col("weight")).alias("ensemble_price"), F.stddev_pop("price").alias("_sd")
    )
    margin = F.col("_sd") * INTERVAL_Z
    return g.select(
        *by,
        "ensemble_price",
        F.greatest(F.col("ensemble_price") - margin, F.lit(0.0)).alias("range_low"),
        (F.col("ensemble_price") + margin).alias("range_high"),
    )
