"""Error and classification metrics as plain aggregates (partial on the map side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.functions.numeric import ratio
from tickwright.functions.windows import by_symbol, symbol_rows
from tickwright.schema import HORIZON_DAYS


def error(y: str, p: str) -> Column:
    return F.col(y) - F.col(p)


def regression_metrics(df: DataFrame, by, y: str = "y", p: str = "p") -> DataFrame:
    """mae, mse and rmse per group."""
    e = error(y, p)
    out = df.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))
    return out.withColumn("rmse", F.sqrt("mse"))


def half_mse(df: DataFrame, by, y: str = "y", p: str = "p") -> DataFrame:
    e = error(y, p)
    return df.groupBy(*by).agg((F.sum(e * e) / (F.count(e) * 2.0)).alias("half_mse"))


def log_loss(df: DataFrame, by, y: str = "y", p: str = "p", eps: float = 1e-15) -> DataFrame:
    """Binary cross-entropy with probabilities clipped away from 0 and 1."""
    q = F.greatest(F.least(F.col(p), F.lit(1.0 - eps)), F.lit(eps))
    term = F.col(y) * F.log(q) + (F.lit(1.0) - F.col(y)) * F.log(F.lit(1.0) - q)
    return df.groupBy(*by).agg((-F.avg(term)).alias("log_loss"))


def r2_expr(y: str, p: str) -> Column:
    """1 - SSE/SST without floor; NULL when y is constant."""
    e = error(y, p)
    return F.lit(1.0) - ratio(F.sum(e * e), F.count(F.col(y)) * F.var_pop(y))


def r2(df: DataFrame, by, y: str = "y", p: str = "p") -> DataFrame:
    """R² floored at 0; squared correlation, then 0.5, where SST is zero."""
    corr = F.corr(y, p)
    fallback = F.coalesce(F.when(~F.isnan(corr), corr * corr), F.lit(0.5))
    return df.groupBy(*by).agg(F.greatest(F.coalesce(r2_expr(y, p), fallback), F.lit(0.0)).alias("r2"))


def classification_metrics(df: DataFrame, by, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Accuracy, and precision, recall and F1 of class 1; 0 where undefined."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    out = df.groupBy(*by).agg(
        F.count_if(F.col(actual) == F.col(predicted)).alias("_hit"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(a & p).alias("_tp"),
        F.count_if(p).alias("_pp"),
        F.count_if(a).alias("_ap"),
    )
    precision, recall = ratio("_tp", "_pp", 0.0), ratio("_tp", "_ap", 0.0)
    return out.select(
        *by,
        ratio("_hit", "_n", 0.0).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(precision * recall * 2.0, precision + recall, 0.0).alias("f1"),
    )


def validation_by_symbol(scored: DataFrame, test: float = 0.2) -> DataFrame:
    """R², rmse and mae of every symbol on the last share of its rows."""
    cut = F.floor(symbol_rows() * F.lit(1.0 - test))
    tail = scored.withColumn("_rn", F.row_number().over(by_symbol())).withColumn("_cut", cut)
    e = error("y", "p")
    return (
        tail.where(F.col("_rn") > F.col("_cut"))
        .groupBy("symbol")
        .agg(
            F.coalesce(r2_expr("y", "p"), F.lit(0.0)).alias("r2"),
            F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(F.abs(e)).alias("mae"),
        )
    )


def validation_summary(scored: DataFrame, test: float = 0.2) -> DataFrame:
    """Averages of the per-symbol validation figures."""
    per = validation_by_symbol(scored, test)
    return per.agg(
        F.count(F.lit(1)).alias("symbols"),
        F.avg("r2").alias("avg_r2"),
        F.avg("rmse").alias("avg_rmse"),
        F.avg("mae").alias("avg_mae"),
    )


def prediction_summary(preds: DataFrame, by=()) -> DataFrame:
    """Stocks, rows, last update and the valid horizons present (at most five)."""
    known = F.when(F.col("horizon").isin(*HORIZON_DAYS), F.col("horizon"))
    return preds.groupBy(*by).agg(
        F.count_distinct("symbol").alias("total_stocks"),
        F.count(F.lit(1)).alias("total_predictions"),
        F.max("last_updated").alias("last_updated"),
        F.sort_array(F.collect_set(known)).alias("horizons"),
    )
