"""Queries for metrics, confidence, ensembles and forecast rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwright.functions.numeric import r6
from tickwright.functions.scalar import horizons
from tickwright.operators import confidence as conf
from tickwright.operators import ensemble as ens
from tickwright.operators import features as ft
from tickwright.operators import forecast as fc
from tickwright.operators import metrics as mt
from tickwright.schema import MODEL_WEIGHTS
from tickwright.sources import tables as t

from .p01_files import HZ, sample_predictions
from .p06_indicators import out
from .p07_features import LAB, nation_bars
from .registry import BARS_N, BARS_S, div, lag, query
from .registry import r6 as q6

# ---- metrics on order lines --------------------------------------------------------------------


def scored_lines(spark, d):
    """Line price against a crude estimate, both in thousands."""
    line = t.table(spark, d, "lineitem")
    return line.select(
        F.col("l_suppkey").alias("symbol"), "l_linenumber",
        (F.col("l_extendedprice") / 1000.0).alias("y"), (F.col("l_quantity") * 2.5 * (1.0 - F.col("l_discount"))).alias("p"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("actual"),
        F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("predicted"),
        (F.col("l_discount") * 10.0).alias("prob"),
    )


LINES = """sl AS (SELECT l_suppkey AS symbol, l_linenumber, l_extendedprice / 1000.0 AS y, l_quantity * 2.5 * (1.0 - l_discount) AS p,
 CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS actual, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS predicted, l_discount * 10.0 AS prob FROM lineitem)"""


@query("mae_mse_rmse", f"WITH {LINES} SELECT symbol, {q6('avg(abs(y - p))', 'mae')}, {q6('avg((y - p) * (y - p))', 'mse')}, {q6('sqrt(avg((y - p) * (y - p)))', 'rmse')} FROM sl GROUP BY symbol")
def mae_mse_rmse(spark, d):
    return out(mt.regression_metrics(scored_lines(spark, d), ["symbol"]), ["mae", "mse", "rmse"], ["symbol"])


@query("half_mse", f"WITH {LINES} SELECT symbol, {q6('sum((y - p) * (y - p)) / (2.0 * count(*))', 'half_mse')} FROM sl GROUP BY symbol")
def half_mse(spark, d):
    return out(mt.half_mse(scored_lines(spark, d), ["symbol"]), ["half_mse"], ["symbol"])


@query(
    "log_loss",
    f"""WITH {LINES}, q AS (SELECT *, greatest(least(prob, 1.0 - 1e-15), 1e-15) AS q FROM sl)
SELECT l_linenumber, {q6('-avg(actual * ln(q) + (1.0 - actual) * ln(1.0 - q))', 'log_loss')} FROM q GROUP BY l_linenumber""",
)
def log_loss(spark, d):
    return out(mt.log_loss(scored_lines(spark, d), ["l_linenumber"], "actual", "prob"), ["log_loss"], ["l_linenumber"])


@query(
    "r2",
    f"""WITH {LINES} SELECT symbol, {q6('greatest(coalesce(1.0 - sum((y - p) * (y - p)) / nullif(count(*) * var_pop(y), 0), power(corr(y, p), 2), 0.5), 0.0)', 'r2')} FROM sl GROUP BY symbol""",
)
def r2(spark, d):
    return out(mt.r2(scored_lines(spark, d), ["symbol"]), ["r2"], ["symbol"])


@query(
    "classification_metrics",
    f"""WITH {LINES}, c AS (SELECT symbol, sum(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) / count(*) AS acc,
 coalesce(sum(actual * predicted) / nullif(sum(predicted), 0), 0.0) AS pr, coalesce(sum(actual * predicted) / nullif(sum(actual), 0), 0.0) AS re FROM sl GROUP BY symbol)
SELECT symbol, {q6('acc', 'accuracy')}, {q6('pr', 'precision')}, {q6('re', 'recall')}, {q6('coalesce(2.0 * pr * re / nullif(pr + re, 0), 0.0)', 'f1')} FROM c""",
)
def classification_metrics(spark, d):
    return out(mt.classification_metrics(scored_lines(spark, d), ["symbol"]), ["accuracy", "precision", "recall", "f1"], ["symbol"])


def scored_bars(spark, d):
    """Next close against the close (a last-value model) for every bar."""
    b = t.bars_supplier(spark, d)
    y = F.lead("close").over(ft.by_symbol())
    return b.select("symbol", "date", y.alias("y"), ((F.col("high") + F.col("low")) / 2.0).alias("p")).where(F.col("y").isNotNull())


VAL = f"""WITH {BARS_S}, sb AS (SELECT symbol, date, lead(close) OVER (PARTITION BY symbol ORDER BY date) AS y, (high + low) / 2.0 AS p FROM bars),
sc AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM sb WHERE y IS NOT NULL),
v AS (SELECT symbol, coalesce(1.0 - sum((y - p) * (y - p)) / nullif(count(*) * var_pop(y), 0), 0.0) AS r2, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae
 FROM sc WHERE rn > floor(n * 0.8) GROUP BY symbol)"""


@query("validation_by_symbol", f"{VAL} SELECT symbol, {q6('r2', 'r2')}, {q6('rmse', 'rmse')}, {q6('mae', 'mae')} FROM v")
def validation_by_symbol(spark, d):
    return out(mt.validation_by_symbol(scored_bars(spark, d)), ["r2", "rmse", "mae"], ["symbol"])


@query("validation_summary", f"{VAL} SELECT count(*) AS symbols, {q6('avg(r2)', 'avg_r2')}, {q6('avg(rmse)', 'avg_rmse')}, {q6('avg(mae)', 'avg_mae')} FROM v")
def validation_summary(spark, d):
    return out(mt.validation_summary(scored_bars(spark, d)), ["avg_r2", "avg_rmse", "avg_mae"], ["symbols"])


@query(
    "prediction_summary",
    f"""WITH {BARS_N}, {HZ}, s AS (SELECT symbol, max(date) AS d0 FROM bars GROUP BY symbol) SELECT CASE WHEN symbol % 2 = 0 THEN 'us_stocks' ELSE 'ind_stocks' END AS category,
 count(DISTINCT symbol) AS total_stocks, count(*) AS total_predictions, max(d0) AS last_updated, list_sort(list(DISTINCT horizon)) AS horizons FROM s, hz GROUP BY 1""",
)
def prediction_summary(spark, d):
    p = sample_predictions(spark, d)
    days = F.element_at(F.map_from_entries(horizons()), F.col("horizon"))
    return mt.prediction_summary(p.withColumn("last_updated", F.date_sub("date", days)), ["category"])


# ---- stand-in model predictions --------------------------------------------------------------------


def next_day_models(spark, d):
    """Three deterministic models per symbol: last change, mean change, half the last change."""
    targets = ft.target_pct(nation_bars(spark, d))
    last = targets.groupBy("symbol").agg(F.max_by("label", "date").alias("l"))
    means = fc.recent_targets(targets)
    models = F.array(
        F.struct(F.lit("random_forest").alias("model"), F.col("l").alias("next_day"), F.lit(0.9).alias("accuracy")),
        F.struct(F.lit("decision_tree").alias("model"), F.col("recent_mean").alias("next_day"), F.lit(-0.2).alias("accuracy")),
        F.struct(F.lit("linear_regression").alias("model"), (F.col("l") * 0.5).alias("next_day"), (F.lit(0.05) + F.col("symbol") * 0.01).alias("accuracy")),
    )
    return last.join(means, "symbol").select("symbol", F.inline(models)), targets


def model_prices(spark, d):
    """Stand-in models at all horizons, as prices, with an rmse column."""
    next_day, targets = next_day_models(spark, d)
    current = nation_bars(spark, d).groupBy("symbol").agg(F.max_by("close", "date").alias("current_price"))
    pct = fc.extrapolate(next_day, targets).join(current, "symbol")
    rmse = F.when(F.col("model") == "decision_tree", F.col("symbol") % 3).otherwise(F.lit(0.5) + F.col("accuracy"))
    return pct.withColumn("price", ens.price_from_pct("current_price", "pct")).withColumn("rmse", rmse.cast("double"))


MODELS = f"""{BARS_N}, {HZ}, {LAB}, lb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM lab WHERE label IS NOT NULL),
ls AS (SELECT symbol, max(CASE WHEN back = 1 THEN label END) AS l, avg(CASE WHEN back <= 30 THEN label END) AS m, count(*) AS n FROM lb GROUP BY symbol),
nd AS (SELECT symbol, 'random_forest' AS model, l AS next_day, 0.9 AS accuracy FROM ls UNION ALL SELECT symbol, 'decision_tree', m, -0.2 FROM ls
 UNION ALL SELECT symbol, 'linear_regression', l * 0.5, 0.05 + symbol * 0.01 FROM ls),
cur AS (SELECT symbol, arg_max(close, date) AS current_price FROM bars GROUP BY symbol),
px AS (SELECT nd.symbol, horizon, days, model, CAST(accuracy AS DOUBLE) AS accuracy, next_day, current_price,
 CASE WHEN days = 1 THEN next_day WHEN n < 2 THEN 0.0 ELSE least(0.7, days / 365.0::DOUBLE) * m * least(days, 30) + (1.0 - least(0.7, days / 365.0::DOUBLE)) * next_day END AS pct
 FROM nd JOIN ls USING (symbol) JOIN cur USING (symbol), hz),
mp AS (SELECT *, current_price * (1.0 + pct / 100.0) AS price, CAST(CASE WHEN model = 'decision_tree' THEN symbol % 3 ELSE 0.5 + accuracy END AS DOUBLE) AS rmse,
 CASE model WHEN 'random_forest' THEN 0.4 WHEN 'decision_tree' THEN 0.3 ELSE 0.3 END::DOUBLE AS w0 FROM px)"""
KEYS = ["symbol", "horizon"]


@query("extrapolate", f"WITH {MODELS} SELECT symbol, horizon, model, {q6('pct', 'pct')} FROM mp")
def extrapolate(spark, d):
    return out(fc.extrapolate(*next_day_models(spark, d)), ["pct"], [*KEYS, "model"])


@query("price_from_pct", f"WITH {MODELS} SELECT symbol, horizon, model, {q6('price', 'price')} FROM mp")
def price_from_pct(spark, d):
    return out(model_prices(spark, d), ["price"], [*KEYS, "model"])


ACC1 = """greatest(least(CASE WHEN coalesce(nullif(accuracy, 0), 0.5) < 0 THEN 10.0 * (1.0 + accuracy) ELSE coalesce(nullif(accuracy, 0), 0.5) * 100.0 *
 CASE WHEN model = 'random_forest' THEN 1.03 ELSE 1.0 END END, 100.0), 0.0)"""
ACCE = """coalesce(greatest(least(100.0 * avg(CASE WHEN accuracy < 0 THEN greatest(0.1 * (1.0 + accuracy), 0.0) ELSE accuracy *
 CASE WHEN model = 'random_forest' THEN 1.03 ELSE 1.0 END END), 100.0), 0.0), 50.0)"""
CV = "(stddev_pop(price) / nullif(abs(avg(price)), 0))"
AGREE = f"""CASE WHEN count(price) < 2 THEN 70.0 WHEN avg(price) = 0 THEN 50.0 WHEN {CV} <= 0.02 THEN 100.0 WHEN {CV} <= 0.05 THEN 100.0 - ({CV} - 0.02) * 500.0
 WHEN {CV} <= 0.10 THEN 85.0 - ({CV} - 0.05) * 300.0 WHEN {CV} <= 0.20 THEN 70.0 - ({CV} - 0.10) * 300.0 WHEN {CV} <= 0.50 THEN 40.0 - ({CV} - 0.20) * 100.0 ELSE 10.0 END"""
DECAY = """CASE WHEN days <= 1 THEN 100.0 WHEN days <= 7 THEN 100.0 - (days - 1) * 10.0 / 6.0 WHEN days <= 30 THEN 90.0 - (days - 7) * 10.0 / 23.0
 WHEN days <= 365 THEN 80.0 - (days - 30) * 15.0 / 335.0 WHEN days <= 1825 THEN 65.0 - (days - 365) * 20.0 / 1460.0 ELSE 45.0 - least(20.0, (days - 1825) * 0.01) END"""


@query("accuracy_score", f"WITH {MODELS} SELECT symbol, horizon, {q6(ACCE, 'accuracy_score')} FROM mp GROUP BY symbol, horizon")
def accuracy_score(spark, d):
    g = model_prices(spark, d).groupBy(*KEYS).agg(conf.accuracy_ensemble().alias("accuracy_score"))
    return out(g, ["accuracy_score"], KEYS)


@query("agreement_score", f"WITH {MODELS} SELECT symbol, horizon, {q6(AGREE, 'agreement_score')} FROM mp GROUP BY symbol, horizon")
def agreement_score(spark, d):
    return out(model_prices(spark, d).groupBy(*KEYS).agg(conf.agreement().alias("agreement_score")), ["agreement_score"], KEYS)


VOLS = f"""vb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM bars),
vr AS (SELECT *, {div('close', lag('close'))} - 1.0 AS r FROM vb WHERE back <= 252),
vs AS (SELECT symbol, count(*) AS n, stddev_pop(r) * sqrt(252.0) AS v FROM vr GROUP BY symbol),
vol AS (SELECT symbol, v, CASE WHEN n < 30 THEN 50.0 ELSE greatest(least(CASE WHEN v <= 0.15 THEN 100.0 - v * 100.0 WHEN v <= 0.30 THEN 85.0 - (v - 0.15) * 100.0
 WHEN v <= 0.50 THEN 70.0 - (v - 0.30) * 100.0 WHEN v <= 1.0 THEN 50.0 - (v - 0.50) * 60.0 ELSE 20.0 - least(20.0, (v - 1.0) * 10.0) END, 100.0), 0.0) END AS volatility_score FROM vs)"""


@query("volatility_score", f"WITH {BARS_S}, {VOLS} SELECT symbol, {q6('v', 'annual_volatility')}, {q6('volatility_score', 'volatility_score')} FROM vol")
def volatility_score(spark, d):
    return out(conf.volatility_score(t.bars_supplier(spark, d)), ["annual_volatility", "volatility_score"], ["symbol"])


@query("time_decay_score", f"WITH o AS (SELECT p_partkey, p_size * 50 AS days FROM part) SELECT p_partkey, CAST(days AS INTEGER) AS days, {q6(DECAY, 'score')} FROM o")
def time_decay_score(spark, d):
    rows = t.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 50).alias("days"))
    return rows.select("p_partkey", "days", r6(conf.time_decay_score("days")).alias("score"))


CONF1 = f"greatest(least(0.50 * ({ACC1}) + 0.25 * volatility_score + 0.25 * ({DECAY}), 100.0), 0.0)"


@query("confidence_single", f"WITH {MODELS}, {VOLS} SELECT symbol, horizon, model, {q6(CONF1, 'confidence')} FROM mp JOIN vol USING (symbol)")
def confidence_single(spark, d):
    v = conf.volatility_score(nation_bars(spark, d))
    m = model_prices(spark, d).join(v, "symbol")
    score = conf.confidence_single(conf.accuracy_single("accuracy", "model"), "volatility_score", conf.time_decay_score("days"))
    return out(m.withColumn("confidence", score), ["confidence"], [*KEYS, "model"])


GROUPED = f"gr AS (SELECT symbol, horizon, days, {ACCE} AS acc, {AGREE} AS agree, sum(price * w0 * (0.5 + accuracy)) / sum(w0 * (0.5 + accuracy)) AS ep, stddev_pop(price) AS sd, avg(accuracy) AS ma FROM mp GROUP BY symbol, horizon, days)"
CONFE = f"greatest(least(0.30 * acc + 0.25 * agree + 0.20 * volatility_score + 0.25 * ({DECAY}), 100.0), 0.0)"


@query("confidence_ensemble", f"WITH {MODELS}, {VOLS}, {GROUPED} SELECT symbol, horizon, {q6(CONFE, 'confidence')} FROM gr JOIN vol USING (symbol)")
def confidence_ensemble(spark, d):
    g = model_prices(spark, d).groupBy(*KEYS, "days").agg(conf.accuracy_ensemble().alias("a"), conf.agreement().alias("g"))
    g = g.join(conf.volatility_score(nation_bars(spark, d)), "symbol")
    return out(g.withColumn("confidence", conf.confidence_ensemble("a", "g", "volatility_score", conf.time_decay_score("days"))), ["confidence"], KEYS)


@query("ensemble_fixed", f"WITH {MODELS} SELECT symbol, horizon, {q6('sum(price * w0) / sum(w0)', 'ensemble_price')} FROM mp GROUP BY symbol, horizon")
def ensemble_fixed(spark, d):
    return out(ens.ensemble_fixed(model_prices(spark, d), KEYS), ["ensemble_price"], KEYS)


@query("ensemble_accuracy_adjusted", f"WITH {MODELS}, {GROUPED} SELECT symbol, horizon, {q6('ep', 'ensemble_price')} FROM gr")
def ensemble_accuracy_adjusted(spark, d):
    return out(ens.ensemble_accuracy_adjusted(model_prices(spark, d), KEYS), ["ensemble_price"], KEYS)


INV = "inv AS (SELECT *, CASE WHEN rmse > 0 THEN 1.0 / rmse ELSE 0.0 END AS ir FROM mp), wt AS (SELECT *, ir / sum(ir) OVER (PARTITION BY symbol, horizon) AS weight, avg(price) OVER (PARTITION BY symbol, horizon) AS mean FROM inv)"


@query("ensemble_inverse_rmse", f"WITH {MODELS}, {INV} SELECT symbol, horizon, {q6('sum(price * weight)', 'ensemble_price')} FROM wt GROUP BY symbol, horizon")
def ensemble_inverse_rmse(spark, d):
    return out(ens.ensemble_inverse_rmse(model_prices(spark, d), KEYS), ["ensemble_price"], KEYS)


@query("variance_confidence", f"WITH {MODELS}, {INV} SELECT symbol, horizon, {q6('greatest(least(100.0 * (1.0 - sqrt(sum(weight * (price - mean) * (price - mean))) / abs(any_value(mean))), 100.0), 0.0)', 'confidence')} FROM wt GROUP BY symbol, horizon")
def variance_confidence(spark, d):
    w = ens.inverse_rmse_weights(model_prices(spark, d), KEYS)
    return out(ens.variance_confidence(w, KEYS), ["confidence"], KEYS)


@query(
    "confidence_interval",
    f"WITH {MODELS}, {GROUPED} SELECT symbol, horizon, {q6('ep', 'ensemble_price')}, {q6('greatest(ep - 1.96 * sd, 0.0)', 'confidence_low')}, {q6('ep + 1.96 * sd', 'confidence_high')} FROM gr",
)
def confidence_interval(spark, d):
    return out(ens.confidence_interval(model_prices(spark, d), KEYS), ["ensemble_price", "confidence_low", "confidence_high"], KEYS)


@query(
    "confidence_interval_legacy",
    f"WITH {MODELS}, {GROUPED} SELECT symbol, horizon, {q6('greatest(ep - 1.96 * sd, ep * 0.5)', 'confidence_low')}, {q6('greatest(ep + 1.96 * sd, ep * 1.5)', 'confidence_high')} FROM gr",
)
def confidence_interval_legacy(spark, d):
    return out(ens.confidence_interval(model_prices(spark, d), KEYS, True), ["confidence_low", "confidence_high"], KEYS)


@query(
    "price_range",
    f"WITH {MODELS}, {INV} SELECT symbol, horizon, {q6('greatest(sum(price * weight) - 1.96 * stddev_pop(price), 0.0)', 'range_low')}, {q6('sum(price * weight) + 1.96 * stddev_pop(price)', 'range_high')} FROM wt GROUP BY symbol, horizon",
)
def price_range(spark, d):
    w = ens.inverse_rmse_weights(model_prices(spark, d), KEYS)
    return out(ens.price_range(w, KEYS), ["range_low", "range_high"], KEYS)


def rnd(e, k, name):
    return f"floor(({e}) * {10.0**k} + 0.5000001) / {10.0**k} AS {name}"


AS_OF = "2002-01-01"
STORED = f"DATE '{AS_OF}' + CAST(days AS INTEGER) AS date"


@query(
    "prediction_rows",
    f"""WITH {MODELS}, {VOLS}, {GROUPED}, pts AS (SELECT symbol, count(*) AS data_points_used FROM bars GROUP BY symbol),
a AS (SELECT symbol, days, horizon, ep AS pp, {CONFE} AS c, greatest(ep - 1.96 * sd, 0.0) AS lo, ep + 1.96 * sd AS hi, 'random_forest|decision_tree|linear_regression' AS algorithm_used, ma
 FROM gr JOIN vol USING (symbol) UNION ALL
 SELECT symbol, days, horizon, price, {CONF1}, price * 0.95, price * 1.05, model, accuracy FROM mp JOIN vol USING (symbol))
SELECT symbol, CASE WHEN symbol % 2 = 0 THEN 'us_stocks' ELSE 'ind_stocks' END AS category, {STORED}, horizon, {rnd('pp', 2, 'predicted_price')},
 {rnd('current_price', 2, 'current_price')}, {rnd('c', 1, 'confidence')}, {rnd('lo', 2, 'confidence_low')}, {rnd('hi', 2, 'confidence_high')}, algorithm_used,
 'USD' AS currency, TIMESTAMP '{AS_OF} 00:00:00' AS last_updated, {rnd('ma', 4, 'model_accuracy')}, data_points_used FROM a JOIN cur USING (symbol) JOIN pts USING (symbol)""",
)
def prediction_rows(spark, d):
    b = nation_bars(spark, d)
    return fc.prediction_rows(
        model_prices(spark, d).select("symbol", "horizon", "days", "model", "price", "accuracy"),
        fc.symbol_context(b, b), AS_OF, [m for m in MODEL_WEIGHTS if MODEL_WEIGHTS[m] > 0],
    )


@query(
    "recency_weighted_forecast",
    f"""WITH {BARS_S}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM bars),
c AS (SELECT *, close - {lag('close')} AS chg FROM r WHERE back <= 5),
g AS (SELECT symbol, sum(chg * (5 - back)) AS wc, avg(volume) AS vol, max(CASE WHEN back = 1 THEN close END) AS last FROM c GROUP BY symbol),
v AS (SELECT g.symbol, avg((chg - wc / 4.0) * (chg - wc / 4.0)) AS var FROM g JOIN c USING (symbol) WHERE chg IS NOT NULL GROUP BY g.symbol)
SELECT symbol, {q6('last', 'last_price')}, {q6('greatest(last + wc / 10.0, 0.01)', 'predicted_price')},
 {q6('greatest(least((greatest(0.1, 1.0 - var / (last * 0.1)) * 0.7 + least(1.0, vol / 1e7) * 0.3) * 100.0, 90.0), 20.0)', 'confidence')} FROM g JOIN v USING (symbol)""",
)
def recency_weighted_forecast(spark, d):
    return out(fc.recency_weighted_forecast(t.bars_supplier(spark, d)), ["last_price", "predicted_price", "confidence"], ["symbol"])


@query("per_symbol_train_and_forecast")
def per_symbol_train_and_forecast(spark, d):
    return fc.per_symbol_train_and_forecast(ft.features_c(t.bars_nation(spark, d)))
