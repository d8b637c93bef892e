"""Queries for the per-symbol time-series models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwright.functions.numeric import r6
from tickwright.operators import timeseries as ts
from tickwright.sources import tables as t

from .p06_indicators import out
from .registry import BARS_N, lag, query
from .registry import r6 as q6

WIN = "OVER (PARTITION BY symbol)"


@query("difference", f"WITH {BARS_N}, a AS (SELECT *, close - {lag('close')} AS d1 FROM bars), b AS (SELECT *, d1 - {lag('d1')} AS d2 FROM a) SELECT symbol, date, {q6('d1', 'd1')}, {q6('d2', 'd2')} FROM b")
def difference(spark, d):
    return out(ts.difference(ts.difference(t.bars_nation(spark, d), 1, out="d1"), 2, out="d2"), ["d1", "d2"])


@query(
    "undifference",
    f"""WITH {BARS_N}, s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back, close - {lag('close')} AS d1 FROM bars),
f AS (SELECT symbol, 31 - back AS step, d1 AS diff FROM s WHERE back <= 30), l AS (SELECT symbol, close AS last_close FROM s WHERE back = 31)
SELECT symbol, CAST(step AS INTEGER) AS step, {q6('last_close + sum(diff) OVER (PARTITION BY symbol ORDER BY step)', 'level')} FROM f JOIN l USING (symbol)""",
)
def undifference(spark, d):
    """The last thirty changes of every symbol, rebuilt from the close before them."""
    from pyspark.sql import Window

    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    s = ts.difference(t.bars_nation(spark, d)).withColumn("back", back)
    f = s.where(F.col("back") <= 30).select("symbol", (F.lit(31) - F.col("back")).alias("step"), "diff")
    last = s.where(F.col("back") == 31).select("symbol", F.col("close").alias("last_close"))
    return out(ts.undifference(f, last), ["level"], ["symbol", "step"])


def changes(spark, d):
    """Mean-free first differences of the close."""
    x = ts.difference(t.bars_nation(spark, d).select("symbol", "date", "close"), 1, out="x")
    return x.where(F.col("x").isNotNull())


DX = f"""dx0 AS (SELECT symbol, date, close - {lag('close')} AS x FROM bars), dx AS (SELECT *, x - avg(x) {WIN} AS c, var_pop(x) {WIN} AS v, count(*) {WIN} AS n FROM dx0 WHERE x IS NOT NULL),
la AS (SELECT *, lead(c, 1) OVER (PARTITION BY symbol ORDER BY date) AS a1, lead(c, 2) OVER (PARTITION BY symbol ORDER BY date) AS a2,
 lead(c, 3) OVER (PARTITION BY symbol ORDER BY date) AS a3 FROM dx),
ac AS (SELECT symbol, sum(c * a1) / ((any_value(n) - 1) * any_value(v)) AS r1, sum(c * a2) / ((any_value(n) - 2) * any_value(v)) AS r2,
 sum(c * a3) / ((any_value(n) - 3) * any_value(v)) AS r3 FROM la GROUP BY symbol)"""


@query("autocorr", f"WITH {BARS_N}, {DX} SELECT symbol, CAST(1 AS INTEGER) AS lag, {q6('r1', 'autocorr')} FROM ac UNION ALL SELECT symbol, 2, {q6('r2', 'autocorr')} FROM ac UNION ALL SELECT symbol, 3, {q6('r3', 'autocorr')} FROM ac")
def autocorr(spark, d):
    return out(ts.autocorr(changes(spark, d), [1, 2, 3]), ["autocorr"], ["symbol", "lag"])


PHI = "ph AS (SELECT symbol, (r1 - r1 * r2) / (1 - r1 * r1) AS phi1, (r2 - r1 * r1) / (1 - r1 * r1) AS phi2 FROM ac)"


@query("fit_ar", f"WITH {BARS_N}, {DX}, {PHI} SELECT symbol, {q6('phi1', 'phi1')}, {q6('phi2', 'phi2')} FROM ph")
def fit_ar(spark, d):
    return out(ts.fit_ar(changes(spark, d), 2), ["phi1", "phi2"], ["symbol"])


@query("fit_ar_legacy", f"WITH {BARS_N}, {DX} SELECT symbol, {q6('(r1 - r2 * r2) / (1 - r2 * r2)', 'phi1')}, {q6('(r2 - r2 * r1) / (1 - r2 * r2)', 'phi2')} FROM ac")
def fit_ar_legacy(spark, d):
    return out(ts.fit_ar(changes(spark, d), 2, legacy=True), ["phi1", "phi2"], ["symbol"])


@query("fit_ar_3")
def fit_ar_3(spark, d):
    return out(ts.fit_ar(changes(spark, d), 3), ["phi1", "phi2", "phi3"], ["symbol"])


RES = f"""rs AS (SELECT dx.symbol, date, x, CASE WHEN row_number() OVER (PARTITION BY dx.symbol ORDER BY date) > 2 THEN x - phi1 * lag(x, 1) OVER (PARTITION BY dx.symbol ORDER BY date)
 - phi2 * lag(x, 2) OVER (PARTITION BY dx.symbol ORDER BY date) ELSE 0.0 END AS residual FROM dx JOIN ph USING (symbol))"""


@query("ar_residuals", f"WITH {BARS_N}, {DX}, {PHI}, {RES} SELECT symbol, date, {q6('residual', 'residual')} FROM rs")
def ar_residuals(spark, d):
    x = changes(spark, d)
    return out(ts.ar_residuals(x, ts.fit_ar(x, 2), 2), ["residual"])


@query(
    "fit_ma",
    f"""WITH {BARS_N}, {DX}, {PHI}, {RES}, rc AS (SELECT symbol, date, residual - avg(residual) {WIN} AS c, var_pop(residual) {WIN} AS v, count(*) {WIN} AS n FROM rs),
rl AS (SELECT *, lead(c) OVER (PARTITION BY symbol ORDER BY date) AS a1, lead(c, 2) OVER (PARTITION BY symbol ORDER BY date) AS a2 FROM rc)
SELECT symbol, {q6('sum(c * a1) / ((any_value(n) - 1) * any_value(v))', 'theta1')}, {q6('sum(c * a2) / ((any_value(n) - 2) * any_value(v))', 'theta2')} FROM rl GROUP BY symbol""",
)
def fit_ma(spark, d):
    x = changes(spark, d)
    return out(ts.fit_ma(ts.ar_residuals(x, ts.fit_ar(x, 2), 2), 2), ["theta1", "theta2"], ["symbol"])


@query("arima_forecast")
def arima_forecast(spark, d):
    return out(ts.ar_forecast(t.bars_nation(spark, d), 2, 1, 1, 5), ["level"], ["symbol", "step"])


@query("arima_order_search")
def arima_order_search(spark, d):
    m = ts.arima_order_search(t.bars_nation(spark, d))
    return m.select("symbol", "p", "d", "q", r6("aic").alias("aic"), r6("r2").alias("r2"), "row_count")


def models(spark, d):
    """Each symbol's best of all 48 orders."""
    return ts.arima_order_search(t.bars_nation(spark, d))


@query("arima_fit_all")
def arima_fit_all(spark, d):
    return models(spark, d)


@query("arima_forecast_interval")
def arima_forecast_interval(spark, d):
    return ts.arima_forecast(t.bars_nation(spark, d), models(spark, d), 7)


@query("arima_residuals")
def arima_residuals(spark, d):
    return ts.arima_residuals(t.bars_nation(spark, d), models(spark, d))


@query(
    "is_stationary_adf",
    f"""WITH {BARS_N}, y AS (SELECT symbol, {lag('close')} AS y0, close - {lag('close')} AS dy FROM bars),
g AS (SELECT symbol, count(*) AS n, regr_slope(dy, y0) AS b, regr_sxx(dy, y0) AS sxx, regr_syy(dy, y0) AS syy, regr_sxy(dy, y0) AS sxy FROM y WHERE y0 IS NOT NULL GROUP BY symbol),
s AS (SELECT symbol, b / sqrt((syy - b * sxy) / (n - 2) / sxx) AS t FROM g) SELECT symbol, {q6('t', 't_stat')}, t < -2.86 AS stationary FROM s""",
)
def is_stationary_adf(spark, d):
    return ts.dickey_fuller(t.bars_nation(spark, d)).withColumn("t_stat", r6("t_stat"))


@query("augmented_dickey_fuller")
def augmented_dickey_fuller(spark, d):
    """The unit-root test with lagged changes, their number by AIC; tests compare it with least squares."""
    return ts.augmented_dickey_fuller(t.bars_nation(spark, d)).withColumns({c: r6(c) for c in ("t_stat", "p_value")})


@query(
    "is_stationary_halves",
    f"""WITH {BARS_N}, h AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) <= floor(count(*) {WIN} / 2) AS f FROM bars),
g AS (SELECT symbol, avg(close) FILTER (f) AS m1, avg(close) FILTER (NOT f) AS m2, var_pop(close) FILTER (f) AS v1, var_pop(close) FILTER (NOT f) AS v2 FROM h GROUP BY symbol)
SELECT symbol, {q6('m1', 'm1')}, {q6('m2', 'm2')}, {q6('v1', 'v1')}, {q6('v2', 'v2')}, abs(m1 - m2) < 0.1 * abs(m1) AND abs(v1 - v2) < 0.1 * v1 AS stationary FROM g""",
)
def is_stationary_halves(spark, d):
    return ts.stationary_halves(t.bars_nation(spark, d)).withColumns({c: r6(c) for c in ("m1", "m2", "v1", "v2")})
