"""Time-series models: one fit per symbol, all symbols in one job.

A symbol's series has at most one value per calendar day, so a grouped map over symbols works
on groups of bounded size. Models are rows of a table, not files.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwright.functions.windows import by_symbol
from tickwright.schema import INTERVAL_Z, MIN_TRAINING_ROWS


def difference(df: DataFrame, d: int = 1, c: str = "close", out: str = "diff") -> DataFrame:
    """d-th order difference; the first d rows are NULL."""
    df = df.withColumn(out, F.col(c))
    for _ in range(d):
        df = df.withColumn(out, F.col(out) - F.lag(out).over(by_symbol()))
    return df


def undifference(forecasts: DataFrame, last: DataFrame, step: str = "step", value: str = "diff") -> DataFrame:
    """Levels from forecast differences: last level plus their running sum."""
    run = Window.partitionBy("symbol").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return forecasts.join(last, "symbol").withColumn("level", F.col("last_close") + F.sum(value).over(run))


def autocorr(df: DataFrame, lags: list[int], c: str = "x") -> DataFrame:
    """Per symbol and lag: sum of (x_t - m)(x_{t+l} - m) over ((n - l) var_pop)."""
    every = Window.partitionBy("symbol")
    m = df.where(F.col(c).isNotNull()).withColumns(
        {"_m": F.avg(c).over(every), "_v": F.var_pop(c).over(every), "_n": F.count(F.lit(1)).over(every)}
    )
    centred = m.withColumn("_c", F.col(c) - F.col("_m"))
    ahead = {f"_a{k}": F.lead("_c", k).over(by_symbol()) for k in lags if k}
    wide = centred.withColumns({**ahead, **({"_a0": F.col("_c")} if 0 in lags else {})})
    sums = wide.groupBy("symbol").agg(
        F.first("_n").alias("n"), F.first("_v").alias("v"), *[F.sum(F.col("_c") * F.col(f"_a{k}")).alias(f"s{k}") for k in lags]
    )
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"s{k}"), (F.col("n") - k) * F.col("v")).alias("autocorr"))
            for k in lags
        ]
    )
    return sums.select("symbol", F.inline(rows))


def fit_ar(df: DataFrame, p: int, c: str = "x", legacy: bool = False) -> DataFrame:
    """Yule-Walker coefficients per symbol.

    ``legacy`` takes the off-diagonal terms one lag further, as the source system did.
    p of 1 and 2 are closed forms in SQL; larger orders solve small systems per symbol.
    """
    reach = 1 if legacy else 0
    ac = autocorr(df, list(range(1, p + 1 + reach)), c)
    wide = ac.groupBy("symbol").agg(*[F.max(F.when(F.col("lag") == k, F.col("autocorr"))).alias(f"r{k}") for k in range(1, p + 1 + reach)])
    if p == 1:
        return wide.select("symbol", F.col("r1").alias("phi1"))
    if p == 2:
        off = F.col("r2") if legacy else F.col("r1")
        det = F.lit(1.0) - off * off
        return wide.select(
            "symbol",
            F.try_divide(F.col("r1") - off * F.col("r2"), det).alias("phi1"),
            F.try_divide(F.col("r2") - off * F.col("r1"), det).alias("phi2"),
        )
    names = [f"phi{i + 1}" for i in range(p)]
    schema = ", ".join(["symbol " + df.schema["symbol"].dataType.simpleString(), *[f"{n} double" for n in names]])

    def solve(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            r = b[[f"r{k}" for k in range(1, p + 1 + reach)]].to_numpy(float)
            lagged = np.c_[np.ones(len(r)), r]
            off = np.abs(np.subtract.outer(np.arange(p), np.arange(p)))
            idx = np.where(off == 0, 0, off + reach)
            phi = [np.linalg.lstsq(row[idx], row[1 : p + 1], rcond=None)[0] for row in np.nan_to_num(lagged)]
            yield pd.DataFrame(np.array(phi).reshape(-1, p), columns=names).assign(symbol=b["symbol"].to_numpy())[["symbol", *names]]

    return wide.mapInPandas(solve, schema)


def ar_residuals(df: DataFrame, coefs: DataFrame, p: int, c: str = "x", out: str = "residual") -> DataFrame:
    """x_t minus the weighted earlier values from row p on, 0 before (not mean-centred)."""
    w = by_symbol()
    fitted = F.lit(0.0)
    for i in range(1, p + 1):
        fitted = fitted + F.col(f"phi{i}") * F.lag(c, i).over(w)
    joined = df.join(coefs, "symbol")
    value = F.when(F.row_number().over(w) > p, F.col(c) - fitted).otherwise(F.lit(0.0))
    return joined.withColumn(out, value).drop(*[f"phi{i}" for i in range(1, p + 1)])


def fit_ma(residuals: DataFrame, q: int, c: str = "residual") -> DataFrame:
    """Autocorrelation of the residuals at lags 1..q, as moving-average weights."""
    ac = autocorr(residuals, list(range(1, q + 1)), c)
    return ac.groupBy("symbol").agg(*[F.max(F.when(F.col("lag") == k, F.col("autocorr"))).alias(f"theta{k}") for k in range(1, q + 1)])


def dickey_fuller(df: DataFrame, c: str = "close", critical: float = -2.86) -> DataFrame:
    """t statistic of the change regressed on the previous level, against the 5 % value."""
    w = by_symbol()
    pairs = df.withColumn("_y0", F.lag(c).over(w)).withColumn("_dy", F.col(c) - F.col("_y0")).where(F.col("_y0").isNotNull())
    g = pairs.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("_dy", "_y0").alias("b"),
        F.regr_sxx("_dy", "_y0").alias("sxx"),
        F.regr_syy("_dy", "_y0").alias("syy"),
        F.regr_sxy("_dy", "_y0").alias("sxy"),
    )
    sse = F.col("syy") - F.col("b") * F.col("sxy")
    t = F.try_divide(F.col("b"), F.sqrt(F.try_divide(F.try_divide(sse, F.col("n") - 2), F.col("sxx"))))
    return g.select("symbol", t.alias("t_stat"), (t < critical).alias("stationary"))


# MacKinnon's response surface of the unit-root p-value with a constant. Between the
# least and the largest statistic the p-value is the normal distribution of a polynomial, one for
# statistics up to the border and one above it.
TAU_LEAST, TAU_BORDER, TAU_LARGEST = -18.83, -1.61, 2.74
TAU_SMALL = [2.1659, 1.4412, 0.038269]
TAU_LARGE = [1.7339, 0.93202, -0.12745, -0.010368]


def unit_root_p(t: float) -> float:
    """p-value of a unit-root statistic from a regression with a constant."""
    if t != t:
        return float("nan")
    if t > TAU_LARGEST:
        return 1.0
    if t < TAU_LEAST:
        return 0.0
    z = sum(c * t**i for i, c in enumerate(TAU_SMALL if t <= TAU_BORDER else TAU_LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def unit_root_fit(x, lags: int, skip: int = 0):
    """(t statistic, AIC, rows) of the change on a constant, the previous level and ``lags`` earlier
    changes, over all rows but the first ``skip`` usable ones; None if it cannot be fitted."""
    import numpy as np

    change = np.diff(x)
    first = max(lags, skip)
    y = change[first:]
    columns = [np.ones(len(y)), x[first:-1], *[change[first - k : len(change) - k] for k in range(1, lags + 1)]]
    a = np.column_stack(columns)
    n, k = a.shape
    if n <= k:
        return None
    # products of centred and scaled columns; levels may be far from zero
    mean, scale = a[:, 1:].mean(0), a[:, 1:].std(0)
    if not (scale > 0).all():
        return None
    z = (a[:, 1:] - mean) / scale
    gram, moment = z.T @ z, z.T @ (y - y.mean())
    if np.linalg.matrix_rank(gram) < len(gram):
        return None
    slopes = np.linalg.solve(gram, moment)
    rest = y - y.mean() - z @ slopes
    sse = float(rest @ rest)
    if sse <= 1e-24 * max(1.0, float(y @ y)):
        return None
    t = slopes[0] / math.sqrt(sse / (n - k) * np.linalg.inv(gram)[0, 0])
    return float(t), n * (math.log(2 * math.pi * sse / n) + 1) + 2 * k, n


def augmented_dickey_fuller(df: DataFrame, c: str = "close", lags: int | None = None, level: float = 0.05) -> DataFrame:
    """(symbol, t_stat, p_value, lags, rows, stationary): the unit-root test with lagged changes.

    The number of lags is that of the least AIC among 0 to 12 (n / 100)^(1/4), compared over the
    same rows, unless ``lags`` fixes it. Missing values are left out; a series that is constant, too
    short or exactly fitted has NULL figures and counts as not stationary. A symbol has one value a
    day, so a group is bounded.
    """
    import numpy as np
    import pandas as pd

    names = ["symbol", "t_stat", "p_value", "lags", "rows", "stationary"]

    def test(group):
        x = group.sort_values("date")[c].astype(float).to_numpy()
        x = x[np.isfinite(x)]
        best = lags
        if lags is None:
            most = max(0, min(len(x) // 2 - 2, math.ceil(12 * (len(x) / 100) ** 0.25)))
            tried = [(f[1], k) for k in range(most + 1) if len(x) > 3 and (f := unit_root_fit(x, k, most))]
            best = min(tried)[1] if tried else 0
        found = unit_root_fit(x, best) if len(x) > best + 3 else None
        t, n = (found[0], found[2]) if found else (float("nan"), 0)
        p = unit_root_p(t)
        return pd.DataFrame([(group["symbol"].iloc[0], t, p, best, n, bool(p < level))], columns=names)

    kind = df.schema["symbol"].dataType.simpleString()
    schema = f"symbol {kind}, t_stat double, p_value double, lags int, rows int, stationary boolean"
    out = df.select("symbol", "date", F.col(c).cast("double").alias(c)).groupBy("symbol").applyInPandas(test, schema)
    return out.withColumns({x: F.when(~F.isnan(x), F.col(x)) for x in ("t_stat", "p_value")})


def stationary_halves(df: DataFrame, c: str = "close", share: float = 0.1) -> DataFrame:
    """Do mean and variance of the two halves agree within a share of the first half's?"""
    w = by_symbol()
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    halves = df.withColumn("_first", F.row_number().over(w) <= F.floor(n / 2))
    x1, x2 = F.when(F.col("_first"), F.col(c)), F.when(~F.col("_first"), F.col(c))
    g = halves.groupBy("symbol").agg(
        F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.var_pop(x1).alias("v1"), F.var_pop(x2).alias("v2")
    )
    ok = (F.abs(F.col("m1") - F.col("m2")) < F.abs("m1") * share) & (F.abs(F.col("v1") - F.col("v2")) < F.col("v1") * share)
    return g.select("symbol", "m1", "m2", "v1", "v2", F.coalesce(ok, F.lit(False)).alias("stationary"))


# ---- grouped ARIMA ---------------------------------------------------------------------------------


def _design(y, p, q, e):
    import numpy as np

    m = max(p, q)
    cols = [np.ones(len(y) - m)]
    cols += [y[m - i : len(y) - i] for i in range(1, p + 1)]
    cols += [e[m - i : len(e) - i] for i in range(1, q + 1)]
    return np.column_stack(cols), y[m:]


def fit_series(x, order, compared: int | None = None):
    """Two-stage least squares for one series: a long autoregression, then lags and shocks.

    Returns (constant, ar, ma, variance, aic, residuals) of the differenced series, or None. The
    criterion is taken over the last ``compared`` rows (all by default): over the same rows, orders
    and degrees of differencing have likelihoods of the same data.
    """
    import numpy as np

    p, d, q = order
    y = np.diff(x, n=d) if d else np.asarray(x, float)
    if len(y) < 10 + 3 * (p + q):
        return None
    e = np.zeros(len(y))
    if q:
        m = min(max(p, q) + 4, len(y) // 4)
        a, b = _design(y, m, 0, e)
        e[m:] = b - a @ np.linalg.lstsq(a, b, rcond=None)[0]
    a, b = _design(y, p, q, e)
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    r = b - a @ beta
    sigma2 = float((r @ r) / len(r))
    if not np.isfinite(sigma2):
        return None
    last = r[-compared:] if compared else r
    if compared and len(last) < compared:
        return None
    aic = len(last) * np.log(max(float(last @ last) / len(last), 1e-300)) + 2.0 * (p + q + 2)
    res = np.concatenate([np.zeros(len(y) - len(r)), r])
    return float(beta[0]), beta[1 : 1 + p], beta[1 + p :], sigma2, float(aic), res


ORDERS = [(p, d, q) for d in range(3) for p in range(4) for q in range(4)]
MODEL_SCHEMA = (
    "symbol {0}, p int, d int, q int, constant double, ar array<double>, ma array<double>, "
    "sigma2 double, aic double, r2 double, row_count bigint"
)


def _fit_group(pdf, orders):
    import numpy as np
    import pandas as pd

    pdf = pdf.sort_values("date")
    x = pdf["x"].to_numpy(float)
    best = None
    compared = len(x) - max((max(p, q) + d for p, d, q in orders), default=0)
    for order in orders:
        fit = fit_series(x, order, compared) if compared > 0 else None
        if fit is not None and (best is None or fit[4] < best[1][4]):
            best = (order, fit)
    names = ["symbol", "p", "d", "q", "constant", "ar", "ma", "sigma2", "aic", "r2", "row_count"]
    if best is None:
        return pd.DataFrame(columns=names)
    (p, d, q), (const, ar, ma, sigma2, aic, res) = best
    tail = x[-len(res) :] if len(res) else x
    sst = float(((tail - tail.mean()) ** 2).sum())
    r2 = 1.0 - float((res**2).sum()) / sst if sst > 0 else 0.0
    row = (pdf["symbol"].iloc[0], p, d, q, const, list(ar), list(ma), sigma2, aic, r2, len(x))
    return pd.DataFrame([row], columns=names)


def arima_fit_all(df: DataFrame, c: str = "close", orders=None, min_rows: int = MIN_TRAINING_ROWS) -> DataFrame:
    """A model row per symbol with at least ``min_rows`` values: order, weights, aic and R²."""
    orders = list(orders or [(1, 1, 1)])
    rows = df.select("symbol", "date", F.col(c).cast("double").alias("x")).where(F.col("x").isNotNull())

    def fit(pdf):
        return _fit_group(pdf, orders if len(pdf) >= min_rows else [])

    return rows.groupBy("symbol").applyInPandas(fit, MODEL_SCHEMA.format(df.schema["symbol"].dataType.simpleString()))


def arima_order_search(df: DataFrame, c: str = "close", min_rows: int = MIN_TRAINING_ROWS) -> DataFrame:
    """The order with the least AIC per symbol over p, q up to 3 and d up to 2."""
    return arima_fit_all(df, c, ORDERS, min_rows)


def _pair(df: DataFrame, models: DataFrame, c: str):
    rows = df.select("symbol", "date", F.col(c).cast("double").alias("x")).where(F.col("x").isNotNull())
    return rows.groupBy("symbol").cogroup(models.groupBy("symbol"))


def _state(x, m):
    """Residuals of a stored model on its own series."""
    import numpy as np

    d, ar, ma = int(m["d"]), list(m["ar"]), list(m["ma"])
    y = np.diff(x, n=d) if d else x
    e = np.zeros(len(y))
    start = max(len(ar), len(ma))
    if start < len(y):
        rest = y[start:] - m["constant"]
        for i, a in enumerate(ar, 1):
            rest = rest - a * y[start - i : len(y) - i]
        if ma:  # each shock needs the ones before it
            shocks = [0.0] * len(ma)
            for t, value in enumerate(rest.tolist(), start):
                value -= sum(b * v for b, v in zip(ma, shocks))
                shocks = [value, *shocks[:-1]]
                e[t] = value
        else:
            e[start:] = rest
    return y, e, ar, ma, d


def arima_forecast(df: DataFrame, models: DataFrame, steps: int = 5, c: str = "close", z: float = INTERVAL_Z) -> DataFrame:
    """Mean and 95 % bounds per step: recursion with zero future shocks, psi-weight variance."""
    kind = df.schema["symbol"].dataType.simpleString()

    def run(pdf, mdf):
        import numpy as np
        import pandas as pd

        names = ["symbol", "step", "mean", "lower", "upper"]
        if len(pdf) == 0 or len(mdf) == 0:
            return pd.DataFrame(columns=names)
        x = pdf.sort_values("date")["x"].to_numpy(float)
        m = mdf.iloc[0]
        y, e, ar, ma, d = _state(x, m)
        hist, shocks = list(y), list(e)
        for _ in range(steps):
            v = m["constant"] + sum(a * hist[-i - 1] for i, a in enumerate(ar)) + sum(b * shocks[-i - 1] for i, b in enumerate(ma))
            hist.append(v)
            shocks.append(0.0)
        level = np.array(hist[-steps:])
        poly = np.r_[1.0, -np.array(ar)] if ar else np.ones(1)
        for _ in range(d):
            poly = np.convolve(poly, [1.0, -1.0])
        for k in range(d, 0, -1):
            last = np.diff(x, n=k - 1)[-1] if k > 1 else x[-1]
            level = last + np.cumsum(level)
        psi = np.zeros(steps)
        for j in range(steps):
            psi[j] = (1.0 if j == 0 else (ma[j - 1] if j - 1 < len(ma) else 0.0)) - sum(
                poly[i] * psi[j - i] for i in range(1, min(j, len(poly) - 1) + 1)
            )
        half = z * np.sqrt(m["sigma2"] * np.cumsum(psi**2))
        return pd.DataFrame(
            {"symbol": pdf["symbol"].iloc[0], "step": np.arange(1, steps + 1), "mean": level, "lower": level - half, "upper": level + half}
        )

    return _pair(df, models, c).applyInPandas(run, f"symbol {kind}, step int, mean double, lower double, upper double")


def arima_residuals(df: DataFrame, models: DataFrame, c: str = "close") -> DataFrame:
    """Residual of every row of the differenced series under its symbol's model."""
    kind = df.schema["symbol"].dataType.simpleString()

    def run(pdf, mdf):
        import pandas as pd

        if len(pdf) == 0 or len(mdf) == 0:
            return pd.DataFrame(columns=["symbol", "date", "residual"])
        pdf = pdf.sort_values("date")
        m = mdf.iloc[0]
        _, e, *_ = _state(pdf["x"].to_numpy(float), m)
        out = pdf[["symbol", "date"]].iloc[int(m["d"]) :].copy()
        out["residual"] = e
        return out

    return _pair(df, models, c).applyInPandas(run, f"symbol {kind}, date date, residual double")



def ar_forecast(df: DataFrame, p: int, q: int, d: int, steps: int, c: str = "close", legacy: bool = False) -> DataFrame:
    """Forecasts from Yule-Walker AR weights and residual-autocorrelation MA weights.

    The differenced series is mean-centred unless ``legacy``; future shocks are zero and the
    levels are rebuilt from the last close.
    """
    base = difference(df.select("symbol", "date", F.col(c).cast("double").alias("close")), d, "close", "x0").where(F.col("x0").isNotNull())
    mean = F.lit(0.0) if legacy else F.avg("x0").over(Window.partitionBy("symbol"))
    series = base.withColumn("mu", mean).withColumn("x", F.col("x0") - F.col("mu"))
    coefs = fit_ar(series, p, "x", legacy)
    resid = ar_residuals(series, coefs, p)
    thetas = fit_ma(resid, q) if q else None
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    keep = max(p, q, 1)
    tail = resid.withColumn("_b", back).where(F.col("_b") <= keep)
    state = tail.groupBy("symbol").agg(
        F.max_by("close", "date").alias("last_close"),
        F.max("mu").alias("mu"),
        *[F.max(F.when(F.col("_b") == i, F.col("x"))).alias(f"x{i}") for i in range(1, keep + 1)],
        *[F.max(F.when(F.col("_b") == i, F.col("residual"))).alias(f"e{i}") for i in range(1, keep + 1)],
    )
    state = state.join(coefs, "symbol")
    if thetas is not None:
        state = state.join(thetas, "symbol")
    values = []
    for s in range(1, steps + 1):
        v = F.lit(0.0)
        for i in range(1, p + 1):
            lagged = values[s - i - 1] if s - i >= 1 else F.col(f"x{i - s + 1}")
            v = v + F.col(f"phi{i}") * lagged
        for j in range(s, q + 1):
            v = v + F.col(f"theta{j}") * F.col(f"e{j - s + 1}")
        name = f"v{s}"
        state = state.withColumn(name, v)
        values.append(F.col(name))
    rows = F.array(*[F.struct(F.lit(s).alias("step"), (values[s - 1] + F.col("mu")).alias("diff")) for s in range(1, steps + 1)])
    flat = state.select("symbol", "last_close", F.inline(rows))
    if d == 0:
        return flat.select("symbol", "step", F.col("diff").alias("level"))
    if d > 1:
        raise ValueError("use arima_forecast for d > 1")
    return undifference(flat.drop("last_close"), flat.select("symbol", "last_close").distinct()).select("symbol", "step", "level")
