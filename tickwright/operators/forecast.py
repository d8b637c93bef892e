"""Forecast rows: horizon blending, ensemble and per-model rows, batch and on-demand jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwright.functions.numeric import clip, ratio, round_to
from tickwright.functions.scalar import horizons
from tickwright.operators import confidence as conf
from tickwright.operators import ensemble as ens
from tickwright.operators.features import features_b, latest_features, target_pct
from tickwright.functions.windows import symbol_rows
from tickwright.operators.quality import validate_quality
from tickwright.schema import FEATURES_38, HORIZON_DAYS, MIN_SERVING_ROWS
from tickwright.session import materialize


def recent_targets(targets: DataFrame, n: int = 30) -> DataFrame:
    """Mean of the last ``n`` labels per symbol and how many there are."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    return (
        targets.select("symbol", "date", "label")
        .withColumn("_back", back)
        .where(F.col("_back") <= n)
        .groupBy("symbol")
        .agg(F.avg("label").alias("recent_mean"), F.count("label").alias("recent_n"))
    )


def blend(next_day: Column, recent_mean: Column, recent_n: Column, days: Column) -> Column:
    """Percent change over ``days``: the trend weighs more the longer the horizon."""
    trend = recent_mean * F.least(days, F.lit(30))
    w = F.least(F.lit(0.7), days / F.lit(365.0))
    return F.when(recent_n < 2, F.lit(0.0)).otherwise(w * trend + (F.lit(1.0) - w) * next_day)


def extrapolate(next_day: DataFrame, targets: DataFrame) -> DataFrame:
    """Per (symbol, model, horizon) the percent change; one day takes the model as it is."""
    rows = next_day.join(recent_targets(targets), "symbol", "left").select("*", F.inline(horizons()))
    n = F.coalesce("recent_n", F.lit(0))
    mean = F.coalesce("recent_mean", F.lit(0.0))
    pct = F.when(F.col("days") == 1, F.col("next_day")).otherwise(blend(F.col("next_day"), mean, n, F.col("days")))
    return rows.withColumn("pct", pct).drop("recent_mean", "recent_n")


def prediction_rows(
    models: DataFrame, context: DataFrame, as_of: str, names_in_order: list[str], kinds=("ensemble", "model")
) -> DataFrame:
    """Per symbol and horizon one ensemble row and one row per model, in the stored layout.

    ``models``: symbol, horizon, days, model, price, accuracy. ``context``: symbol, category,
    current_price, volatility_score, currency, data_points_used. Rounding happens here only.
    """
    keys = ["symbol", "horizon", "days"]
    order = F.array(*map(F.lit, names_in_order))
    names = F.concat_ws("|", F.filter(order, lambda m: F.array_contains(F.col("_names"), m)))
    g = models.groupBy(*keys).agg(
        ens.weighted_price("price", ens.adjusted_weight()).alias("predicted_price"),
        F.stddev_pop("price").alias("_sd"),
        F.count("price").alias("_n"),
        conf.accuracy_ensemble().alias("_acc"),
        conf.agreement().alias("_agree"),
        F.avg("accuracy").alias("model_accuracy"),
        F.collect_set(F.when(F.col("model").isin(names_in_order), F.col("model"))).alias("_names"),
    )
    low, high = ens.interval_bounds(F.col("predicted_price"), F.col("_sd"), F.col("_n"))
    decay = conf.time_decay_score("days")
    ensemble_rows = g.join(context, "symbol").select(
        *keys,
        "predicted_price",
        conf.confidence_ensemble("_acc", "_agree", "volatility_score", decay).alias("confidence"),
        low.alias("confidence_low"),
        high.alias("confidence_high"),
        names.alias("algorithm_used"),
        "model_accuracy",
        *[c for c in context.columns if c != "symbol"],
    )
    acc = conf.accuracy_single("accuracy", "model")
    single_rows = models.join(context, "symbol").select(
        *keys,
        F.col("price").alias("predicted_price"),
        conf.confidence_single(acc, "volatility_score", decay).alias("confidence"),
        (F.col("price") * 0.95).alias("confidence_low"),
        (F.col("price") * 1.05).alias("confidence_high"),
        F.col("model").alias("algorithm_used"),
        F.col("accuracy").alias("model_accuracy"),
        *[c for c in context.columns if c != "symbol"],
    )
    parts = [f for kind, f in (("ensemble", ensemble_rows), ("model", single_rows)) if kind in kinds]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.select(
        "symbol",
        "category",
        F.date_add(F.lit(as_of).cast("date"), F.col("days")).alias("date"),
        "horizon",
        *[round_to(c, 2).alias(c) for c in ("predicted_price", "current_price")],
        round_to("confidence", 1).alias("confidence"),
        *[round_to(c, 2).alias(c) for c in ("confidence_low", "confidence_high")],
        "algorithm_used",
        "currency",
        F.lit(as_of).cast("timestamp").alias("last_updated"),
        round_to("model_accuracy", 4).alias("model_accuracy"),
        "data_points_used",
    )


def symbol_context(bars: DataFrame, features: DataFrame) -> DataFrame:
    """Last close, volatility score, feature-row count and currency per symbol.

    Prices that were normalised to USD are tagged USD.
    """
    last = bars.groupBy("symbol", "category").agg(F.max_by("close", "date").alias("current_price"))
    points = features.groupBy("symbol").agg(F.count(F.lit(1)).alias("data_points_used"))
    vol = conf.volatility_score(bars).select("symbol", "volatility_score")
    return (
        last.join(points, "symbol")
        .join(vol, "symbol")
        .select("symbol", "category", "current_price", "volatility_score", F.lit("USD").alias("currency"), "data_points_used")
    )


def score_models(fitted: dict, rows: DataFrame) -> DataFrame:
    """(symbol, model, next_day) of every fitted model on the serving rows, in one frame."""
    from tickwright.operators.features import assemble

    vec = assemble(rows, FEATURES_38)
    out = None
    for name, model in fitted.items():
        one = model.transform(vec).select("symbol", F.lit(name).alias("model"), F.col("prediction").alias("next_day"))
        out = one if out is None else out.unionByName(one)
    return out


def batch_forecast(
    bars: DataFrame, fitted: dict, accuracy: dict[str, float], as_of: str, kinds=("ensemble", "model")
) -> DataFrame:
    """Quality gate, features, five horizons, ensemble and confidence for every symbol."""
    good = materialize(validate_quality(bars), "bars")
    long_enough = features_b(good).withColumn("_n", symbol_rows()).where(F.col("_n") >= MIN_SERVING_ROWS)
    # Read three times below (serving rows, targets, counts): stored once.
    features = materialize(long_enough.drop("_n"), "features")
    serving = latest_features(features)
    next_day = score_models(fitted, serving)
    context = symbol_context(good, features)
    pct = extrapolate(next_day, target_pct(features))
    acc = F.create_map(*[F.lit(x) for kv in accuracy.items() for x in kv])
    models = (
        pct.join(context.select("symbol", "current_price"), "symbol")
        .withColumn("price", ens.price_from_pct("current_price", "pct"))
        .withColumn("accuracy", F.try_element_at(acc, F.col("model")))
        .select("symbol", "horizon", "days", "model", "price", "accuracy")
    )
    return prediction_rows(models, context, as_of, list(fitted), kinds)


def on_demand_forecast(
    bars: DataFrame, symbol, horizon: str, fitted: dict, accuracy: dict[str, float], as_of: str,
    model: str | None = None, price: float | None = None, rate: float = 83.5,
) -> DataFrame:
    """The forecast of one symbol and horizon with both currencies; filters reach the scan."""
    h = horizon.upper()
    if h not in HORIZON_DAYS:
        raise ValueError(f"invalid horizon {horizon}")
    if model is not None and model not in fitted:
        raise ValueError(f"unknown model {model}")
    one = bars.where(F.col("symbol") == symbol)
    used = fitted if model is None else {model: fitted[model]}
    kinds = ("ensemble",) if model is None else ("model",)
    out = batch_forecast(one, used, accuracy, as_of, kinds).where(F.col("horizon") == h)
    current = F.col("current_price") if price is None else F.lit(float(price))
    scale = ratio(current, "current_price", 1.0)
    for c in ("predicted_price", "confidence_low", "confidence_high"):
        out = out.withColumn(c, round_to(F.col(c) * scale, 2))
    return out.withColumn("current_price", current).withColumns(
        {
            "predicted_price_inr": round_to(F.col("predicted_price") * rate, 2),
            "current_price_inr": round_to(F.col("current_price") * rate, 2),
            "exchange_rate": F.lit(rate),
        }
    )


def recency_weighted_forecast(bars: DataFrame, k: int = 5) -> DataFrame:
    """Next close from the last ``k`` closes, later moves weighing more, with a confidence.

    Symbols with fewer than ``k`` bars are left out.
    """
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    recent = bars.select("symbol", "date", "close", "volume").withColumn("_back", back).where(F.col("_back") <= k)
    w = Window.partitionBy("symbol").orderBy(F.desc("_back"))
    moves = recent.withColumns(
        {"_chg": F.col("close") - F.lag("close").over(w), "_wt": F.lit(k) - F.col("_back")}
    )
    g = moves.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("_chg") * F.col("_wt")).alias("_wc"),
        F.sum("_wt").alias("_ws"),
        F.avg("_chg").alias("_m1"),
        F.var_pop("_chg").alias("_var"),
        F.max(F.when(F.col("_back") == 1, F.col("close"))).alias("last_price"),
        F.avg("volume").alias("_vol"),
    )
    g = g.where(F.col("_n") >= k)
    # Mean squared distance from the weighted sum over (k - 1), by the shift rule.
    centre = F.col("_wc") / F.lit(float(k - 1))
    variance = F.col("_var") + F.pow(F.col("_m1") - centre, F.lit(2.0))
    stability = F.greatest(F.lit(0.1), F.lit(1.0) - ratio(variance, F.col("last_price") * 0.1))
    volume = F.least(F.lit(1.0), F.col("_vol") / 10000000.0)
    predicted = F.col("last_price") + ratio("_wc", "_ws")
    return g.select(
        "symbol",
        "last_price",
        F.greatest(predicted, F.lit(0.01)).alias("predicted_price"),
        clip((stability * 0.7 + volume * 0.3) * 100.0, 20.0, 90.0).alias("confidence"),
    )


def per_symbol_train_and_forecast(features: DataFrame, horizon: str = "1D", lookback: int = 60) -> DataFrame:
    """Per symbol: fit ridge and neighbour models on 80 % of its rows, weigh by the tail's rmse.

    Rows before ``lookback`` only serve as history. A group is one symbol's daily rows, which
    the calendar bounds; the fits are small numpy solves in the grouped map.
    """
    from tickwright.operators.features import FEATURES_C

    cols = [*FEATURES_C, "open", "high", "low", "close"]
    schema = "symbol {0}, model string, price double, rmse double, data_points_used bigint".format(
        features.schema["symbol"].dataType.simpleString()
    )

    def fit(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("date")
        x, y = pdf[cols].to_numpy(float)[:-1], pdf["close"].to_numpy(float)[1:]
        x, y = x[lookback - 1 :], y[lookback - 1 :]
        n = len(y)
        if n < 10:
            return pd.DataFrame({"symbol": [], "model": [], "price": [], "rmse": [], "data_points_used": []})
        cut = int(n * 0.8)
        mean, std = x[:cut].mean(0), x[:cut].std(0)
        std[std == 0] = 1.0
        z, last = (x - mean) / std, (pdf[cols].to_numpy(float)[-1:] - mean) / std
        a = np.c_[np.ones(cut), z[:cut]]
        ridge = np.eye(a.shape[1])
        ridge[0, 0] = 0.0
        beta = np.linalg.solve(a.T @ a + ridge, a.T @ y[:cut])
        linear = lambda q: np.c_[np.ones(len(q)), q] @ beta

        def near(q, k=min(5, cut)):
            d = np.sqrt(((q[:, None, :] - z[None, :cut, :]) ** 2).sum(2))
            idx = np.argsort(d, axis=1, kind="stable")[:, :k]
            w = 1.0 / np.maximum(np.take_along_axis(d, idx, 1), 1e-12)
            return (w * y[idx]).sum(1) / w.sum(1)

        rows = []
        for name, model in (("linear_ridge", linear), ("knn", near)):
            e = y[cut:] - model(z[cut:])
            rows.append((pdf["symbol"].iloc[0], name, float(model(last)[0]), float(np.sqrt((e**2).mean())), n))
        return pd.DataFrame(rows, columns=["symbol", "model", "price", "rmse", "data_points_used"])

    # Two rows per symbol, read three times below: stored once.
    scored = materialize(features.select("symbol", "date", *cols).groupBy("symbol").applyInPandas(fit, schema), "scored")
    weighted = ens.inverse_rmse_weights(scored, ["symbol"])
    points = scored.groupBy("symbol").agg(F.max("data_points_used").alias("data_points_used"))
    return (
        ens.price_range(weighted, ["symbol"])
        .join(ens.variance_confidence(weighted, ["symbol"]), "symbol")
        .join(points, "symbol")
        .withColumns({"horizon": F.lit(horizon), "time_frame_days": F.lit(HORIZON_DAYS[horizon.upper()])})
    )
