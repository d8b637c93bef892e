"""Indicator libraries B and C, the model feature contract, targets, splits and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.functions.numeric import clip, nan_to_num, ratio
from tickwright.functions.position import with_global_rank
from tickwright.functions.windows import (
    by_symbol,
    change_of,
    drop_primitives,
    ema_over_blocks,
    gain_loss,
    lag_of,
    roll_of,
    rows_of,
    Staged,
    symbol_rows,
    with_primitives,
)
from tickwright.schema import (
    FEATURES_38,
    LAGS,
    LOOKBACK,
    MIN_SERVING_ROWS,
    MIN_TRAINING_ROWS,
    MOVING_AVERAGES,
    ROLLING,
    RSI_PERIOD,
)


# ---- library B ------------------------------------------------------------------------------


def moving_averages(df: DataFrame, ns=MOVING_AVERAGES) -> DataFrame:
    df = df.withColumns({f"ma_{n}": roll_of(df, "avg", "close", n) for n in ns})
    return df.withColumns({f"ma_{n}_ratio": ratio("close", f"ma_{n}") for n in ns})


def price_change_b(df: DataFrame) -> DataFrame:
    change = change_of(df, "close")
    return df.withColumns({"price_change": change, "price_change_abs": F.abs(change)})


def volatility_20(df: DataFrame, n: int = 20) -> DataFrame:
    """Rolling sample deviation of ``price_change``."""
    return df.withColumn("volatility", roll_of(df, "std", "price_change", n))


def rsi_plain(df: DataFrame, period: int = RSI_PERIOD, out: str = "rsi") -> DataFrame:
    """RSI without guards: 100 in a window of gains only, NULL in a window without moves."""
    base = df
    if "_gain" not in df.columns:
        gain, loss = gain_loss("close", lag_of(df, "close"))
        df = df.withColumns({"_gain": gain, "_loss": loss})
    df = df.withColumns({"_g": roll_of(df, "avg", "_gain", period), "_l": roll_of(df, "avg", "_loss", period)})
    rs = ratio("_g", "_l")
    value = F.when(F.col("_l") == 0, F.when(F.col("_g") > 0, F.lit(100.0))).otherwise(
        F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + rs)
    )
    df = df.withColumn(out, value).drop("_g", "_l")
    return df if "_gain" in base.columns else df.drop("_gain", "_loss")


def day_ratios_plain(df: DataFrame) -> DataFrame:
    """Ratios of the day's prices, NULL where undefined (flat bars)."""
    return df.withColumns(
        {
            "hl_ratio": ratio("high", "low"),
            "oc_ratio": ratio("open", "close"),
            "price_position": ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")),
        }
    )


def lags_and_rolling(df: DataFrame) -> DataFrame:
    cols = {f"close_lag_{k}": lag_of(df, "close", k) for k in LAGS}
    cols |= {f"close_{stat}_{n}": roll_of(df, stat, "close", n) for n in ROLLING for stat in ("std", "min", "max")}
    return df.withColumns(cols)


def calendar_features(df: DataFrame) -> DataFrame:
    """Weekday (Monday 0), month and quarter."""
    return df.withColumns(
        {"day_of_week": F.weekday("date"), "month": F.month("date"), "quarter": F.quarter("date")}
    )


def market_type(df: DataFrame) -> DataFrame:
    return df.withColumn("market_type", F.when(F.col("category") == "ind_stocks", 1.0).otherwise(0.0))


def drop_incomplete(df: DataFrame, subset=None) -> DataFrame:
    """Drops rows with a NULL in the given columns (all columns by default)."""
    return df.na.drop(how="any", subset=subset)


def feature_default(name: str) -> float:
    return 1.0 if "ratio" in name or "position" in name else 0.0


def fixed_feature_set(df: DataFrame) -> DataFrame:
    """Keys, close and the 38 features in contract order; missing ones get their default."""
    keys = [c for c in ("symbol", "category", "date", "close") if c in df.columns]
    cols = []
    for name in FEATURES_38:
        value = F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")
        cols.append((value if name in ("open", "high", "low") else F.coalesce(value, F.lit(feature_default(name)))).alias(name))
    return df.select(*keys, *cols)


def library_b(bars: DataFrame) -> DataFrame:
    """All library-B columns, NULL where undefined; one exchange by symbol."""
    return drop_primitives(_library_b(bars))


def _library_b(bars: DataFrame) -> DataFrame:
    df = with_primitives(
        bars,
        lags=[("close", k) for k in LAGS],
        rolls=[("avg", "close", n) for n in MOVING_AVERAGES] + [(s, "close", n) for n in ROLLING for s in ("std", "min", "max")],
    )
    gain, loss = gain_loss("close", F.col("_lag_close_1"))
    df = price_change_b(df.withColumns({"_gain": gain, "_loss": loss}))
    df = with_primitives(
        df, rolls=[("avg", "_gain", RSI_PERIOD), ("avg", "_loss", RSI_PERIOD), ("std", "price_change", 20)]
    )
    groups = [volatility_20, day_ratios_plain, lags_and_rolling, calendar_features]
    groups += [market_type] if "category" in bars.columns else []
    return rsi_plain(moving_averages(Staged.apply(df, *groups)))


def features_b(bars: DataFrame) -> DataFrame:
    """Complete feature rows in the fixed contract.

    Rows with a missing feature or price are dropped, except that a moving average longer
    than the symbol's whole history takes its default instead of emptying the symbol.
    """
    df = _library_b(bars)
    complete = F.col("close").isNotNull()
    for name in FEATURES_38:
        if name not in df.columns:
            continue
        present = F.col(name).isNotNull()
        if name.startswith("ma_"):
            present = present | (F.col("_rows") < int(name.split("_")[1]))
        elif name.startswith(("close_std", "close_min", "close_max")):
            present = present | (F.col("_rows") < int(name.rsplit("_", 1)[1]))
        complete = complete & present
    return fixed_feature_set(df.where(complete))


# ---- library C ------------------------------------------------------------------------------

FEATURES_C = [
    "price_change", "high_low_ratio", "close_open_ratio", "sma_20", "sma_50", "sma_200", "ema_12", "ema_26",
    "macd", "macd_signal", "macd_histogram", "rsi_14", "bb_upper", "bb_middle", "bb_lower", "bb_width",
    "bb_position", "close_lag_1", "close_lag_2", "close_lag_3", "close_lag_5", "close_lag_10", "close_lag_30",
    "price_volatility",
]


def library_c(bars: DataFrame) -> DataFrame:
    return drop_primitives(_library_c(bars))


def _library_c(bars: DataFrame) -> DataFrame:
    lags = (1, 2, 3, 5, 10, 30)
    df = with_primitives(
        bars,
        lags=[("close", k) for k in lags],
        rolls=[("avg", "close", n) for n in (20, 50, 200)] + [("std", "close", 20)],
    )
    gain, loss = gain_loss("close", F.col("_lag_close_1"))
    df = df.withColumns(
        {
            "_gain": gain,
            "_loss": loss,
            "price_change": change_of(df, "close"),
            "high_low_ratio": ratio("high", "low"),
            "close_open_ratio": ratio("close", "open"),
            **{f"sma_{n}": roll_of(df, "avg", "close", n) for n in (20, 50, 200)},
            **{f"close_lag_{k}": lag_of(df, "close", k) for k in lags},
            "price_volatility": roll_of(df, "std", "close", 20),
        }
    )
    df = df.withColumns(
        {
            "bb_middle": F.col("sma_20"),
            "bb_upper": F.col("sma_20") + F.col("price_volatility") * 2.0,
            "bb_lower": F.col("sma_20") - F.col("price_volatility") * 2.0,
        }
    )
    spread = F.col("bb_upper") - F.col("bb_lower")
    df = df.withColumns(
        {
            "bb_width": ratio(spread, "bb_middle"),
            "bb_position": ratio(F.col("close") - F.col("bb_lower"), spread),
        }
    )
    df = with_primitives(df, rolls=[("avg", "_gain", RSI_PERIOD), ("avg", "_loss", RSI_PERIOD)])
    df = rsi_plain(df, out="rsi_14")
    df = ema_over_blocks(df, [("close", 12, "ema_12"), ("close", 26, "ema_26")])
    df = ema_over_blocks(df.withColumn("macd", F.col("ema_12") - F.col("ema_26")), [("macd", 9, "macd_signal")])
    return df.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def features_c(bars: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Complete library-C rows; symbols shorter than ``lookback`` keep their bars only."""
    df = _library_c(bars)
    complete = F.lit(True)
    for c in FEATURES_C:
        complete = complete & F.col(c).isNotNull()
    short = F.col("_rows") < lookback
    out = df.where(complete | short).withColumns({c: F.when(~short, F.col(c)) for c in FEATURES_C})
    return drop_primitives(out)


# ---- targets and matrices -----------------------------------------------------------------------


def target_pct(df: DataFrame, k: int = 1, limit: float = 50.0) -> DataFrame:
    """Percent change to the close ``k`` rows ahead, clipped; rows without one are dropped."""
    ahead = F.lead("close", k).over(by_symbol())
    pct = ratio(ahead - F.col("close"), "close") * F.lit(100.0)
    out = df.withColumns({"_ahead": ahead, "label": F.coalesce(clip(pct, -limit, limit), F.lit(0.0))})
    return out.where(F.col("_ahead").isNotNull()).drop("_ahead")


def training_matrix(features: DataFrame, for_prediction: bool = False) -> DataFrame:
    """Contract features and label for symbols with enough feature rows."""
    need = MIN_SERVING_ROWS if for_prediction else MIN_TRAINING_ROWS
    enough = features.withColumn("_rows", symbol_rows()).where(F.col("_rows") >= need).drop("_rows")
    labelled = target_pct(enough)
    return labelled.withColumns({c: nan_to_num(c) for c in FEATURES_38})


def stack_all_symbols(bars: DataFrame, for_prediction: bool = False) -> DataFrame:
    """The stacked matrix of all symbols that pass the quality rules."""
    from tickwright.operators.quality import validate_quality

    return training_matrix(features_b(validate_quality(bars)), for_prediction)


def assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    """Vector column for the ML estimators."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


def sequence_windows(df: DataFrame, cols, lookback: int = LOOKBACK, target: str = "close") -> DataFrame:
    """Per row the matrix of the ``lookback`` earlier rows and the row's target."""
    w = by_symbol()
    frame = w.rowsBetween(-lookback, -1)
    row = F.array(*[F.col(c).cast("double") for c in cols])
    out = df.withColumns(
        {"sequence": F.collect_list(row).over(frame), "_n": F.count(F.lit(1)).over(frame), "target": F.col(target)}
    )
    return out.where(F.col("_n") == lookback).drop("_n")


# ---- splits ---------------------------------------------------------------------------------------


def chronological_split(df: DataFrame, test: float = 0.2) -> DataFrame:
    """Adds ``split``: the first rows of every symbol train, the rest test."""
    n = symbol_rows()
    cut = F.floor(n * F.lit(1.0 - test))
    return df.withColumn(
        "split", F.when(F.row_number().over(by_symbol()) <= cut, "train").otherwise("test")
    )


def ordered_split(df: DataFrame, key: str, train: float = 0.70, valid: float = 0.15) -> DataFrame:
    """Adds ``split`` by row order over the whole table (ranked in parallel, not in one task)."""
    ranked, n = with_global_rank(df, F.col(key), [key])
    a, b = F.floor(n * F.lit(train)), F.floor(n * F.lit(train + valid))
    part = F.when(F.col("_rank") <= a, "train").when(F.col("_rank") <= b, "valid").otherwise("test")
    return ranked.withColumn("split", part).drop("_rank")


def shuffle_order(key: str, seed: int) -> Column:
    """Repeatable pseudo-random order of rows."""
    return F.xxhash64(F.lit(seed), F.col(key))


def shuffled_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``: an exact share of the rows in hash order."""
    ranked, n = with_global_rank(df, shuffle_order(key, seed), [key], hashed=True)
    cut = n - F.floor(n * F.lit(test))
    return ranked.withColumn("split", F.when(F.col("_rank") <= cut, "train").otherwise("test")).drop("_rank")


def kfold(df: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold``: equal slices of the hash order, the last fold takes the remainder."""
    ranked, n = with_global_rank(df, shuffle_order(key, seed), [key], hashed=True)
    size = F.greatest(F.floor(n / F.lit(folds)), F.lit(1))
    fold = F.least(F.floor((F.col("_rank") - 1) / size), F.lit(folds - 1)).cast("int")
    return ranked.withColumn("fold", fold).drop("_rank")


def subsample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement (or all): the first in hash order."""
    ranked, _ = with_global_rank(df, shuffle_order(key, seed), [key], hashed=True)
    return ranked.where(F.col("_rank") <= n).drop("_rank")


# ---- scaling and summaries ------------------------------------------------------------------------


def _stats(df: DataFrame, cols, *aggs) -> list[tuple]:
    """Per column the given aggregates, fetched as one row of numbers."""
    row = df.agg(*[agg(c) for c in cols for agg in aggs]).first()
    n = len(aggs)
    return [tuple(row[i * n : i * n + n]) for i in range(len(cols))]


def standard_scaler(df: DataFrame, cols) -> DataFrame:
    """z-scores with the population deviation; constant columns become 0."""
    stats = _stats(df, cols, F.avg, F.stddev_pop)
    return df.withColumns({f"{c}_z": ratio(F.col(c) - F.lit(m), F.lit(s), 0.0) for c, (m, s) in zip(cols, stats)})


def minmax_scaler(df: DataFrame, cols) -> DataFrame:
    stats = _stats(df, cols, F.min, F.max)
    return df.withColumns(
        {f"{c}_mm": ratio(F.col(c) - F.lit(lo), F.lit(hi) - F.lit(lo), 0.0) for c, (lo, hi) in zip(cols, stats)}
    )


def outlier_filter(df: DataFrame, cols, sigmas: float = 10.0) -> DataFrame:
    """Rows whose every column is within ``sigmas`` population deviations of the mean."""
    keep = F.lit(True)
    for c, (m, s) in zip(cols, _stats(df, cols, F.avg, F.stddev_pop)):
        keep = keep & (F.abs(F.col(c) - F.lit(m)) <= F.lit(s) * F.lit(sigmas))
    return df.where(keep)


def describe(df: DataFrame, cols) -> DataFrame:
    """Mean, population deviation, minimum and maximum per column, one row each."""
    aggs = [
        F.struct(
            F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"),
            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
        )
        for c in cols
    ]
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def latest_features(features: DataFrame) -> DataFrame:
    """The last feature row of every symbol (the serving row)."""
    rest = [c for c in features.columns if c not in ("symbol", "date")]
    return features.groupBy("symbol").agg(F.max(F.struct("date", *rest)).alias("_r")).select("symbol", "_r.*")


