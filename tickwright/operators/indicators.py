"""Indicator library A: guarded technical indicators (67 columns) over all symbols.

Every function adds columns to a bar frame keyed by (symbol, date). All of them partition by
symbol and order by date, so chained calls share one exchange and one sort; a column group
is NULL for symbols that have fewer rows than the group needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwright.functions.numeric import null_if_not_finite, ratio
from tickwright.functions.windows import (
    by_symbol,
    change_of,
    drop_position,
    drop_primitives,
    ema_over_blocks,
    gain_loss,
    lag_of,
    roll_of,
    rows_of,
    Staged,
    with_position,
    with_primitives,
)
from tickwright.schema import LAGS, MOVING_AVERAGES, ROLLING, RSI_PERIOD

EMA_SPANS = [12, 26]
SIGNAL_SPAN = 9


def _enough(df: DataFrame, n: int):
    return rows_of(df) >= n


def sma(df: DataFrame, ns=MOVING_AVERAGES) -> DataFrame:
    """Simple moving averages of the close."""
    return df.withColumns({f"sma_{n}": roll_of(df, "avg", "close", n) for n in ns})


def sma_ratio(df: DataFrame, ns=MOVING_AVERAGES) -> DataFrame:
    """close / sma, 1.0 where the average is undefined or zero; needs the sma columns."""
    return df.withColumns(
        {f"sma_{n}_ratio": F.when(_enough(df, n), ratio("close", f"sma_{n}", 1.0)) for n in ns}
    )


def ema(df: DataFrame, spans=EMA_SPANS) -> DataFrame:
    """Normalised exponential means of the close."""
    return _ema_family(df, spans, macd=False)


def ema_ratio(df: DataFrame, spans=EMA_SPANS) -> DataFrame:
    return df.withColumns(
        {f"ema_{s}_ratio": F.when(_enough(df, s), ratio("close", f"ema_{s}", 1.0)) for s in spans}
    )


def macd(df: DataFrame) -> DataFrame:
    """MACD line, signal and histogram; zero for symbols shorter than the slow span."""
    return _ema_family(df, [], macd=True)


def _ema_family(df: DataFrame, spans, macd: bool) -> DataFrame:
    """EMA columns and the MACD group from one block layout (shared exchange and sorts)."""
    needed = sorted(set(spans) | (set(EMA_SPANS) if macd else set()))
    rows = rows_of(df)
    placed_before = "_t" in df.columns
    placed = df if placed_before else with_position(df.withColumn("_rows", rows))
    placed = ema_over_blocks(placed, [("close", s, f"_ema{s}") for s in needed])
    enough = lambda n: F.col("_rows") >= n
    if macd:
        fast, slow = EMA_SPANS
        placed = placed.withColumn("macd", F.col(f"_ema{fast}") - F.col(f"_ema{slow}"))
        placed = ema_over_blocks(placed, [("macd", SIGNAL_SPAN, "macd_signal")])
    final = {f"ema_{s}": F.when(enough(s), F.col(f"_ema{s}")) for s in spans}
    if macd:
        values = {
            "macd": F.col("macd"),
            "macd_signal": F.col("macd_signal"),
            "macd_histogram": F.col("macd") - F.col("macd_signal"),
        }
        final |= {c: F.when(enough(slow), v).otherwise(F.lit(0.0)) for c, v in values.items()}
    placed = placed.withColumns(final)
    placed = placed.drop(*[f"_ema{s}" for s in needed])
    return placed if placed_before else drop_position(placed).drop("_rows")


def rsi_guarded(df: DataFrame, period: int = RSI_PERIOD, out: str = "rsi") -> DataFrame:
    """RSI that is 50 in the warm-up, for short symbols and in windows without losses."""
    base = df
    if "_gain" not in df.columns:
        gain, loss = gain_loss("close", lag_of(df, "close"))
        df = df.withColumns({"_gain": gain, "_loss": loss})
    rs = ratio(roll_of(df, "avg", "_gain", period), roll_of(df, "avg", "_loss", period), 1.0)
    value = F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + rs)
    df = df.withColumn(out, F.when(_enough(df, period + 1), value).otherwise(F.lit(50.0)))
    return df if "_gain" in base.columns else df.drop("_gain", "_loss")


def bollinger(df: DataFrame, period: int = 20, width: float = 2.0) -> DataFrame:
    """Bands around the moving average; short symbols get the close for all three."""
    mid, dev = roll_of(df, "avg", "close", period), roll_of(df, "std", "close", period)
    long_enough = _enough(df, period)
    close = F.col("close")
    return df.withColumns(
        {
            "bb_middle": F.when(long_enough, mid).otherwise(close),
            "bb_upper": F.when(long_enough, mid + dev * width).otherwise(close),
            "bb_lower": F.when(long_enough, mid - dev * width).otherwise(close),
        }
    )


def bb_shape(df: DataFrame) -> DataFrame:
    """Band width and position inside the bands; needs the band columns."""
    spread = F.col("bb_upper") - F.col("bb_lower")
    return df.withColumns(
        {
            "bb_width": ratio(spread, "bb_middle", 0.0),
            "bb_position": ratio(F.col("close") - F.col("bb_lower"), spread, 0.5),
        }
    )


def price_change(df: DataFrame) -> DataFrame:
    change = change_of(df, "close")
    return df.withColumns({"price_change": change, "price_change_abs": F.abs(change)})


def returns(df: DataFrame, days=(1, 5, 10)) -> DataFrame:
    return df.withColumns({f"return_{d}d": change_of(df, "close", d) for d in days})


def momentum(df: DataFrame, days=(5, 10, 20)) -> DataFrame:
    return df.withColumns({f"momentum_{d}d": change_of(df, "close", d) for d in days})


def volatility(df: DataFrame, ns=ROLLING) -> DataFrame:
    """Rolling sample deviation of ``price_change``."""
    return df.withColumns({f"volatility_{n}d": roll_of(df, "std", "price_change", n) for n in ns})


def atr(df: DataFrame, period: int = 14) -> DataFrame:
    """Mean true range; the first row has no previous close, hence no range (S6)."""
    base = df
    if "_tr" not in df.columns:
        df = df.withColumn("_tr", true_range(lag_of(df, "close")))
    df = df.withColumn("atr", roll_of(df, "avg", "_tr", period))
    return df if "_tr" in base.columns else df.drop("_tr")


def true_range(prev):
    spread = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )
    return F.when(prev.isNotNull(), spread)


def day_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"hl_ratio": ratio("high", "low", 1.0), "oc_ratio": ratio("open", "close", 1.0)}
    )


def day_shape(df: DataFrame) -> DataFrame:
    """Position of the close in the day's range and relative body size."""
    spread = F.col("high") - F.col("low")
    return df.withColumns(
        {
            "price_position": ratio(F.col("close") - F.col("low"), spread, 0.5),
            "body_size": ratio(F.abs(F.col("close") - F.col("open")), spread, 0.0),
        }
    )


def close_lags(df: DataFrame, ks=LAGS) -> DataFrame:
    cols = {}
    for k in ks:
        lagged = lag_of(df, "close", k)
        cols[f"close_lag_{k}"] = lagged
        cols[f"close_lag_{k}_ratio"] = ratio("close", lagged, 1.0)
    return df.withColumns(cols)


def range_lags(df: DataFrame, ks=(1, 2, 5)) -> DataFrame:
    return df.withColumns({f"{c}_lag_{k}": lag_of(df, c, k) for k in ks for c in ("high", "low")})


def rolling_stats(df: DataFrame, ns=ROLLING) -> DataFrame:
    return df.withColumns(
        {f"close_{stat}_{n}": roll_of(df, stat, "close", n) for n in ns for stat in ("min", "max", "std")}
    )


def close_position(df: DataFrame, ns=ROLLING) -> DataFrame:
    """(close - min) / (max - min); NULL in flat windows. Needs the rolling min and max."""
    return df.withColumns(
        {
            f"close_position_{n}": ratio(
                F.col("close") - F.col(f"close_min_{n}"), F.col(f"close_max_{n}") - F.col(f"close_min_{n}")
            )
            for n in ns
        }
    )


def all_indicators(df: DataFrame) -> DataFrame:
    """The ten groups; fails when a price column is missing, infinities become NULL."""
    missing = [c for c in ("open", "high", "low", "close") if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    keep = df.columns
    out = with_primitives(
        df,
        lags=[("close", k) for k in (1, 2, 3, 5, 10, 20)] + [(c, k) for c in ("high", "low") for k in (1, 2, 5)],
        rolls=[("avg", "close", n) for n in MOVING_AVERAGES] + [(s, "close", n) for n in ROLLING for s in ("std", "min", "max")],
    )
    prev = F.col("_lag_close_1")
    gain, loss = gain_loss("close", prev)
    out = Staged.apply(
        out, price_change, lambda s: s.withColumns({"_gain": gain, "_loss": loss, "_tr": true_range(prev)})
    )
    out = with_primitives(
        out,
        rolls=[("avg", "_gain", RSI_PERIOD), ("avg", "_loss", RSI_PERIOD), ("avg", "_tr", 14)]
        + [("std", "price_change", n) for n in ROLLING],
    )
    out = _ema_family(out, EMA_SPANS, macd=True)
    out = Staged.apply(
        out, sma, rsi_guarded, bollinger, returns, momentum, volatility, atr, day_ratios, day_shape,
        close_lags, range_lags, rolling_stats, ema_ratio,
    )
    out = drop_primitives(Staged.apply(out, sma_ratio, bb_shape, close_position))
    added = [c for c in out.columns if c not in keep]
    return out.select(*keep, *[null_if_not_finite(c).alias(c) for c in added])


NOT_FEATURES = {
    "symbol", "category", "tier", "date", "open", "high", "low", "close", "volume",
    "adjusted_close", "currency", "data_source",
}


def feature_columns(df: DataFrame) -> list[str]:
    """Names of the numeric indicator columns (schema only, no job)."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in NOT_FEATURES
    ]


def supervised_raw(df: DataFrame, target: str = "close", k: int = 1) -> DataFrame:
    """Rows with the target ``k`` rows ahead as ``y``; rows with any NULL feature are dropped."""
    features = feature_columns(df)
    out = df.withColumn("y", F.lead(target, k).over(by_symbol()))
    return out.na.drop(how="any", subset=[*features, "y"])
