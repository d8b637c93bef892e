"""Window rules on hand-made series and against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickwright.functions.windows import ema
from tickwright.operators import features as ft
from tickwright.operators import indicators as ind


def series(df, *cols, symbol="A"):
    pdf = df.where(F.col("symbol") == symbol).orderBy("date").toPandas()
    return [pdf[c].astype(float).to_numpy() for c in cols]


def walk(n, seed=1):
    rng = np.random.default_rng(seed)
    return list(100.0 * np.exp(np.cumsum(rng.normal(0, 0.02, n))))


@pytest.mark.parametrize("n", [5, 20])
@pytest.mark.parametrize("extra", [-1, 0, 1])
def test_minimum_periods(bars, n, extra):
    rows = n + extra
    (got,) = series(ind.sma(bars({"A": walk(rows)}), [n]), f"sma_{n}")
    assert np.isfinite(got).sum() == max(0, rows - n + 1)


def test_one_row(bars):
    out = ind.all_indicators(bars({"A": [10.0]})).first().asDict()
    assert out["sma_5"] is None and out["price_change"] is None and out["atr"] is None
    assert out["rsi"] == 50.0 and out["macd"] == 0.0 and out["bb_upper"] == 10.0
    assert out["bb_width"] == 0.0 and out["bb_position"] == 0.5 and out["hl_ratio"] == 1.0
    assert out["price_position"] == 0.5 and out["body_size"] == 0.0 and out["close_lag_1_ratio"] == 1.0


def test_flat_series(bars):
    df = bars({"A": [7.0] * 30})
    out = ind.all_indicators(df).orderBy(F.desc("date")).first().asDict()
    assert out["rsi"] == 50.0 and out["bb_position"] == 0.5 and out["close_position_5"] is None
    assert ft.rsi_plain(df).where(F.col("rsi").isNotNull()).count() == 0


def test_rising_series_keeps_both_rsi_forms(bars):
    df = bars({"A": [float(i) for i in range(1, 31)]})
    guarded, = series(ind.rsi_guarded(df), "rsi")
    plain, = series(ft.rsi_plain(df), "rsi")
    assert guarded[-1] == 50.0
    assert plain[-1] == 100.0 and np.isnan(plain[12]) and plain[13] == 100.0


def test_zero_price_gives_null_not_error(bars):
    change, = series(ind.price_change(bars({"A": [1.0, 0.0, 2.0]})), "price_change")
    assert change[1] == -1.0 and np.isnan(change[2])


def test_indicators_match_pandas(bars):
    closes = walk(700)
    rng = np.random.default_rng(2)
    high = [c * (1 + abs(x)) for c, x in zip(closes, rng.normal(0, 0.01, 700))]
    low = [c * (1 - abs(x)) for c, x in zip(closes, rng.normal(0, 0.01, 700))]
    df = ind.all_indicators(bars({"A": closes}, high=high, low=low))
    c, h, l = pd.Series(closes), pd.Series(high), pd.Series(low)
    prev = c.shift()
    tr = np.maximum(h - l, np.maximum((h - prev).abs(), (l - prev).abs()))
    delta = c.diff()
    gain = delta.where(delta > 0, 0.0).rolling(14).mean()
    loss = (-delta.where(delta < 0, 0.0)).rolling(14).mean()
    macd = c.ewm(span=12).mean() - c.ewm(span=26).mean()
    expected = {
        "sma_200": c.rolling(200).mean(),
        "ema_12": c.ewm(span=12).mean(),
        "ema_26": c.ewm(span=26).mean(),
        "macd": macd,
        "macd_signal": macd.ewm(span=9).mean(),
        "rsi": (100 - 100 / (1 + gain / loss)).fillna(50.0),
        "atr": tr.where(prev.notna()).rolling(14).mean(),
        "volatility_20d": c.pct_change().rolling(20).std(),
        "bb_upper": c.rolling(20).mean() + 2 * c.rolling(20).std(),
    }
    for name, want in expected.items():
        got, = series(df, name)
        np.testing.assert_allclose(got, want.to_numpy(), rtol=1e-9, atol=1e-9, err_msg=name)


def test_ema_over_several_blocks(bars):
    closes = walk(1500, 5)
    got, = series(ema(bars({"A": closes}), "close", {50: "e"}), "e")
    np.testing.assert_allclose(got, pd.Series(closes).ewm(span=50).mean(), rtol=1e-10)


def test_null_close_inside_a_frame(bars, spark):
    closes = walk(40)
    df = bars({"A": closes})
    holed = df.withColumn("close", F.when(F.dayofyear("date") != 10, F.col("close")))
    s = pd.Series(closes)
    s.iloc[9] = np.nan
    got, = series(ind.sma(holed, [5]), "sma_5")
    np.testing.assert_allclose(got, s.rolling(5).mean().to_numpy(), rtol=1e-12)
    # The shared-primitive form must agree with the plain one.
    plain = ft.moving_averages(holed, [5]).select("symbol", "date", "ma_5")
    shared = ft.library_b(holed).select("symbol", "date", "ma_5")
    assert plain.exceptAll(shared).count() == 0


def test_row_order_and_partitioning_do_not_matter(bars):
    df = bars({"A": walk(80), "B": walk(60, 3)})
    a = ind.all_indicators(df)
    b = ind.all_indicators(df.orderBy(F.rand(3)).repartition(7))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_scaling_prices_keeps_ratios(bars):
    closes = walk(120)
    a = ind.all_indicators(bars({"A": closes}))
    b = ind.all_indicators(bars({"A": [c * 3.0 for c in closes]}))
    for name in ("sma_20_ratio", "rsi", "bb_position", "volatility_10d", "return_5d"):
        x, = series(a, name)
        y, = series(b, name)
        np.testing.assert_allclose(x, y, rtol=1e-9, atol=1e-9)


def test_features_b_short_symbol_takes_defaults(bars):
    closes = walk(120)
    rng = np.random.default_rng(4)
    high = [c + 1 + x for c, x in zip(closes, rng.random(120))]
    low = [c - 1 - x for c, x in zip(closes, rng.random(120))]
    out = ft.features_b(bars({"A": closes}, high=high, low=low)).toPandas()
    assert len(out) == 120 - 49  # the 50-row average is the longest one that exists
    assert (out["ma_200"] == 0.0).all() and (out["ma_200_ratio"] == 1.0).all()


def test_target_is_clipped_and_last_row_dropped(bars):
    out = ft.target_pct(bars({"A": [10.0, 100.0, 1.0]})).orderBy("date").toPandas()
    assert list(out["label"]) == [50.0, -50.0]


@pytest.mark.parametrize("span", [9, 12, 26])
def test_ema_keeps_its_mean_over_any_gap(bars, span):
    rng = np.random.default_rng(span)
    closes = [*rng.uniform(50, 150, 100), *[None] * 590, *rng.uniform(50, 150, 40), *[None] * 5000, 7.0, None, 9.0]
    df = bars({"A": [1.0] * len(closes)})
    values = df.sparkSession.createDataFrame([(i, None if c is None else float(c)) for i, c in enumerate(closes)], "i int, value double")
    day = F.datediff("date", F.lit("2020-01-01")).cast("int")
    got, = series(ema(df.withColumn("i", day).join(values, "i"), "value", {span: "e"}), "e")
    want = pd.Series([np.nan if c is None else c for c in closes]).ewm(span=span).mean()
    assert np.allclose(got, want, rtol=1e-9)
