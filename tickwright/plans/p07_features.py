"""Queries for feature libraries B and C, targets, splits and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwright.functions.numeric import r6
from tickwright.operators import features as ft
from tickwright.schema import FEATURES_38
from tickwright.sources import tables as t

from .p06_indicators import CH, CNT, NUM, RSIW, VOL, ema_sql, out, simple, staged
from .registry import BARS_N, BARS_S, div, lag, query, roll
from .registry import r6 as q6

NS = [5, 10, 20, 50, 200]
nation = dict(bars=BARS_N, source=t.bars_nation)


def nation_bars(spark, d):
    """Nation bars with their category."""
    b = t.bars_nation(spark, d)
    return b.withColumn("category", t.category_of(F.col("symbol")))


MA_COLS = [c for n in NS for c in (f"ma_{n}", f"ma_{n}_ratio")]
MA_EXPRS = [e for n in NS for e in (roll("avg", "close", n), div("close", roll("avg", "close", n)))]
simple("ma_ratio", ft.moving_averages, MA_COLS, MA_EXPRS)
staged("volatility_20", lambda b: ft.volatility_20(ft.price_change_b(b)), ["volatility"], VOL, [roll("stddev_samp", "chg", 20)], "ch")
RSI_PLAIN = "CASE WHEN al = 0 THEN CASE WHEN ag > 0 THEN 100.0 END ELSE 100.0 - 100.0 / (1.0 + ag / nullif(al, 0)) END"
staged("rsi_plain", ft.rsi_plain, ["rsi"], RSIW, [RSI_PLAIN], "rw")
PLAIN = [div("high", "low"), div("open", "close"), div("close - low", "high - low")]
simple("day_ratios_plain", ft.day_ratios_plain, ["hl_ratio", "oc_ratio", "price_position"], PLAIN)
LR_COLS = [f"close_lag_{k}" for k in (1, 2, 3, 5, 10)] + [f"close_{s}_{n}" for n in (5, 10, 20) for s in ("std", "min", "max")]
LR_EXPRS = [lag("close", k) for k in (1, 2, 3, 5, 10)] + [roll(f, "close", n) for n in (5, 10, 20) for f in ("stddev_samp", "min", "max")]
simple("lags_rolling_b", ft.lags_and_rolling, LR_COLS, LR_EXPRS)
query(
    "calendar_features",
    f"WITH {BARS_S} SELECT symbol, date, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter FROM bars",
)(lambda spark, d: ft.calendar_features(t.bars_supplier(spark, d)).select("symbol", "date", "day_of_week", "month", "quarter"))
query(
    "market_type",
    f"WITH {BARS_N} SELECT symbol, date, CASE WHEN symbol % 2 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS market_type FROM bars",
)(lambda spark, d: ft.market_type(nation_bars(spark, d)).select("symbol", "date", "market_type"))

B_EXPRS = {
    "open": "open", "high": "high", "low": "low", "price_change": "chg", "price_change_abs": "abs(chg)",
    "volatility": roll("stddev_samp", "chg", 20), "rsi": RSI_PLAIN,
    "hl_ratio": PLAIN[0], "oc_ratio": PLAIN[1], "price_position": PLAIN[2],
    "day_of_week": "isodow(date) - 1.0", "month": "month(date) * 1.0", "quarter": "quarter(date) * 1.0",
    "market_type": "CASE WHEN symbol % 2 = 1 THEN 1.0 ELSE 0.0 END",
    **dict(zip(MA_COLS, MA_EXPRS)), **dict(zip(LR_COLS, LR_EXPRS)),
}


def need(name):
    if name.startswith("ma_"):
        return f"({name} IS NOT NULL OR cnt < {name.split('_')[1]})"
    if name.startswith(("close_std", "close_min", "close_max")):
        return f"({name} IS NOT NULL OR cnt < {name.rsplit('_', 1)[1]})"
    return f"{name} IS NOT NULL"


RAW_B = f"""b0 AS (SELECT *, coalesce(close - {lag('close')}, 0.0) AS dl, {CH} AS chg, {CNT} AS cnt FROM bars),
b1 AS (SELECT *, greatest(dl, 0.0) AS g, greatest(-dl, 0.0) AS l FROM b0),
b2 AS (SELECT *, {roll('avg', 'g', 14)} AS ag, {roll('avg', 'l', 14)} AS al FROM b1),
b3 AS (SELECT symbol, date, close, cnt, volume, {", ".join(f"{B_EXPRS[c]} AS {c}" for c in FEATURES_38)} FROM b2)"""
FEAT = f"""{RAW_B}, feat AS (SELECT symbol, date, close, {", ".join(c if c in ('open', 'high', 'low') else f"coalesce({c}, {ft.feature_default(c)}) AS {c}" for c in FEATURES_38)}
 FROM b3 WHERE {" AND ".join(need(c) for c in FEATURES_38)})"""
F_SQL = ", ".join(q6(c, c) for c in FEATURES_38)


@query("drop_incomplete", f"WITH {BARS_N}, {RAW_B} SELECT symbol, date, {F_SQL} FROM b3 WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES_38)}")
def drop_incomplete(spark, d):
    return out(ft.drop_incomplete(ft.library_b(nation_bars(spark, d)), FEATURES_38), FEATURES_38)


@query(
    "fixed_feature_set",
    f"WITH {BARS_N} SELECT symbol, date, {', '.join(q6(c if c in ('open', 'high', 'low') else str(ft.feature_default(c)), c) for c in FEATURES_38)} FROM bars",
)
def fixed_feature_set(spark, d):
    """The contract over bare bars: everything but the prices takes its default."""
    return out(ft.fixed_feature_set(t.bars_nation(spark, d)), FEATURES_38)


@query("features_b", f"WITH {BARS_N}, {FEAT} SELECT symbol, date, {q6('close', 'close')}, {F_SQL} FROM feat")
def features_b(spark, d):
    return out(ft.features_b(nation_bars(spark, d)), ["close", *FEATURES_38])


C_COLS = ft.FEATURES_C
C_EXPRS = {
    "price_change": CH, "high_low_ratio": div("high", "low"), "close_open_ratio": div("close", "open"),
    "sma_20": roll("avg", "close", 20), "sma_50": roll("avg", "close", 50), "sma_200": roll("avg", "close", 200),
    **{f"close_lag_{k}": lag("close", k) for k in (1, 2, 3, 5, 10, 30)},
    "price_volatility": roll("stddev_samp", "close", 20),
}
C_SQL = f"""{NUM}, {ema_sql('num', 'close', 12, 'e12', 'num')}, {ema_sql('num', 'close', 26, 'e26', 'num')},
mc AS (SELECT num.symbol, num.date, num.t, e12.v AS v12, e26.v AS v26, e12.v - e26.v AS macd FROM num JOIN e12 USING (symbol, date) JOIN e26 USING (symbol, date)),
{ema_sql('mc', 'macd', 9, 'sg', 'mc')},
dl AS (SELECT *, coalesce(close - {lag('close')}, 0.0) AS dl, {CNT} AS cnt FROM bars),
gl AS (SELECT *, greatest(dl, 0.0) AS g, greatest(-dl, 0.0) AS l FROM dl),
rw AS (SELECT *, {roll('avg', 'g', 14)} AS ag, {roll('avg', 'l', 14)} AS al, {", ".join(f"{e} AS {c}" for c, e in C_EXPRS.items())} FROM gl),
c1 AS (SELECT rw.*, {RSI_PLAIN} AS rsi_14, sma_20 + 2.0 * price_volatility AS bb_upper, sma_20 AS bb_middle, sma_20 - 2.0 * price_volatility AS bb_lower FROM rw),
c2 AS (SELECT c1.*, v12 AS ema_12, v26 AS ema_26, macd, sg.v AS macd_signal, macd - sg.v AS macd_histogram,
  {div('bb_upper - bb_lower', 'bb_middle')} AS bb_width, {div('close - bb_lower', 'bb_upper - bb_lower')} AS bb_position
  FROM c1 JOIN mc USING (symbol, date) JOIN sg USING (symbol, date))"""
query(
    "features_c",
    f"WITH {BARS_N}, {C_SQL} SELECT symbol, date, {', '.join(q6(c, c) for c in C_COLS)} FROM c2 WHERE cnt >= 60 AND {' AND '.join(f'{c} IS NOT NULL' for c in C_COLS)}",
)(lambda spark, d: out(ft.features_c(t.bars_nation(spark, d)), C_COLS))

LABEL = """CASE WHEN lead(close) OVER (PARTITION BY symbol ORDER BY date) IS NOT NULL THEN
 greatest(least((lead(close) OVER (PARTITION BY symbol ORDER BY date) - close) / nullif(close, 0) * 100.0, 50.0), -50.0) END"""
LAB = f"lab AS (SELECT *, {LABEL} AS label FROM bars)"
query("target_pct", f"WITH {BARS_S}, {LAB} SELECT symbol, date, {q6('label', 'label')} FROM lab WHERE label IS NOT NULL")(
    lambda spark, d: out(ft.target_pct(t.bars_supplier(spark, d)), ["label"])
)
MATRIX = f"""{FEAT}, lab AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS rows_,
 {LABEL} AS label FROM feat)"""


@query("training_matrix", f"WITH {BARS_N}, {MATRIX} SELECT symbol, date, {F_SQL}, {q6('label', 'label')} FROM lab WHERE rows_ >= 252 AND label IS NOT NULL")
def training_matrix(spark, d):
    return out(ft.training_matrix(ft.features_b(nation_bars(spark, d))), [*FEATURES_38, "label"])


@query("stack_all_symbols", f"WITH {BARS_N}, {MATRIX} SELECT symbol, date, {F_SQL}, {q6('label', 'label')} FROM lab WHERE rows_ >= 252 AND label IS NOT NULL AND symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 252)")
def stack_all_symbols(spark, d):
    return out(ft.stack_all_symbols(nation_bars(spark, d)), [*FEATURES_38, "label"])


SEQ = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"


@query(
    "sequence_windows",
    f"""WITH {BARS_N}, s AS (SELECT symbol, date, close, count(*) {SEQ} AS n, list(close) {SEQ} AS cl, list(volume) {SEQ} AS vl FROM bars)
SELECT symbol, date, {q6('close', 'target')}, CAST(n AS INTEGER) AS length, {q6('cl[1]', 'first_close')}, {q6('cl[60]', 'last_close')}, {q6('list_sum(cl)', 'sum_close')}, {q6('list_sum(vl)', 'sum_volume')} FROM s WHERE n = 60""",
)
def sequence_windows(spark, d):
    s = ft.sequence_windows(t.bars_nation(spark, d), ["close", "volume"])
    total = lambda i: F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[i])
    return s.select(
        "symbol", "date", r6("target").alias("target"), F.size("sequence").alias("length"),
        r6(F.col("sequence")[0][0]).alias("first_close"), r6(F.col("sequence")[59][0]).alias("last_close"),
        r6(total(0)).alias("sum_close"), r6(total(1)).alias("sum_volume"),
    )


@query(
    "chronological_split",
    f"""WITH {BARS_S} SELECT symbol, date, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY date) <= floor({CNT} * 0.8) THEN 'train' ELSE 'test' END AS split FROM bars""",
)
def chronological_split(spark, d):
    return ft.chronological_split(t.bars_supplier(spark, d)).select("symbol", "date", "split")


@query(
    "ordered_split",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.85) THEN 'valid' ELSE 'test' END AS split FROM r""",
)
def ordered_split(spark, d):
    return ft.ordered_split(t.table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "split")


@query("shuffled_split", "WITH n AS (SELECT count(*) AS n FROM orders) SELECT 'train' AS split, CAST(n - floor(n * 0.2) AS BIGINT) AS row_count FROM n UNION ALL SELECT 'test', CAST(floor(n * 0.2) AS BIGINT) FROM n")
def shuffled_split(spark, d):
    split = ft.shuffled_split(t.table(spark, d, "orders"), "o_orderkey")
    return split.groupBy("split").agg(F.count_distinct("o_orderkey").alias("row_count"))


@query("kfold", "WITH n AS (SELECT count(*) AS n FROM orders), f AS (SELECT unnest(range(7)) AS fold) SELECT CAST(fold AS INTEGER) AS fold, CAST(CASE WHEN fold < 6 THEN n // 7 ELSE n - 6 * (n // 7) END AS BIGINT) AS row_count FROM f, n")
def kfold(spark, d):
    folds = ft.kfold(t.table(spark, d, "orders"), "o_orderkey", 7)
    return folds.groupBy("fold").agg(F.count_distinct("o_orderkey").alias("row_count"))


def order_numbers(spark, d):
    o = t.table(spark, d, "orders")
    return o.select("o_orderkey", (F.col("o_totalprice") / 1000.0).alias("price"), F.dayofyear("o_orderdate").cast("double").alias("day"))


ONUM = "o AS (SELECT o_orderkey, o_totalprice / 1000.0 AS price, CAST(dayofyear(o_orderdate) AS DOUBLE) AS day FROM orders)"


@query(
    "standard_scaler",
    f"WITH {ONUM}, s AS (SELECT avg(price) AS mp, stddev_pop(price) AS sp, avg(day) AS md, stddev_pop(day) AS sd FROM o) SELECT o_orderkey, {q6('(price - mp) / sp', 'price_z')}, {q6('(day - md) / sd', 'day_z')} FROM o, s",
)
def standard_scaler(spark, d):
    return out(ft.standard_scaler(order_numbers(spark, d), ["price", "day"]), ["price_z", "day_z"], ["o_orderkey"])


@query(
    "minmax_scaler",
    f"WITH {ONUM}, s AS (SELECT min(price) AS mp, max(price) AS sp, min(day) AS md, max(day) AS sd FROM o) SELECT o_orderkey, {q6('(price - mp) / (sp - mp)', 'price_mm')}, {q6('(day - md) / (sd - md)', 'day_mm')} FROM o, s",
)
def minmax_scaler(spark, d):
    return out(ft.minmax_scaler(order_numbers(spark, d), ["price", "day"]), ["price_mm", "day_mm"], ["o_orderkey"])


@query(
    "outlier_filter",
    f"WITH {ONUM}, s AS (SELECT avg(price) AS mp, stddev_pop(price) AS sp, avg(day) AS md, stddev_pop(day) AS sd FROM o) SELECT o_orderkey FROM o, s WHERE abs(price - mp) <= 1.5 * sp AND abs(day - md) <= 1.5 * sd",
)
def outlier_filter(spark, d):
    return ft.outlier_filter(order_numbers(spark, d), ["price", "day"], 1.5).select("o_orderkey")


@query("subsample", "SELECT CAST(least(count(*), 500) AS BIGINT) AS kept, true AS all_known FROM orders")
def subsample(spark, d):
    o = t.table(spark, d, "orders")
    s = ft.subsample(o, "o_orderkey", 500)
    return s.agg(F.count_distinct("o_orderkey").alias("kept"), F.bool_and(F.col("o_totalprice").isNotNull()).alias("all_known"))


@query(
    "describe",
    f"""WITH {ONUM} SELECT 'price' AS "column", {q6('avg(price)', 'mean')}, {q6('stddev_pop(price)', 'std')}, {q6('min(price)', 'min')}, {q6('max(price)', 'max')} FROM o
UNION ALL SELECT 'day', {q6('avg(day)', 'mean')}, {q6('stddev_pop(day)', 'std')}, {q6('min(day)', 'min')}, {q6('max(day)', 'max')} FROM o""",
)
def describe(spark, d):
    return out(ft.describe(order_numbers(spark, d), ["price", "day"]), ["mean", "std", "min", "max"], ["column"])
