"""Queries for indicator library A."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwright.functions.numeric import r6
from tickwright.functions.windows import ema_over_blocks, with_position
from tickwright.operators import indicators as ind
from tickwright.sources.tables import bars_nation, bars_supplier

from .registry import BARS_N, BARS_S, div, lag, query, roll
from .registry import r6 as q6


def out(df, cols, keys=("symbol", "date")):
    return df.select(*keys, *[r6(c).alias(c) for c in cols])


def simple(name, build, cols, exprs, bars=BARS_S, source=bars_supplier):
    """Register ``build`` with a one-level SELECT over the bars as oracle."""
    sql = f"WITH {bars} SELECT symbol, date, " + ", ".join(q6(e, c) for c, e in zip(cols, exprs)) + " FROM bars"
    query(name, sql)(lambda spark, d: out(build(source(spark, d)), cols))


def staged(name, build, cols, ctes, exprs, last, bars=BARS_S, source=bars_supplier):
    """As ``simple`` with extra CTEs between the bars and the final select."""
    sql = (
        f"WITH {bars}, {ctes} SELECT symbol, date, "
        + ", ".join(q6(e, c) for c, e in zip(cols, exprs))
        + f" FROM {last}"
    )
    query(name, sql)(lambda spark, d: out(build(source(spark, d)), cols))


NS = [5, 10, 20, 50, 200]
CNT = "count(*) OVER (PARTITION BY symbol)"

simple("sma", ind.sma, [f"sma_{n}" for n in NS], [roll("avg", "close", n) for n in NS])
staged(
    "sma_ratio",
    lambda b: ind.sma_ratio(ind.sma(b)),
    [f"sma_{n}_ratio" for n in NS],
    "m AS (SELECT *, " + ", ".join(f"{roll('avg', 'close', n)} AS s{n}" for n in NS) + f", {CNT} AS cnt FROM bars)",
    [f"CASE WHEN cnt >= {n} THEN coalesce({div('close', f's{n}')}, 1.0) END" for n in NS],
    "m",
)


def ema_sql(src: str, col: str, span: int, name: str, tbl: str) -> str:
    """EMA oracle: the defining weighted sum over all earlier rows."""
    r = 1.0 - 2.0 / (span + 1.0)
    return f"""{name} AS (
  SELECT a.symbol, a.date, a.t,
         sum(b.{col} * pow({r!r}, a.t - b.t)) / sum(pow({r!r}, a.t - b.t)) AS v
  FROM {tbl} a JOIN {tbl} b ON a.symbol = b.symbol AND b.t <= a.t GROUP BY 1, 2, 3)"""


NUM = f"""num AS (SELECT symbol, date, close, {CNT} AS cnt,
  row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS t FROM bars)"""
EMAS = f"""{NUM}, {ema_sql('num', 'close', 12, 'e12', 'num')}, {ema_sql('num', 'close', 26, 'e26', 'num')},
em AS (SELECT num.*, e12.v AS v12, e26.v AS v26 FROM num JOIN e12 USING (symbol, date) JOIN e26 USING (symbol, date))"""
staged(
    "ema", ind.ema, ["ema_12", "ema_26"], EMAS,
    ["CASE WHEN cnt >= 12 THEN v12 END", "CASE WHEN cnt >= 26 THEN v26 END"], "em",
)
GAPS = f"""{NUM}, holes AS (SELECT symbol, date, t, CASE WHEN t % 11 <> 3 THEN close END AS close FROM num)"""


@query(
    "ema_gaps",
    f"""WITH {BARS_S}, {GAPS} SELECT a.symbol, a.date, {q6(
        f"sum(b.close * pow({1.0 - 2.0 / 13.0!r}, a.t - b.t)) / sum(CASE WHEN b.close IS NOT NULL THEN pow({1.0 - 2.0 / 13.0!r}, a.t - b.t) END)", "ema_12")}
FROM holes a JOIN holes b ON a.symbol = b.symbol AND b.t <= a.t GROUP BY 1, 2""",
)
def ema_gaps(spark, d):
    """Every eleventh close is missing; the mean weighs the rows that are there."""
    placed = with_position(bars_supplier(spark, d))
    holes = placed.withColumn("close", F.when(F.col("_t") % 11 != 3, F.col("close")))
    return out(ema_over_blocks(holes, [("close", 12, "ema_12")]), ["ema_12"])


LONG_GAP = f"""{NUM}, holes AS (SELECT symbol, date, t, CASE WHEN t NOT BETWEEN 20 AND 619 THEN close END AS close FROM num)"""


@query(
    "ema_long_gap",
    f"""WITH {BARS_N}, {LONG_GAP} SELECT a.symbol, a.date, {q6(
        f"sum(b.close * pow({1.0 - 2.0 / 13.0!r}, a.t - b.t)) / sum(CASE WHEN b.close IS NOT NULL THEN pow({1.0 - 2.0 / 13.0!r}, a.t - b.t) END)", "ema_12")}
FROM holes a JOIN holes b ON a.symbol = b.symbol AND b.t <= a.t GROUP BY 1, 2""",
)
def ema_long_gap(spark, d):
    """No close in rows 20 to 619 of a series; the mean stays what it was."""
    placed = with_position(bars_nation(spark, d))
    holes = placed.withColumn("close", F.when(~F.col("_t").between(20, 619), F.col("close")))
    return out(ema_over_blocks(holes, [("close", 12, "ema_12")]), ["ema_12"])


staged(
    "ema_ratio", lambda b: ind.ema_ratio(ind.ema(b)), ["ema_12_ratio", "ema_26_ratio"], EMAS,
    [f"CASE WHEN cnt >= 12 THEN coalesce({div('close', 'v12')}, 1.0) END",
     f"CASE WHEN cnt >= 26 THEN coalesce({div('close', 'v26')}, 1.0) END"], "em",
)
MACD = f"""{EMAS}, mc AS (SELECT symbol, date, t, cnt, v12 - v26 AS macd FROM em),
{ema_sql('mc', 'macd', 9, 'sg', 'mc')},
mm AS (SELECT mc.*, sg.v AS signal FROM mc JOIN sg USING (symbol, date))"""
MACD_EXPRS = [f"CASE WHEN cnt >= 26 THEN {e} ELSE 0.0 END" for e in ("macd", "signal", "macd - signal")]
staged("macd", ind.macd, ["macd", "macd_signal", "macd_histogram"], MACD, MACD_EXPRS, "mm")

DELTA = f"dl AS (SELECT *, {CNT} AS cnt, coalesce(close - {lag('close')}, 0.0) AS d FROM bars)"
GL = f"{DELTA}, gl AS (SELECT *, greatest(d, 0.0) AS g, greatest(-d, 0.0) AS l FROM dl)"
RSIW = f"{GL}, rw AS (SELECT *, {roll('avg', 'g', 14)} AS ag, {roll('avg', 'l', 14)} AS al FROM gl)"
RSI_EXPR = f"CASE WHEN cnt >= 15 THEN 100.0 - 100.0 / (1.0 + coalesce({div('ag', 'al')}, 1.0)) ELSE 50.0 END"
staged("rsi_guarded", ind.rsi_guarded, ["rsi"], RSIW, [RSI_EXPR], "rw")

BB = f"""bm AS (SELECT *, {CNT} AS cnt, {roll('avg', 'close', 20)} AS mid, {roll('stddev_samp', 'close', 20)} AS sd FROM bars),
bb AS (SELECT *, CASE WHEN cnt >= 20 THEN mid ELSE close END AS bmid,
  CASE WHEN cnt >= 20 THEN mid + 2.0 * sd ELSE close END AS bup,
  CASE WHEN cnt >= 20 THEN mid - 2.0 * sd ELSE close END AS blo FROM bm)"""
staged("bollinger", ind.bollinger, ["bb_middle", "bb_upper", "bb_lower"], BB, ["bmid", "bup", "blo"], "bb")
staged(
    "bb_width_position", lambda b: ind.bb_shape(ind.bollinger(b)), ["bb_width", "bb_position"], BB,
    [f"coalesce({div('bup - blo', 'bmid')}, 0.0)", f"coalesce({div('close - blo', 'bup - blo')}, 0.5)"], "bb",
)
CH = div("close", lag("close")) + " - 1.0"
simple("price_change", ind.price_change, ["price_change", "price_change_abs"], [CH, f"abs({CH})"])
simple("return_d", ind.returns, [f"return_{d}d" for d in (1, 5, 10)],
       [div("close", lag("close", d)) + " - 1.0" for d in (1, 5, 10)])
simple("momentum_d", ind.momentum, [f"momentum_{d}d" for d in (5, 10, 20)],
       [div("close", lag("close", d)) + " - 1.0" for d in (5, 10, 20)])
VOL = f"ch AS (SELECT *, {CH} AS chg FROM bars)"
staged("volatility_w", lambda b: ind.volatility(ind.price_change(b)), [f"volatility_{n}d" for n in (5, 10, 20)],
       VOL, [roll("stddev_samp", "chg", n) for n in (5, 10, 20)], "ch")
TR = f"""pc AS (SELECT *, {lag('close')} AS pc FROM bars),
tr AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM pc)"""
staged("atr", ind.atr, ["atr"], TR, [roll("avg", "tr", 14)], "tr")
simple("hl_oc_ratio", ind.day_ratios, ["hl_ratio", "oc_ratio"],
       [f"coalesce({div('high', 'low')}, 1.0)", f"coalesce({div('open', 'close')}, 1.0)"])
simple("price_position_body", ind.day_shape, ["price_position", "body_size"],
       [f"coalesce({div('close - low', 'high - low')}, 0.5)", f"coalesce({div('abs(close - open)', 'high - low')}, 0.0)"])
KS = [1, 2, 3, 5, 10]
LAG_COLS = [c for k in KS for c in (f"close_lag_{k}", f"close_lag_{k}_ratio")]
LAG_EXPRS = [e for k in KS for e in (lag("close", k), f"coalesce({div('close', lag('close', k))}, 1.0)")]
simple("close_lags", ind.close_lags, LAG_COLS, LAG_EXPRS)
RL = [(c, k) for k in (1, 2, 5) for c in ("high", "low")]
simple("high_low_lags", ind.range_lags, [f"{c}_lag_{k}" for c, k in RL], [lag(c, k) for c, k in RL])
RS = [(s, f, n) for n in (5, 10, 20) for s, f in (("min", "min"), ("max", "max"), ("std", "stddev_samp"))]
simple("rolling_stats", ind.rolling_stats, [f"close_{s}_{n}" for s, _, n in RS], [roll(f, "close", n) for _, f, n in RS])
CP = [div(f"close - {roll('min', 'close', n)}", f"{roll('max', 'close', n)} - {roll('min', 'close', n)}") for n in (5, 10, 20)]
simple("close_position_w", lambda b: ind.close_position(ind.rolling_stats(b)),
       [f"close_position_{n}" for n in (5, 10, 20)], CP)

# The complete library on the nation bars, checked column by column.
ALL_COLS, ALL_EXPRS = [], []
for n in NS:
    ALL_COLS += [f"sma_{n}", f"sma_{n}_ratio"]
    s = roll("avg", "close", n)
    ALL_EXPRS += [s, f"CASE WHEN cnt >= {n} THEN coalesce({div('close', s)}, 1.0) END"]
ALL_COLS += ["ema_12", "ema_12_ratio", "ema_26", "ema_26_ratio", "macd", "macd_signal", "macd_histogram", "rsi"]
ALL_EXPRS += [
    "CASE WHEN cnt >= 12 THEN v12 END", f"CASE WHEN cnt >= 12 THEN coalesce({div('close', 'v12')}, 1.0) END",
    "CASE WHEN cnt >= 26 THEN v26 END", f"CASE WHEN cnt >= 26 THEN coalesce({div('close', 'v26')}, 1.0) END",
    *MACD_EXPRS, RSI_EXPR,
]
ALL_COLS += ["bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_position", "price_change", "price_change_abs"]
ALL_EXPRS += ["bmid", "bup", "blo", f"coalesce({div('bup - blo', 'bmid')}, 0.0)",
              f"coalesce({div('close - blo', 'bup - blo')}, 0.5)", "chg", "abs(chg)"]
for d in (1, 5, 10):
    ALL_COLS.append(f"return_{d}d")
    ALL_EXPRS.append(div("close", lag("close", d)) + " - 1.0")
for d in (5, 10, 20):
    ALL_COLS += [f"momentum_{d}d", f"volatility_{d}d"]
    ALL_EXPRS += [div("close", lag("close", d)) + " - 1.0", roll("stddev_samp", "chg", d)]
ALL_COLS += ["atr", "hl_ratio", "oc_ratio", "price_position", "body_size"]
ALL_EXPRS += [roll("avg", "tr", 14), f"coalesce({div('high', 'low')}, 1.0)", f"coalesce({div('open', 'close')}, 1.0)",
              f"coalesce({div('close - low', 'high - low')}, 0.5)", f"coalesce({div('abs(close - open)', 'high - low')}, 0.0)"]
ALL_COLS += LAG_COLS + [f"{c}_lag_{k}" for c, k in RL] + [f"close_{s}_{n}" for s, _, n in RS] + [f"close_position_{n}" for n in (5, 10, 20)]
ALL_EXPRS += LAG_EXPRS + [lag(c, k) for c, k in RL] + [roll(f, "close", n) for _, f, n in RS] + CP
ALL_CTES = f"""{MACD},
g1 AS (SELECT bars.*, mm.macd, mm.signal, em.v12, em.v26, em.cnt,
  {lag('bars.close')} AS pc FROM bars JOIN mm USING (symbol, date) JOIN em USING (symbol, date)),
g2 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  {div('close', 'pc')} - 1.0 AS chg, greatest(coalesce(close - pc, 0.0), 0.0) AS g,
  greatest(coalesce(pc - close, 0.0), 0.0) AS l, {roll('avg', 'close', 20)} AS mid, {roll('stddev_samp', 'close', 20)} AS sd FROM g1),
g3 AS (SELECT *, {roll('avg', 'g', 14)} AS ag, {roll('avg', 'l', 14)} AS al,
  CASE WHEN cnt >= 20 THEN mid ELSE close END AS bmid,
  CASE WHEN cnt >= 20 THEN mid + 2.0 * sd ELSE close END AS bup,
  CASE WHEN cnt >= 20 THEN mid - 2.0 * sd ELSE close END AS blo FROM g2)"""
staged("all_indicators", ind.all_indicators, ALL_COLS, ALL_CTES, ALL_EXPRS, "g3", BARS_N, bars_nation)


@query("feature_columns", None)
def feature_columns(spark, d):
    """Non-NULL count per feature column, one row per name (the list comes from the schema)."""
    frame = ind.all_indicators(bars_nation(spark, d))
    names = ind.feature_columns(frame)
    counts = frame.agg(*[F.count(c).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(c).alias("non_null")) for i, c in enumerate(names)])
    return counts.select(F.inline(pairs))


SUP_NULLS = " AND ".join(f"({e}) IS NOT NULL" for e in ("s20", "chg", "v5", "y"))
query(
    "supervised_raw",
    f"""WITH {BARS_N}, ch AS (SELECT *, {CH} AS chg, {roll('avg', 'close', 20)} AS s20 FROM bars),
f AS (SELECT *, abs(chg) AS achg, {roll('stddev_samp', 'chg', 5)} AS v5, {lag('close', -1)} AS y FROM ch)
SELECT symbol, date, {q6('s20', 'sma_20')}, {q6('chg', 'price_change')}, {q6('v5', 'volatility_5d')}, {q6('y', 'y')}
FROM f WHERE {SUP_NULLS}""".replace("lag(close, -1)", "lead(close, 1)"),
)(
    lambda spark, d: out(
        ind.supervised_raw(ind.volatility(ind.price_change(ind.sma(bars_nation(spark, d), [20])), [5])),
        ["sma_20", "price_change", "volatility_5d", "y"],
    )
)
