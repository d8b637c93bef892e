"""Per-symbol window helpers: the rules S2 (minimum periods), S7, S8 and S9 live here.

A bar table holds one row per (symbol, date); the readers and merge operators enforce it
with a map-side-combined aggregate. A window group is therefore bounded by the number of
calendar days (about 25 000 rows for 70 years), however many raw rows a symbol has, so
these windows need no salting: the skew is removed before the exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numeric import col, ratio

BLOCK = 256


def by_symbol(key: str = "symbol", order: str = "date"):
    return Window.partitionBy(key).orderBy(order)


def rolling(agg, c, n: int, w=None) -> Column:
    """``agg`` over the last ``n`` rows, NULL unless all ``n`` values exist (S2)."""
    frame = (w or by_symbol()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(c)).over(frame) == n, agg(col(c)).over(frame))


def symbol_rows(key: str = "symbol", order: str = "date") -> Column:
    """Whole-symbol row count for the length gates (S9).

    The frame is ordered although the count does not need it: it then joins the window node
    of the other per-symbol columns instead of forming one of its own.
    """
    every = by_symbol(key, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.count(F.lit(1)).over(every)


def pct_change(c, periods: int = 1, w=None) -> Column:
    return ratio(col(c), F.lag(col(c), periods).over(w or by_symbol())) - F.lit(1.0)


def gain_loss(c, prev: Column) -> tuple[Column, Column]:
    """Up and down moves; the missing first move counts as zero (S7)."""
    delta = F.coalesce(col(c) - prev, F.lit(0.0))
    return F.greatest(delta, F.lit(0.0)), F.greatest(-delta, F.lit(0.0))


# ---- shared primitives ------------------------------------------------------------------------
#
# Indicator groups ask for lags, rolling figures and the row count through these accessors. A
# caller that needs many groups first adds them all with ``with_primitives`` (two window nodes);
# the groups then find the columns instead of adding window nodes of their own.

AGGS = {"avg": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def lag_of(df: DataFrame, c: str, k: int = 1) -> Column:
    name = f"_lag_{c}_{k}"
    return F.col(name) if name in df.columns else F.lag(c, k).over(by_symbol())


def roll_of(df: DataFrame, stat: str, c: str, n: int) -> Column:
    """Rolling figure with the minimum-period rule."""
    name = f"_{stat}_{c}_{n}"
    if name not in df.columns:
        return rolling(AGGS[stat], c, n)
    return F.when(F.col("_t") - F.coalesce(f"_gap_{c}", F.lit(-1)) >= n, F.col(name))


def rows_of(df: DataFrame) -> Column:
    return F.col("_rows") if "_rows" in df.columns else symbol_rows()


def change_of(df: DataFrame, c: str, k: int = 1) -> Column:
    return ratio(col(c), lag_of(df, c, k)) - F.lit(1.0)


def with_primitives(df: DataFrame, lags=(), rolls=()) -> DataFrame:
    """Adds ``lags`` [(column, k)] and ``rolls`` [(stat, column, n)] for the accessors above.

    Everything after the row number is ordered by (block, row), the order of the exponential
    means, so one more sort serves all later window nodes. A rolling figure is valid when no
    NULL lies in its frame: the row of the last NULL is one running maximum per column,
    instead of one count per frame.
    """
    if "_t" not in df.columns:
        df = with_position(df.withColumn("_rows", symbol_rows()))
    w = ordered_blocks()
    cols = {f"_lag_{c}_{k}": F.lag(c, k).over(w) for c, k in lags}
    for c in {c for _, c, _ in rolls}:
        cols[f"_gap_{c}"] = F.max(F.when(F.col(c).isNull(), F.col("_t"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    for stat, c, n in rolls:
        cols[f"_{stat}_{c}_{n}"] = AGGS[stat](c).over(w.rowsBetween(-(n - 1), 0))
    return df.withColumns(cols)


def ordered_blocks(key: str = "symbol"):
    return Window.partitionBy(key).orderBy("_b", "_t")


def drop_primitives(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def with_position(df: DataFrame, key: str = "symbol", order: str = "date") -> DataFrame:
    """Adds ``_t`` (0-based row), ``_b`` (block) and ``_j`` (row within the block)."""
    if "_t" in df.columns:
        return df
    t = F.row_number().over(by_symbol(key, order)) - F.lit(1)
    return df.withColumn("_t", t).withColumns(
        {"_b": F.floor(F.col("_t") / F.lit(BLOCK)).cast("int"), "_j": F.col("_t") % F.lit(BLOCK)}
    )


def ema_over_blocks(df: DataFrame, pairs, key: str = "symbol") -> DataFrame:
    """Normalised exponential means (S8) on a frame that carries ``_t, _b, _j``.

    ``pairs`` lists (input column, span, output column). The divisor sums the weights of the
    rows that have a value, so NULLs neither count nor pull the mean; before the first value the
    mean is NULL. Sums are needed only where a value stands (its own weight is one, so what lies
    beyond the carried blocks is below 1e-18 of them); rows without a value only scale both sums
    alike, and take the mean of the last row that has one, however long ago that was. A scaled prefix sum over a whole history overflows, so sums are kept inside
    blocks of 256 rows and the ends of the earlier blocks are carried in by constant RANGE frames
    over the block number. Both window nodes ask for the order (symbol, block, row), so one sort
    serves them. Inputs with the same span and column share their sums.
    """
    inside = Window.partitionBy(key, "_b").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    local, ends, result = {}, {}, {}
    for source, span, out in pairs:
        r = 1.0 - 2.0 / (span + 1.0)
        if r <= 0.0:
            continue
        up, down = F.pow(F.lit(r), -F.col("_j").cast("double")), F.pow(F.lit(r), F.col("_j").cast("double"))
        for kind, value in (("s", F.col(source)), ("n", F.when(F.col(source).isNotNull(), F.lit(1.0)))):
            local[f"_{kind}_{source}_{span}"] = F.sum(value * up).over(inside) * down
    df = df.withColumns(local)

    def reach(r: float) -> int:
        return max(1, math.ceil(math.log(1e-18) / math.log(r) / BLOCK))

    for source, span, _ in pairs:
        r = 1.0 - 2.0 / (span + 1.0)
        for m in range(1, reach(r) + 1) if r > 0.0 else ():
            back = Window.partitionBy(key).orderBy("_b").rangeBetween(-m, -m)
            for kind in "sn":
                end = F.when(F.col("_j") == BLOCK - 1, F.col(f"_{kind}_{source}_{span}"))
                ends[f"_e{kind}{m}_{source}_{span}"] = F.max(end).over(back)
    df = df.withColumns(ends)

    for source, span, out in pairs:
        r = 1.0 - 2.0 / (span + 1.0)
        if r <= 0.0:  # all weight on the newest value
            result[out] = F.last(source, ignorenulls=True).over(ordered_blocks(key).rowsBetween(Window.unboundedPreceding, 0))
            continue
        totals = {}
        for kind in "sn":
            total = F.coalesce(f"_{kind}_{source}_{span}", F.lit(0.0))
            for m in range(1, reach(r) + 1):
                weight = F.pow(F.lit(r), (F.col("_j") + 1 + BLOCK * (m - 1)).cast("double"))
                total = total + F.coalesce(weight * F.col(f"_e{kind}{m}_{source}_{span}"), F.lit(0.0))
            totals[kind] = total
        mean = F.when(F.col(source).isNotNull(), totals["s"] / totals["n"])
        result[out] = F.last(mean, ignorenulls=True).over(ordered_blocks(key).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns(result).drop(*local, *ends)


def drop_position(df: DataFrame) -> DataFrame:
    return df.drop("_t", "_b", "_j")


def ema(df: DataFrame, c: str, spans: dict[int, str], key: str = "symbol", order: str = "date") -> DataFrame:
    """``ewm(span)`` of one column for several spans at once."""
    placed = with_position(df, key, order)
    return drop_position(ema_over_blocks(placed, [(c, s, out) for s, out in spans.items()], key))


class Staged:
    """Stands in for a frame and collects the columns that several groups add.

    Groups that only read columns of the frame itself are then added by one ``withColumns``,
    which analyses the plan once instead of once per group.
    """

    def __init__(self, df: DataFrame):
        self.df, self.columns, self.added = df, list(df.columns), {}

    def withColumns(self, cols: dict[str, Column]) -> "Staged":
        self.added |= cols
        return self

    def withColumn(self, name: str, c: Column) -> "Staged":
        return self.withColumns({name: c})

    @staticmethod
    def apply(df: DataFrame, *groups) -> DataFrame:
        stage = Staged(df)
        for group in groups:
            group(stage)
        return df.withColumns(stage.added)
