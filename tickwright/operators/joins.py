"""As-of joins and rate resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwright.schema import FALLBACK_USD_INR


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    ts: str,
    values: list[str],
    tolerance: int,
    slice_seconds: int = 60,
) -> DataFrame:
    """Newest ``right`` row at or before each ``left`` row, younger than ``tolerance`` seconds.

    Time is cut into slices. A slice sees its own right rows plus one carried row: the newest
    of the earlier slices within the tolerance. Both sides meet by an equi join on the slice,
    where each left row matches exactly one validity interval, so no pairs pile up, and AQE
    can split a slice that holds a large share of the left rows. Right rows of one instant are
    reduced to one (the largest values) by a map-side-combined aggregate first.
    """
    def slot(c):
        return F.floor(F.unix_micros(c) / F.lit(slice_seconds * 1_000_000))

    reach = tolerance // slice_seconds + 1
    own = (
        right.select(*by, F.col(ts).alias("_rts"), *values)
        .groupBy(*by, "_rts")
        .agg(F.max(F.struct(*values)).alias("_v"))
        .withColumn("_slot", slot("_rts"))
    )
    newest = own.groupBy(*by, "_slot").agg(F.max(F.struct("_rts", "_v")).alias("_n"))
    carried = (
        newest.select(*by, F.explode(F.sequence(F.col("_slot") + 1, F.col("_slot") + reach)).alias("_slot"), "_n")
        .groupBy(*by, "_slot")
        .agg(F.max("_n").alias("_n"))
        .select(*by, "_slot", F.col("_n._rts").alias("_rts"), F.col("_n._v").alias("_v"))
    )
    w = Window.partitionBy(*by, "_slot").orderBy("_rts")
    spans = own.select(*by, "_slot", "_rts", "_v").unionByName(carried).withColumn("_next", F.lead("_rts").over(w))
    placed = left.withColumn("_slot", slot(ts))
    match = [placed[c] == spans[c] for c in [*by, "_slot"]]
    cond = (placed[ts] >= spans["_rts"]) & (spans["_next"].isNull() | (placed[ts] < spans["_next"]))
    fresh = F.unix_micros(placed[ts]) < F.unix_micros(spans["_rts"]) + F.lit(tolerance * 1_000_000)
    for m in match:
        cond = cond & m
    joined = placed.join(spans, cond & fresh, "left")
    return joined.select(
        *[placed[c] for c in left.columns],
        spans["_rts"].alias("matched_ts"),
        *[spans["_v"].getField(v).alias(v) for v in values],
    )


def fx_rate(rates: DataFrame, by: list[str], fallback: float = FALLBACK_USD_INR) -> DataFrame:
    """First positive rate by source priority, else the fallback."""
    positive = F.when(F.col("rate") > 0, F.col("rate"))
    best = F.min_by(positive, F.when(F.col("rate") > 0, F.col("priority")))
    return rates.groupBy(*by).agg(F.coalesce(best, F.lit(fallback)).alias("rate"))


def fx_rate_as_of(quotes: DataFrame, fx: DataFrame, ttl: int = 3600, fallback: float = FALLBACK_USD_INR) -> DataFrame:
    """Adds the last known rate younger than ``ttl`` seconds, else the fallback."""
    out = asof_join(quotes, fx, [], "ts", ["rate"], ttl)
    return out.withColumn("rate", F.coalesce("rate", F.lit(fallback)))
