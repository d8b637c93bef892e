"""Merging of storage tiers, live quotes and fetched bars.

Duplicates are resolved by an aggregate on (symbol, date), which combines on the map side,
rather than by a ranking window: a date with very many copies costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwright.functions.numeric import ratio
from tickwright.schema import FALLBACK_USD_INR

TIER_RANK = {"past": 0, "latest": 1, "permanent": 2}


def pick_per_key(df: DataFrame, keys: list[str], order, keep: str) -> DataFrame:
    """One row per key: the one with the largest (``last``) or smallest (``first``) order."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def resolve_tier(bars: DataFrame) -> DataFrame:
    """Per symbol the ``past`` rows, or the ``permanent`` rows where there are no past ones."""
    stored = bars.where(F.col("tier").isin("past", "permanent"))
    rank = F.when(F.col("tier") == "past", 0).otherwise(1)
    best = stored.groupBy("symbol").agg(F.min(rank).alias("_best"))
    return stored.join(best, "symbol").where(rank == F.col("_best")).select(*bars.columns)


def resolve_history(past: DataFrame, latest: DataFrame, permanent: DataFrame) -> DataFrame:
    """past and latest; permanent only for symbols that occur in neither."""
    known = past.select("symbol").union(latest.select("symbol")).distinct()
    spare = permanent.join(known, "symbol", "left_anti")
    return past.unionByName(latest, allowMissingColumns=True).unionByName(spare, allowMissingColumns=True)


def combine(first: DataFrame, second: DataFrame, keep: str = "last") -> DataFrame:
    """One row per (symbol, date) of two sources; ``keep`` names the source that wins."""
    both = first.withColumn("_src", F.lit(0)).unionByName(
        second.withColumn("_src", F.lit(1)), allowMissingColumns=True
    )
    values = [c for c in both.columns if c not in ("symbol", "date", "_src")]
    order = F.struct("_src", *[F.col(c) for c in values])
    return pick_per_key(both, ["symbol", "date"], order, keep).drop("_src")


def combine_keep_last(hist: DataFrame, latest: DataFrame) -> DataFrame:
    """Later source wins; rows without date or close are dropped."""
    return combine(hist, latest, "last").na.drop(subset=["date", "close"])


def combine_keep_first(past: DataFrame, latest: DataFrame) -> DataFrame:
    return combine(past, latest, "first")


def append_live_bar(bars: DataFrame, quotes: DataFrame, rate: float = FALLBACK_USD_INR) -> DataFrame:
    """Adds one live row per quoted symbol; INR quotes are divided by the rate."""
    price = F.when(F.col("currency") == "INR", F.col("price") / F.lit(rate)).otherwise(F.col("price"))

    def scaled(c):
        return F.coalesce(
            F.when(F.col("currency") == "INR", F.col(c) / F.lit(rate)).otherwise(F.col(c)), price
        )

    live = quotes.select(
        "symbol",
        "date",
        *[scaled(c).alias(c) for c in ("open", "high", "low")],
        price.alias("close"),
        F.lit(None).cast("double").alias("volume"),
        F.lit("live").alias("data_source"),
    )
    return bars.unionByName(live, allowMissingColumns=True)


def flat_bar(quotes: DataFrame) -> DataFrame:
    """A bar with all four prices equal to the quote."""
    return quotes.select(
        "symbol",
        "date",
        *[F.col("price").alias(c) for c in ("open", "high", "low", "close")],
        F.lit(0.0).alias("volume"),
    )


def append_today_if_missing(history: DataFrame, quotes: DataFrame) -> DataFrame:
    """Adds a flat bar for symbols without a row on the quote's date."""
    fresh = flat_bar(quotes).join(history.select("symbol", "date"), ["symbol", "date"], "left_anti")
    return history.unionByName(fresh, allowMissingColumns=True)


def daily_bars_from_quotes(quotes: DataFrame) -> DataFrame:
    """First quote of each (symbol, day) as a bar; missing prices default to the quote."""
    opt = [c for c in ("open", "high", "low", "volume") if c in quotes.columns]
    first = (
        quotes.withColumn("date", F.to_date("ts"))
        .groupBy("symbol", "date")
        .agg(F.min_by(F.struct("price", *opt), F.struct("ts", "quote_id")).alias("q"))
    )

    def value(c, default):
        return F.coalesce(F.col(f"q.{c}"), default) if c in opt else default

    price = F.col("q.price")
    return first.select(
        "symbol",
        "date",
        *[value(c, price).alias(c) for c in ("open", "high", "low")],
        price.alias("close"),
        value("volume", F.lit(0.0)).alias("volume"),
    )


def insert_daily_bar_if_absent(table: DataFrame, quotes: DataFrame) -> DataFrame:
    """``table`` plus the day bars of quotes whose (symbol, date) it lacks."""
    fresh = daily_bars_from_quotes(quotes).join(
        table.select("symbol", "date"), ["symbol", "date"], "left_anti"
    )
    return table.unionByName(fresh, allowMissingColumns=True)


def upsert_latest_quote(table: DataFrame, quotes: DataFrame) -> DataFrame:
    """One row per symbol; a new quote replaces the stored row."""
    both = table.withColumn("_new", F.lit(0)).unionByName(
        quotes.select(*table.columns).withColumn("_new", F.lit(1))
    )
    return pick_per_key(both, ["symbol"], F.struct("_new", "ts", "quote_id"), "last").drop("_new")


def merge_fetched_bars(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Union by date, the existing row wins; dates leave as ``yyyy-MM-dd`` text."""
    return combine(existing, new, "first").withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def union_all_columns(*frames: DataFrame) -> DataFrame:
    """Union of frames with differing columns; missing values are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def except_on_key(left: DataFrame, right: DataFrame, key: str = "symbol") -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def normalize_ohlc_currency(bars: DataFrame, rates: DataFrame) -> DataFrame:
    """Prices of Indian bars in USD; symbols of a category without a positive rate are dropped."""
    joined = bars.join(rates, "category", "left")
    ind = F.col("category") == "ind_stocks"
    kept = joined.where(~ind | (F.coalesce(F.col("rate"), F.lit(0.0)) > 0))
    prices = {c: F.when(ind, ratio(c, "rate")).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}
    return kept.withColumns(prices).drop("rate")
