"""The read queries of the service: search, history, latest price, price card, chart."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwright.functions.scalar import convert_price, currency_for_category
from tickwright.schema import FALLBACK_USD_INR

# Symbols offered when a search finds nothing.
POPULAR = [
    ("AAPL", "Apple Inc."),
    ("GOOGL", "Alphabet Inc."),
    ("MSFT", "Microsoft Corporation"),
    ("AMZN", "Amazon.com Inc."),
    ("TSLA", "Tesla Inc."),
    ("META", "Meta Platforms Inc."),
    ("NVDA", "NVIDIA Corporation"),
    ("NFLX", "Netflix Inc."),
]


def search(dim: DataFrame, q: str, regex: bool = False, per_category: int | None = None, cap: int | None = None) -> DataFrame:
    """Matches on symbol or company name, one row per symbol; all of them unless a report is asked for.

    With ``per_category`` the first so many of each category count, with ``cap`` so many in all.
    The per-category rank is a group limit, applied per task before the shuffle, so a category
    that holds most of the rows sends few of them.
    """
    text = q.strip().lower()
    if not text:
        return dim.select("symbol", F.col("company_name").alias("name")).limit(0)
    pattern = text if regex else re.escape(text)
    hit = F.lower("symbol").rlike(pattern) | F.lower("company_name").rlike(pattern)
    rank = F.row_number().over(Window.partitionBy("category").orderBy("symbol", "company_name"))
    # US listings come first, as in the per-category scan order.
    order = F.struct((F.col("category") != "us_stocks").alias("o"), "company_name")
    top = dim.where(hit)
    if per_category is not None:
        top = top.withColumn("_rank", rank).where(F.col("_rank") <= per_category)
    found = top.groupBy("symbol").agg(F.min(F.struct(order.alias("o"), F.col("company_name").alias("name"))).alias("_r"))
    if cap is not None:
        found = found.orderBy("_r.o.o", "symbol").limit(cap)
    return found.select("symbol", "_r.name")


def search_with_fallback(dim: DataFrame, q: str, per_category: int | None = None, cap: int | None = None) -> DataFrame:
    """``search``; the popular list filtered by substring when it finds nothing."""
    spark = dim.sparkSession
    found = search(dim, q, per_category=per_category, cap=cap)
    popular = spark.createDataFrame(POPULAR, "symbol string, name string")
    text = q.strip().lower()
    hits = popular.where(F.lower("symbol").contains(text) | F.lower("name").contains(text))
    none_found = found.agg(F.count(F.lit(1)) == 0).scalar()
    return found.unionByName(hits.where(none_found))


# Period lengths in days, minimum points and fallback sizes.
PERIOD_DAYS = {"week": 7, "month": 30}
YEAR_START = "2024-01-01"
MIN_POINTS = {"week": 5, "month": 20, "5year": 100}
FALLBACK_DAYS = {"week": 14, "month": 60}
FALLBACK_ROWS = {"week": 10, "month": 30, "year": 250}


def history(bars: DataFrame, dim: DataFrame, period: str, as_of: str, year_start: str = YEAR_START) -> DataFrame:
    """Bars of a period with text dates, volume default 0 and the symbol's currency."""
    df = bars
    if period in PERIOD_DAYS:
        df = df.where(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), PERIOD_DAYS[period]))
    elif period == "year":
        df = df.where(F.col("date") >= F.lit(year_start).cast("date"))
    elif period != "5year":
        raise ValueError(f"unknown period {period}")
    return df.join(dim.select("symbol", F.col("currency").alias("_cur")), "symbol", "left").select(
        "symbol",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "open",
        "high",
        "low",
        "close",
        F.coalesce("volume", F.lit(0.0)).alias("volume"),
        F.coalesce("_cur", F.lit("USD")).alias("currency"),
    )


def needs_more_points(points: DataFrame, period: str) -> DataFrame:
    """Symbols' point counts and whether they fall short of the period's minimum."""
    return points.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "needs_more", F.col("n") < MIN_POINTS.get(period, 1)
    )


def fallback_tail(bars: DataFrame, period: str, as_of: str) -> DataFrame:
    """Recent rows of the period, or the symbol's last rows when it has no recent ones."""
    if period == "5year":
        return bars
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    tail = back <= FALLBACK_ROWS[period]
    if period == "year":
        return bars.withColumn("_keep", tail).where("_keep").drop("_keep")
    recent = F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), FALLBACK_DAYS[period])
    any_recent = F.max(recent).over(Window.partitionBy("symbol"))
    return bars.withColumn("_keep", F.when(any_recent, recent).otherwise(tail)).where("_keep").drop("_keep")


def latest_row(bars: DataFrame) -> DataFrame:
    """The newest bar of every symbol (aggregate, combined on the map side)."""
    rest = [c for c in bars.columns if c not in ("symbol", "date")]
    order = F.struct("date", *rest)
    return bars.groupBy("symbol").agg(F.max(order).alias("_r")).select("symbol", "_r.*")


def latest_price_per_symbol(bars: DataFrame) -> DataFrame:
    """Price, timestamp, currency and category of each symbol's last bar."""
    last = latest_row(bars.select("symbol", "date", "close", "category"))
    return last.select(
        "symbol",
        F.col("close").alias("price"),
        F.col("date").alias("timestamp"),
        currency_for_category("category").alias("currency"),
        "category",
    )


def latest_day_ohlcv(latest: DataFrame, permanent: DataFrame) -> DataFrame:
    """Last OHLCV of the latest tier, else of the permanent one."""
    cols = ["symbol", "date", "open", "high", "low", "close", "volume"]
    both = latest.select(*cols, F.lit(1).alias("_live")).unionByName(
        permanent.select(*cols, F.lit(0).alias("_live"))
    )
    order = F.struct("_live", *cols[1:])
    return both.groupBy("symbol").agg(F.max(order).alias("_r")).select("symbol", *[f"_r.{c}" for c in cols[1:]])


def price_card(live: DataFrame, stored: DataFrame, dim: DataFrame, rate: float = FALLBACK_USD_INR) -> DataFrame:
    """Live price, else the stored close, with metadata, OHLCV and both currencies."""
    s = stored.select(
        "symbol", F.col("date").alias("_date"), *[F.col(c) for c in ("open", "high", "low", "close", "volume")]
    )
    q = live.select("symbol", F.col("price").alias("_live"))
    joined = dim.join(q, "symbol", "left").join(s, "symbol", "left")
    is_live = F.col("_live").isNotNull()
    price = F.coalesce("_live", "close")
    usd = F.lit("USD")
    return joined.where(price.isNotNull()).select(
        "symbol",
        price.alias("price"),
        F.when(is_live, "live").otherwise("stored").alias("source"),
        is_live.alias("source_reliable"),
        F.when(~is_live, F.col("_date")).alias("data_date"),
        "company_name",
        "sector",
        "market_cap",
        "headquarters",
        "exchange",
        "currency",
        "open",
        "high",
        "low",
        "close",
        "volume",
        convert_price(price, "currency", F.lit("INR"), F.lit(rate)).alias("price_inr"),
        convert_price(price, "currency", usd, F.lit(rate)).alias("price_usd"),
        F.lit(rate).alias("exchange_rate"),
    )


def last_n(bars: DataFrame, n: int) -> DataFrame:
    """The last ``n`` bars of every symbol."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    return bars.withColumn("_back", back).where(F.col("_back") <= n).drop("_back")


def chart_domain(points: DataFrame, rate: float = 1.0, pad: float = 0.1) -> DataFrame:
    """Lowest and highest price per symbol with the axis padding."""
    p = F.col("close") * rate
    ends = points.where(F.col("close").isNotNull()).groupBy("symbol").agg(F.min(p).alias("lo"), F.max(p).alias("hi"))
    margin = (F.col("hi") - F.col("lo")) * pad
    return ends.select("symbol", "lo", "hi", (F.col("lo") - margin).alias("axis_min"), (F.col("hi") + margin).alias("axis_max"))


def top_features(importance: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest importances (top-k plan, no full sort)."""
    return importance.orderBy(F.desc("importance"), "feature").limit(n)
