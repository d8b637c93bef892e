"""Queries for the streaming operators, run over the event table as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwright.functions.numeric import r6
from tickwright.session import scratch_path
from tickwright.sources import tables as t
from tickwright.streaming import quotes as qs

from .registry import QUOTES, query
from .registry import r6 as q6


def drained(spark, stream, keys, mode="update"):
    log = scratch_path(spark, "log")
    qs.run_to_log(stream, log, scratch_path(spark, "stream"), mode)
    return qs.current(spark, log, keys, stream.schema)


def stream(spark, d):
    return qs.read_quote_stream(spark, d, "events.parquet")


@query(
    "stream_daily_bars",
    f"""WITH {QUOTES} SELECT symbol, CAST(ts AS DATE) AS date, {q6('arg_min(price, row(ts, quote_id))', 'open')}, {q6('max(price)', 'high')}, {q6('min(price)', 'low')},
 {q6('arg_max(price, row(ts, quote_id))', 'close')}, count(*) AS ticks FROM quotes GROUP BY 1, 2""",
)
def stream_daily_bars(spark, d):
    out = drained(spark, qs.daily_bars(stream(spark, d)), ["symbol", "date"])
    return out.select("symbol", "date", *[r6(c).alias(c) for c in ("open", "high", "low", "close")], "ticks")


@query(
    "stream_insert_once",
    f"""WITH {QUOTES}, b AS (SELECT *, quote_id % 2 AS part, CAST(ts AS DATE) AS day FROM quotes)
SELECT symbol, day, {q6('arg_min(price, row(part, ts, quote_id))', 'price')}, arg_min(quote_id, row(part, ts, quote_id)) AS quote_id FROM b GROUP BY 1, 2""",
)
def stream_insert_once(spark, d):
    """All events in two batches, even ids first; the first row of a day stays."""
    folder, log, state = (scratch_path(spark, name) for name in ("arrivals", "log", "stream"))
    events = t.table(spark, d, "events")
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).write.parquet(f"{folder}/{part}")
        qs.insert_once(qs.read_quote_stream(spark, f"{folder}/*"), log, state)
    return spark.read.parquet(log).select("symbol", "day", r6("price").alias("price"), "quote_id")


@query("stream_latest_price", f"WITH {QUOTES} SELECT symbol, {q6('arg_max(price, row(ts, quote_id))', 'price')}, max(row(ts, quote_id))[2] AS quote_id FROM quotes GROUP BY symbol")
def stream_latest_price(spark, d):
    out = drained(spark, qs.latest_price(stream(spark, d)), ["symbol"])
    return out.select("symbol", r6("price").alias("price"), "quote_id")


@query(
    "stream_stale_flag",
    f"""WITH {QUOTES}, l AS (SELECT symbol, max(ts) AS ts FROM quotes GROUP BY symbol), n AS (SELECT max(ts) AS now FROM quotes)
SELECT symbol, {q6('(epoch_us(now) - epoch_us(ts)) / 1e6', 'age_seconds')}, epoch_us(now) - epoch_us(ts) > 3600000000 AS stale FROM l, n""",
)
def stream_stale_flag(spark, d):
    latest = drained(spark, qs.latest_price(stream(spark, d)), ["symbol"])
    now = t.quotes(spark, d).agg(F.max("ts")).scalar()
    return qs.stale_flag(latest, now, 3600).select("symbol", r6("age_seconds").alias("age_seconds"), "stale")


@query(
    "stream_fx_convert",
    f"""WITH {QUOTES} SELECT quote_id, {q6('CASE WHEN symbol % 2 = 1 THEN price ELSE price * 83.5 END', 'price_inr')},
 {q6('CASE WHEN symbol % 2 = 1 THEN price / 82.0 ELSE price END', 'price_usd')}, CASE WHEN symbol % 2 = 1 THEN 82.0 ELSE 83.5 END::DOUBLE AS rate FROM quotes""",
)
def stream_fx_convert(spark, d):
    fx = t.table(spark, d, "supplier").select(
        F.when(F.col("s_nationkey") % 2 == 1, "INR").otherwise("USD").alias("currency"),
        F.when(F.col("s_nationkey") % 2 == 1, 82.0).otherwise(83.5).alias("rate"),
    ).distinct()
    q = stream(spark, d).withColumn("currency", F.when(F.col("symbol") % 2 == 1, "INR").otherwise("USD"))
    out = drained(spark, qs.fx_convert(q, fx), ["quote_id"], "append")
    return out.select("quote_id", r6("price_inr").alias("price_inr"), r6("price_usd").alias("price_usd"), "rate")


HALVES = f"""{QUOTES}, edge AS (SELECT max(ts) - INTERVAL 1 DAY AS horizon FROM quotes WHERE quote_id % 2 = 0),
kept AS (SELECT * FROM quotes, edge WHERE quote_id % 2 = 0 OR ts >= horizon), late AS (SELECT * FROM quotes, edge WHERE quote_id % 2 = 1 AND ts < horizon)"""


def split_halves(spark, d):
    """All events in two batches, even ids first: (partial bars, late quotes)."""
    folder, log, late, state = (scratch_path(spark, name) for name in ("arrivals", "log", "late", "stream"))
    events = t.table(spark, d, "events")
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).write.parquet(f"{folder}/{part}")
        qs.split_bars(qs.read_quote_stream(spark, f"{folder}/*"), log, late, state)
    return spark.read.parquet(log), spark.read.parquet(late)


@query(
    "stream_split_bars",
    f"""WITH {HALVES} SELECT symbol, CAST(ts AS DATE) AS date, {q6('arg_min(price, row(ts, quote_id))', 'open')}, {q6('max(price)', 'high')}, {q6('min(price)', 'low')},
 {q6('arg_max(price, row(ts, quote_id))', 'close')}, count(*) AS ticks FROM kept GROUP BY 1, 2""",
)
def stream_split_bars(spark, d):
    out = qs.bars_of(split_halves(spark, d)[0])
    return out.select("symbol", "date", *[r6(c).alias(c) for c in ("open", "high", "low", "close")], "ticks")


@query("stream_late_quotes", f"WITH {HALVES} SELECT symbol, CAST(ts AS DATE) AS date, count(*) AS late_quotes FROM late GROUP BY 1, 2")
def stream_late_quotes(spark, d):
    """Quotes of the second batch that came more than a day late: kept, and counted by day."""
    return qs.late_counts(split_halves(spark, d)[1])


@query(
    "stream_stale_events",
    f"""WITH {QUOTES}, l AS (SELECT symbol, max(row(epoch_us(ts) // 1000, quote_id)) AS q FROM quotes GROUP BY symbol), n AS (SELECT epoch_us(max(ts)) // 1000 - 60000 AS now FROM quotes)
SELECT symbol, q[1] AS ts, q[2] AS quote_id, q[1] + 3600000 < now AS stale FROM l, n""",
)
def stream_stale_events(spark, d):
    """The newest quote of each symbol, with the flag that its timer raised."""
    return drained(spark, qs.stale_events(stream(spark, d), 3600), ["symbol"]).select("symbol", "ts", "quote_id", "stale")
