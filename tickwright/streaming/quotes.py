"""Structured Streaming forms of the quote tables.

Keyed results leave in update mode as an append-only change log; ``current`` reads the newest
version of every key. A batch replayed after a failure overwrites its own part of the log, so
the tables are exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_quote_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Quotes arriving as Parquet files, oldest file first."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.parquet(folder)
    return raw.select(
        F.col("user_id").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        F.col("event_type").alias("source"),
        F.col("event_id").alias("quote_id"),
    )


def daily_bars(quotes: DataFrame, late: str = "1 day") -> DataFrame:
    """Open, high, low, close per symbol and day, as a stream with bounded state.

    Days that the watermark has passed are closed, and quotes that come later change nothing here;
    ``split_bars`` keeps and counts them.
    """
    order = F.struct("ts", "quote_id")
    bars = (
        quotes.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day"), "symbol")
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.count(F.lit(1)).alias("ticks"),
        )
    )
    return bars.select("symbol", F.to_date("window.start").alias("date"), "open", "high", "low", "close", "ticks")


PARTIAL = "symbol {0}, date date, first struct<ts: timestamp, quote_id: bigint, price: double>, last struct<ts: timestamp, quote_id: bigint, price: double>, high double, low double, ticks bigint"


def split_bars(quotes: DataFrame, log: str, late_log: str, checkpoint: str, late_seconds: int = 86_400) -> None:
    """Drains the input into partial day bars under ``log`` and late quotes under ``late_log``.

    A quote is late if it is older than the newest quote of all earlier batches by more than
    ``late_seconds``; equal ages are in time. Late quotes are stored whole, none is dropped. Both
    tables have one folder a batch; a replayed batch looks at earlier batches only and overwrites its
    own rows. ``bars_of`` merges the partial bars, ``late_counts`` counts what came late.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = PARTIAL.format(batch.schema["symbol"].dataType.simpleString()) + ", batch bigint"
        newest = None
        if batch_id > 0:
            newest = spark.read.schema(schema).parquet(log).where(F.col("batch") < batch_id).agg(F.max("last.ts")).first()[0]
        late = F.lit(False) if newest is None else F.unix_micros("ts") < F.unix_micros(F.lit(newest)) - late_seconds * 1_000_000
        quote = F.struct("ts", "quote_id", "price")
        rows = batch.where(~late).groupBy("symbol", F.to_date("ts").alias("date")).agg(
            F.min(quote).alias("first"), F.max(quote).alias("last"), F.max("price").alias("high"), F.min("price").alias("low"), F.count(F.lit(1)).alias("ticks")
        )
        rows.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        batch.where(late).write.mode("overwrite").parquet(f"{late_log}/batch={batch_id}")

    query = quotes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


def bars_of(partial: DataFrame) -> DataFrame:
    """Day bars from the partial bars of all batches."""
    merged = partial.groupBy("symbol", "date").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("ticks").alias("ticks")
    )
    return merged.select("symbol", "date", F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "ticks")


def late_counts(late: DataFrame) -> DataFrame:
    """Late quotes per symbol and day of the quote."""
    return late.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("late_quotes"))


def stale_events(quotes: DataFrame, ttl_seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """(symbol, ts, price, quote_id, stale): the newest quote of a symbol whenever it changes, and the
    same quote again as stale once event time has passed its time to live.

    One state a symbol holds its newest quote; a timer on event time (the watermark, ``late`` behind
    the newest quote of all symbols) raises the flag without any further quote of that symbol. An
    older quote changes nothing. Update mode; ``ts`` is in milliseconds since 1970.
    """
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = quotes.schema["symbol"].dataType.simpleString()
    names = ["symbol", "ts", "price", "quote_id", "stale"]

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            ts, price, quote = state.get
            state.update((ts, price, quote))  # stays, without a timer
            yield pd.DataFrame([(*key, ts, price, quote, True)], columns=names)
            return
        held = state.get if state.exists else None
        newest = held
        for frame in frames:
            for own in zip(frame["ms"].tolist(), frame["price"].tolist(), frame["quote_id"].tolist()):
                if newest is None or (own[0], own[2]) > (newest[0], newest[2]):
                    newest = own
        state.update(newest)
        due = int(newest[0]) + ttl_seconds * 1000
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)
        if newest != held:
            yield pd.DataFrame([(*key, *newest, due < state.getCurrentWatermarkMs())], columns=names)

    rows = quotes.withWatermark("ts", late).select("symbol", "ts", F.unix_millis("ts").alias("ms"), "price", "quote_id")
    return rows.groupBy("symbol").applyInPandasWithState(
        follow, f"symbol {kind}, ts bigint, price double, quote_id bigint, stale boolean", "ts bigint, price double, quote_id bigint", "update", GroupStateTimeout.EventTimeTimeout
    )


def insert_once(quotes: DataFrame, log: str, checkpoint: str) -> None:
    """One stored row per symbol and day: the first of the first batch that has one.

    What is stored decides, not a state with a time limit, so a quote of any lateness is either
    the day's first or ignored. A replayed batch compares itself with earlier batches only and
    overwrites its own rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = F.min_by(F.struct("price", "quote_id"), F.struct("ts", "quote_id")).alias("q")
        rows = batch.groupBy("symbol", F.to_date("ts").alias("day")).agg(first).select("symbol", "day", "q.*")
        if batch_id > 0:
            schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())])
            before = spark.read.schema(schema).parquet(log).where(F.col("batch") < batch_id)
            rows = rows.join(before.select("symbol", "day"), ["symbol", "day"], "left_anti")
        rows.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    query = quotes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_price(quotes: DataFrame) -> DataFrame:
    """Newest quote per symbol."""
    newest = F.max(F.struct("ts", "quote_id", "price", "source")).alias("q")
    return quotes.groupBy("symbol").agg(newest).select("symbol", "q.*")


def stale_flag(table: DataFrame, now, ttl_seconds: int = 60) -> DataFrame:
    """Age of each stored quote at ``now`` and whether it outlived its time to live."""
    at = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    age = F.unix_micros(at) - F.unix_micros("ts")
    return table.withColumns({"age_seconds": age / F.lit(1e6), "stale": age > F.lit(ttl_seconds * 1_000_000)})


def fx_convert(quotes: DataFrame, fx: DataFrame) -> DataFrame:
    """Stream-static join: both currencies and the rate on every quote."""
    inr = F.col("currency") == "INR"
    return quotes.join(fx, "currency", "left").select(
        *[F.col(c) for c in quotes.columns],
        "rate",
        F.when(inr, F.col("price")).otherwise(F.col("price") * F.col("rate")).alias("price_inr"),
        F.when(inr, F.col("price") / F.col("rate")).otherwise(F.col("price")).alias("price_usd"),
    )


def run_to_log(stream: DataFrame, log: str, checkpoint: str, mode: str = "update") -> None:
    """Drains the available input; every batch writes its rows under its own batch folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def current(spark: SparkSession, log: str, keys: list[str], schema: T.StructType) -> DataFrame:
    """The newest version of every key in a change log."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(log)
    rest = [f.name for f in schema.fields if f.name not in keys]
    newest = rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_r"))
    return newest.select(*keys, *[f"_r.{c}" for c in rest])


