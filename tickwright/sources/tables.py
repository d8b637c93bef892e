"""Bars, dimensions and quotes derived from the order, part, supplier and event tables.

Price of a trade is the part's retail price after the line's discount, in whole cents. The
trades of a day are ordered by (order, line, price), packed into one decimal, so the per-day
aggregate keeps a few numbers per group and runs as a hash aggregate. It combines on the map
side: a supplier with a third of all lines still sends one row per day and task into the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_suppkey").alias("supplier"),
        F.to_date("l_shipdate").alias("day"),
        F.floor(F.col("p_retailprice") * (F.lit(1.0) - F.col("l_discount")) * F.lit(100.0) + F.lit(0.5003)).alias("cents"),
        "l_quantity",
        "l_orderkey",
        "l_linenumber",
    )


def to_bars(ticks: DataFrame) -> DataFrame:
    """Open, high, low, close and volume per (symbol, date).

    A trade's place in its day is (order, line, price), packed into one decimal so that the
    aggregate keeps fixed-width numbers only; prices themselves are never packed.
    """
    place = (
        F.col("l_orderkey").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")
        + F.col("l_linenumber").cast("decimal(19,0)") * F.lit(10**12).cast("decimal(13,0)")
        + F.col("cents").cast("decimal(19,0)")
    ).cast("decimal(38,0)")
    bars = (
        ticks.withColumn("_k", place)
        .groupBy("symbol", "date")
        .agg(
            F.min_by("cents", "_k").alias("_first"),
            F.max("cents").alias("_hi"),
            F.min("cents").alias("_lo"),
            F.max_by("cents", "_k").alias("_last"),
            F.sum("l_quantity").alias("volume"),
        )
    )
    dollars = F.lit(100.0)
    return bars.select(
        "symbol",
        "date",
        (F.col("_first") / dollars).alias("open"),
        (F.col("_hi") / dollars).alias("high"),
        (F.col("_lo") / dollars).alias("low"),
        (F.col("_last") / dollars).alias("close"),
        "volume",
    )


def bars_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    return to_bars(t.withColumnRenamed("supplier", "symbol").withColumnRenamed("day", "date"))


def bars_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of four days per supplier nation (buckets aligned to the epoch)."""
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    t = trades(spark, sf_dir)
    bucket = F.floor(F.unix_date("day") / F.lit(4)).cast("int") * F.lit(4)
    ticks = t.join(sup, t.supplier == sup.s_suppkey).select(
        F.col("s_nationkey").cast("bigint").alias("symbol"),
        F.date_from_unix_date(bucket).alias("date"),
        "cents",
        "l_quantity",
        "l_orderkey",
        "l_linenumber",
    )
    return to_bars(ticks)


def category_of(key: Column) -> Column:
    return F.when(key % 2 == 0, F.lit("us_stocks")).otherwise(F.lit("ind_stocks"))


def supplier_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("symbol"), category_of(F.col("s_nationkey")).alias("category")
    )


def dim_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol index: one row per supplier, all text."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    cat = category_of(F.col("s_nationkey"))
    us = F.col("s_nationkey") % 2 == 0
    return joined.select(
        F.concat(F.lit("Sym"), F.col("s_suppkey").cast("string")).alias("symbol"),
        F.col("s_name").alias("company_name"),
        F.col("r_name").alias("sector"),
        F.format_string("%.2f", F.col("s_acctbal")).alias("market_cap"),
        F.col("n_name").alias("headquarters"),
        F.when(us, F.lit("NASDAQ")).otherwise(F.lit("NSE")).alias("exchange"),
        F.when(us, F.lit("USD")).otherwise(F.lit("INR")).alias("currency"),
        F.when(
            (~us) & (F.col("s_suppkey") % 3 != 0),
            F.concat(F.lit("INE"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")),
        )
        .otherwise(F.lit(""))
        .alias("isin"),
        cat.alias("category"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes from the event table: symbol = user, price = value."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        F.col("event_type").alias("source"),
        F.col("event_id").alias("quote_id"),
    )
