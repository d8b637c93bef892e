"""Exact row positions and running totals over a whole table without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwright.session import materialize

FAN = 32
HASH_BUCKETS = 4096


def _numeric_bucket(df: DataFrame) -> DataFrame:
    """Adds ``_bk``: bucket of ``_o`` by percentile cut points, in two steps of ``FAN`` comparisons."""
    n = FAN * FAN
    shares = [i / n for i in range(1, n)]
    cuts = df.agg(F.percentile_approx("_o", shares, 10000).alias("c")).scalar()
    steps = F.array(*[F.lit(i) for i in range(FAN, n, FAN)])
    o = F.col("_o")
    coarse = F.size(F.filter(F.transform(steps, lambda i: F.get("_cuts", i - 1)), lambda c: c < o))
    fine = F.size(F.filter(F.slice("_cuts", F.col("_coarse") * FAN + 1, FAN), lambda c: c < o))
    return (
        df.withColumn("_cuts", cuts)
        .withColumn("_coarse", coarse)
        .withColumn("_bk", F.coalesce(F.col("_coarse") * FAN + fine, F.lit(0)))
        .drop("_cuts", "_coarse")
    )


def with_running_totals(
    df: DataFrame, order: Column, tie: list[str], sums: dict[str, Column], hashed: bool = False
) -> DataFrame:
    """Adds running sums (inclusive) by ``order`` then ``tie``, and ``_next``, the next order value.

    The order is split into buckets: by leading bits when it is a hash, else by approximate
    percentiles. Exact bucket sums give each bucket its offset, and sums run inside their
    bucket, so the result is exact however the buckets fall. ``order`` and ``tie`` must
    identify rows; the bucket table has at most 4096 rows, hence the broadcast.
    """
    placed = df.withColumns({"_o": order, **{f"_v_{k}": v for k, v in sums.items()}})
    if hashed:
        bucketed = placed.withColumn("_bk", (F.shiftright("_o", 52) + HASH_BUCKETS // 2).cast("int"))
    else:
        bucketed = _numeric_bucket(placed)
    totals = bucketed.groupBy("_bk").agg(F.min("_o").alias("_lo"), *[F.sum(f"_v_{k}").alias(f"_c_{k}") for k in sums])
    by_bucket = Window.orderBy("_bk")
    before = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_bk",
        F.lead("_lo").over(by_bucket).alias("_after"),
        *[F.coalesce(F.sum(f"_c_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in sums],
    )
    inside = Window.partitionBy("_bk").orderBy("_o", *tie)
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = bucketed.withColumns(
        {**{f"_r_{k}": F.sum(f"_v_{k}").over(run) for k in sums}, "_lead": F.lead("_o").over(inside)}
    )
    joined = local.join(F.broadcast(offsets), "_bk")
    return joined.select(
        *df.columns,
        F.coalesce("_lead", "_after").alias("_next"),
        *[(F.col(f"_r_{k}") + F.col(f"_off_{k}")).alias(k) for k in sums],
    )


def with_global_rank(
    df: DataFrame, order: Column, tie: list[str], hashed: bool = False
) -> tuple[DataFrame, Column]:
    """Adds ``_rank`` (1-based position by ``order`` then ``tie``) and returns the row count."""
    ranked = with_running_totals(df, order, tie, {"_rank": F.lit(1)}, hashed).drop("_next")
    return ranked, df.agg(F.count(F.lit(1))).scalar()


def exact_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """(_c, _m): exact median of the values of each column that has any, by the column's place.

    Values are counted by (column, value) and ranged by both, so a task holds a range of distinct
    values. Exact sums of each column and range say which ranges hold the middle positions, and
    only their rows are put in order. Ranges are no more than tasks, hence the broadcast.
    """
    values = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols)])
    values = df.select(F.explode(values).alias("_x")).select("_x.*").where(F.col("_v").isNotNull())
    counts = values.groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranged = materialize(counts.repartitionByRange("_c", "_v").withColumn("_bk", F.spark_partition_id()), "ranged-values")
    own = Window.partitionBy("_c")
    sums = ranged.groupBy("_c", "_bk").agg(F.sum("_n").alias("_n"))
    sums = sums.withColumns({"_upto": F.sum("_n").over(own.orderBy("_bk")), "_all": F.sum("_n").over(own)})
    lower, upper = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    sums = sums.select("_c", "_bk", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", lower.alias("_lower"), upper.alias("_upper"))
    middle = F.broadcast(sums.where((F.col("_before") < F.col("_upper")) & (F.col("_upto") >= F.col("_lower"))).drop("_upto"))
    run = F.col("_before") + F.sum("_n").over(Window.partitionBy("_c", "_bk").orderBy("_v"))
    rows = ranged.join(middle, ["_c", "_bk"]).withColumn("_run", run)
    held = [F.max(F.when((F.col("_run") >= at) & (F.col("_run") - F.col("_n") < at), F.col("_v"))) for at in (F.col("_lower"), F.col("_upper"))]
    return rows.groupBy("_c").agg((held[0] * 0.5 + held[1] * 0.5).alias("_m"))
