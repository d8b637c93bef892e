"""Queries for the quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwright.functions.numeric import r6
from tickwright.operators import quality as dq
from tickwright.schema import HORIZON_DAYS
from tickwright.sources import tables as t

from .p01_files import BAR_SQL, HZ, bar_out
from .registry import BARS_S, div, lag, query
from .registry import r6 as q6


def defects(spark, d):
    """The supplier bars with planted defects: lost rows, NULLs, a jump, a bad price."""
    b = t.bars_supplier(spark, d)
    s, day = F.col("symbol"), F.col("date")
    b = b.where(~((s % 10 == 1) & (day >= F.lit("1997-01-01").cast("date"))))
    month = F.date_format(day, "yyyy-MM")
    close = (
        F.when((s % 10 == 2) & (month == "1998-03"), F.lit(None))
        .when((s % 10 == 3) & (month == "1998-04"), F.col("close") * 10.0)
        .when((s % 10 == 4) & (month == "1998-05"), F.lit(0.001))
        .when((s % 10 == 5) & (month == "1998-06"), F.lit(100001.0))
        .otherwise(F.col("close"))
    )
    return b.withColumn("close", close)


DEF = f"""{BARS_S}, bad AS (SELECT symbol, date, open, high, low, CASE
  WHEN symbol % 10 = 2 AND strftime(date, '%Y-%m') = '1998-03' THEN NULL
  WHEN symbol % 10 = 3 AND strftime(date, '%Y-%m') = '1998-04' THEN close * 10.0
  WHEN symbol % 10 = 4 AND strftime(date, '%Y-%m') = '1998-05' THEN 0.001
  WHEN symbol % 10 = 5 AND strftime(date, '%Y-%m') = '1998-06' THEN 100001.0 ELSE close END AS close, volume
  FROM bars WHERE NOT (symbol % 10 = 1 AND date >= DATE '1997-01-01')),
mv AS (SELECT *, abs({div('close', lag('close'))} - 1.0) AS mv, date_diff('day', {lag('date')}, date) AS gap FROM bad),
facts AS (SELECT symbol, count(*) AS n, count(*) FILTER (close IS NULL) AS nulls, min(close) AS lo, max(close) AS hi, max(mv) AS mm,
  max(gap) AS gg, count(*) FILTER (high = low) AS flat FROM mv GROUP BY symbol),
verdict AS (SELECT *, n >= 252 AND nulls = 0 AND lo >= 0.01 AND hi <= 100000 AND NOT coalesce(mm > 5.0, false) AS ok FROM facts)"""


def rule(name, expr, sql):
    query(name, f"WITH {DEF} SELECT symbol, {sql} FROM facts")(
        lambda spark, d: dq.quality_facts(defects(spark, d)).select("symbol", *expr())
    )


rule("dq_min_rows", lambda: [F.col("row_count"), dq.dq_min_rows().alias("passed")], "n AS row_count, n >= 252 AS passed")
rule("dq_no_nulls", lambda: [F.col("null_close"), dq.dq_no_nulls().alias("passed")], "nulls AS null_close, nulls = 0 AS passed")
rule("dq_price_range", lambda: [r6("min_close").alias("lo"), r6("max_close").alias("hi"), dq.dq_price_range().alias("passed")],
     f"{q6('lo', 'lo')}, {q6('hi', 'hi')}, lo >= 0.01 AND hi <= 100000 AS passed")
rule("dq_max_move", lambda: [r6("max_move").alias("max_move"), dq.dq_max_move().alias("passed")],
     f"{q6('mm', 'max_move')}, NOT coalesce(mm > 5.0, false) AS passed")
rule("dq_date_gaps", lambda: [F.col("max_gap").cast("bigint").alias("max_gap"), dq.dq_date_gaps().alias("warning")], "gg AS max_gap, gg > 7 AS warning")


@query("validate_quality", f"WITH {DEF} SELECT {BAR_SQL} FROM bad WHERE symbol IN (SELECT symbol FROM verdict WHERE ok)")
def validate_quality(spark, d):
    return bar_out(dq.validate_quality(defects(spark, d)))


@query("quality_report", f"WITH {DEF} SELECT symbol, n AS row_count, flat AS flat_bars, gg > 7 AS gap_warning, ok AS passed FROM verdict")
def quality_report(spark, d):
    return dq.quality_report(defects(spark, d)).select("symbol", "row_count", "flat_bars", "gap_warning", "passed")


def forecast_rows(spark, d):
    """Order totals as forecasts, some of them invalid."""
    o = t.table(spark, d, "orders")
    k = F.col("o_orderkey")
    h = F.element_at(F.array(*map(F.lit, HORIZON_DAYS)), (k % 5 + 1).cast("int"))
    return o.select(
        F.col("o_custkey").alias("symbol"),
        k.alias("id"),
        F.when(k % 211 == 0, "9Z").otherwise(h).alias("horizon"),
        F.when(k % 199 == 0, F.lit(None)).when(k % 197 == 0, F.lit(-1.0)).otherwise(F.col("o_totalprice")).alias("predicted_price"),
        F.when(k % 193 == 0, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice") * 0.9).alias("confidence_low"),
        (F.col("o_totalprice") * 1.1).alias("confidence_high"),
    )


FROWS = """fr AS (SELECT o_custkey AS symbol, o_orderkey AS id, CASE WHEN o_orderkey % 211 = 0 THEN '9Z' ELSE (['1D','1W','1M','1Y','5Y'])[o_orderkey % 5 + 1] END AS horizon,
 CASE WHEN o_orderkey % 199 = 0 THEN NULL WHEN o_orderkey % 197 = 0 THEN -1.0 ELSE o_totalprice END AS predicted_price,
 CASE WHEN o_orderkey % 193 = 0 THEN o_totalprice * 2 ELSE o_totalprice * 0.9 END AS lo, o_totalprice * 1.1 AS hi FROM orders)"""


@query(
    "validate_predictions",
    f"""WITH {FROWS}, ok AS (SELECT symbol FROM fr GROUP BY symbol HAVING bool_and(coalesce(predicted_price > 0 AND horizon <> '9Z' AND NOT lo > hi, false)))
SELECT symbol, id, horizon, {q6('predicted_price', 'predicted_price')} FROM fr WHERE symbol IN (SELECT symbol FROM ok)""",
)
def validate_predictions(spark, d):
    return dq.validate_predictions(forecast_rows(spark, d)).select("symbol", "id", "horizon", r6("predicted_price").alias("predicted_price"))


@query(
    "validate_weights",
    f"""WITH s AS (SELECT l_orderkey, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) * CASE WHEN l_orderkey % 3 = 0 THEN 1.05 ELSE 1.0 END AS weight FROM lineitem)
SELECT l_orderkey, {q6('sum(weight)', 'total')}, abs(sum(weight) - 1.0) <= 0.01 AS valid FROM s GROUP BY l_orderkey""",
)
def validate_weights(spark, d):
    line = t.table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    totals = line.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("all"))
    off = F.when(F.col("l_orderkey") % 3 == 0, 1.05).otherwise(1.0)
    w = line.join(totals, "l_orderkey").select("l_orderkey", (F.col("l_quantity") / F.col("all") * off).alias("weight"))
    return dq.validate_weights(w, ["l_orderkey"]).withColumn("total", r6("total"))


@query("job_outcome", f"WITH {DEF} SELECT count(*) AS total, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failed, {q6('100.0 * count(*) FILTER (ok) / count(*)', 'success_rate')} FROM verdict")
def job_outcome(spark, d):
    r = dq.quality_report(defects(spark, d)).select("symbol", F.col("passed").alias("ok"))
    return dq.job_outcome(r).withColumn("success_rate", r6("success_rate"))


@query("job_failures", f"WITH {DEF} SELECT symbol FROM verdict WHERE NOT ok")
def job_failures(spark, d):
    return dq.job_failures(dq.quality_report(defects(spark, d)).select("symbol", F.col("passed").alias("ok")))
