"""Queries for file sources, tier merging, upserts and the prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwright.functions import scalar as sc
from tickwright.functions.numeric import r6
from tickwright.operators import tiers
from tickwright.session import scratch_path
from tickwright.sources import bars as bar_files
from tickwright.sources import predictions as pred
from tickwright.sources import reference_data as refs
from tickwright.sources import tables as t

from .registry import BARS_N, BARS_S, CATS, DIM, QUOTES, query
from .registry import r6 as q6

CUT, OVERLAP = "1999-12-31", "1999-12-20"
OHLC = ("open", "high", "low", "close")


def past(spark, d):
    b = t.bars_supplier(spark, d)
    return b.where((F.col("symbol") % 5 != 0) & (F.col("date") <= F.lit(CUT).cast("date")))


def permanent(spark, d):
    return t.bars_supplier(spark, d).where(F.col("date") <= F.lit(CUT).cast("date"))


def latest(spark, d):
    b = t.bars_supplier(spark, d)
    b = b.where((F.col("symbol") % 7 != 0) & (F.col("date") >= F.lit(OVERLAP).cast("date")))
    return b.withColumn("close", F.col("close") * 1.01)


TIERS = f"""{BARS_S},
past AS (SELECT * FROM bars WHERE symbol % 5 <> 0 AND date <= DATE '{CUT}'),
permanent AS (SELECT * FROM bars WHERE date <= DATE '{CUT}'),
latest AS (SELECT symbol, date, open, high, low, close * 1.01 AS close, volume FROM bars
           WHERE symbol % 7 <> 0 AND date >= DATE '{OVERLAP}')"""


def bar_out(df, *extra):
    return df.select("symbol", "date", *[r6(c).alias(c) for c in OHLC], r6("volume").alias("volume"), *extra)


BAR_SQL = ", ".join(["symbol", "date", *[q6(c, c) for c in OHLC], q6("volume", "volume")])


def exported(spark, d):
    """Derived bars written as a CSV tree (tier and category folders), returned as its path."""
    b = past(spark, d).withColumn("tier", F.lit("past"))
    b = b.unionByName(latest(spark, d).withColumn("tier", F.lit("latest")))
    b = b.join(t.supplier_category(spark, d), "symbol")
    path = scratch_path(spark, "bars")
    b = b.withColumn("symbol", F.col("symbol").cast("string"))
    bar_files.write_bars(b.withColumnsRenamed({"open": "Open", "close": "Close", "date": "Date"}), path)
    return path


@query(
    "read_bars",
    f"""WITH {TIERS}, {CATS}, u AS (SELECT *, 'past' AS tier FROM past UNION ALL SELECT *, 'latest' AS tier FROM latest)
SELECT CAST(symbol AS VARCHAR) AS symbol, date, {", ".join([q6(c, c) for c in OHLC])}, {q6('volume', 'volume')}, category, tier,
 'historical' AS data_source FROM u JOIN cats USING (symbol)""",
)
def read_bars(spark, d):
    return bar_out(bar_files.read_bars(spark, exported(spark, d)), "category", "tier", "data_source")


@query(
    "read_latest_bars",
    f"""WITH {TIERS}, {CATS} SELECT CAST(symbol AS VARCHAR) AS symbol, date, {", ".join([q6(c, c) for c in OHLC])},
 {q6('volume', 'volume')}, category, 'latest' AS tier, 'latest' AS data_source FROM latest JOIN cats USING (symbol)""",
)
def read_latest_bars(spark, d):
    return bar_out(bar_files.read_latest_bars(spark, exported(spark, d)), "category", "tier", "data_source")


@query(
    "resolve_tier",
    f"""WITH {TIERS} SELECT {BAR_SQL}, 'past' AS tier FROM past
UNION ALL SELECT {BAR_SQL}, 'permanent' AS tier FROM permanent WHERE symbol NOT IN (SELECT symbol FROM past)""",
)
def resolve_tier(spark, d):
    b = past(spark, d).withColumn("tier", F.lit("past"))
    b = b.unionByName(permanent(spark, d).withColumn("tier", F.lit("permanent")))
    return bar_out(tiers.resolve_tier(b), "tier")


@query(
    "resolve_history",
    f"""WITH {TIERS} SELECT {BAR_SQL} FROM past UNION ALL SELECT {BAR_SQL} FROM latest
UNION ALL SELECT {BAR_SQL} FROM permanent WHERE symbol NOT IN (SELECT symbol FROM past UNION SELECT symbol FROM latest)""",
)
def resolve_history(spark, d):
    return bar_out(tiers.resolve_history(past(spark, d), latest(spark, d), permanent(spark, d)))


@query(
    "combine_keep_last",
    f"""WITH {TIERS} SELECT {BAR_SQL} FROM latest UNION ALL
SELECT {BAR_SQL} FROM past p WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.symbol = p.symbol AND l.date = p.date)""",
)
def combine_keep_last(spark, d):
    return bar_out(tiers.combine_keep_last(past(spark, d), latest(spark, d)))


KEEP_FIRST_SQL = f"""WITH {TIERS} SELECT {BAR_SQL} FROM past UNION ALL
SELECT {BAR_SQL} FROM latest l WHERE NOT EXISTS (SELECT 1 FROM past p WHERE l.symbol = p.symbol AND l.date = p.date)"""


@query("combine_keep_first", KEEP_FIRST_SQL)
def combine_keep_first(spark, d):
    return bar_out(tiers.combine_keep_first(past(spark, d), latest(spark, d)))


def last_quotes(spark, d):
    """One quote per symbol and its category's currency (users stand in for symbols)."""
    q = t.quotes(spark, d)
    last = q.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "quote_id")).alias("price"), F.max("ts").alias("ts"))
    return last.select(
        "symbol",
        F.to_date("ts").alias("date"),
        "price",
        F.when(F.col("symbol") % 2 == 0, "USD").otherwise("INR").alias("currency"),
        F.when(F.col("symbol") % 3 == 0, F.col("price") * 0.9).alias("open"),
        F.lit(None).cast("double").alias("high"),
        F.lit(None).cast("double").alias("low"),
    )


LASTQ = f"""{QUOTES}, lastq AS (
  SELECT symbol, CAST(max(ts) AS DATE) AS date, arg_max(price, row(ts, quote_id)) AS price,
    CASE WHEN symbol % 2 = 0 THEN 'USD' ELSE 'INR' END AS currency FROM quotes GROUP BY symbol)"""
RATE = "CASE WHEN currency = 'INR' THEN 83.5 ELSE 1.0 END"


@query(
    "append_live_bar",
    f"""WITH {TIERS}, {LASTQ}, live AS (
 SELECT symbol, date, CASE WHEN symbol % 3 = 0 THEN price * 0.9 ELSE price END / ({RATE}) AS open,
  price / ({RATE}) AS high, price / ({RATE}) AS low, price / ({RATE}) AS close, NULL::DOUBLE AS volume FROM lastq)
SELECT {BAR_SQL}, 'historical' AS data_source FROM past UNION ALL SELECT {BAR_SQL}, 'live' AS data_source FROM live""",
)
def append_live_bar(spark, d):
    b = past(spark, d).withColumn("data_source", F.lit("historical"))
    return bar_out(tiers.append_live_bar(b, last_quotes(spark, d)), "data_source")


TODAYQ = """tq AS (SELECT symbol, CASE WHEN symbol % 2 = 0 THEN d1 ELSE DATE '2030-01-01' END AS date, price
 FROM (SELECT l.symbol, l.price, b.d1 FROM lastq l JOIN (SELECT symbol, max(date) AS d1 FROM bars GROUP BY symbol) b USING (symbol)))"""


def today_quotes(spark, d):
    """Quotes dated on the symbol's last bar day (even symbols) or on a new day."""
    ends = t.bars_supplier(spark, d).groupBy("symbol").agg(F.max("date").alias("d1"))
    q = last_quotes(spark, d).select("symbol", "price").join(ends, "symbol")
    day = F.when(F.col("symbol") % 2 == 0, F.col("d1")).otherwise(F.lit("2030-01-01").cast("date"))
    return q.select("symbol", day.alias("date"), "price")


@query(
    "append_today_if_missing",
    f"""WITH {BARS_S}, {LASTQ}, {TODAYQ}, nq AS (
 SELECT symbol, date, price AS open, price AS high, price AS low, price AS close, 0.0 AS volume FROM tq
 WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = tq.symbol AND b.date = tq.date))
SELECT {BAR_SQL} FROM bars UNION ALL SELECT {BAR_SQL} FROM nq""",
)
def append_today_if_missing(spark, d):
    return bar_out(tiers.append_today_if_missing(t.bars_supplier(spark, d), today_quotes(spark, d)))


FIRSTQ = f"""{QUOTES}, firstq AS (SELECT symbol, CAST(ts AS DATE) AS date, arg_min(price, row(ts, quote_id)) AS price
 FROM quotes GROUP BY 1, 2)"""


@query(
    "insert_daily_bar_if_absent",
    f"""WITH {FIRSTQ}, stored AS (SELECT symbol, date, price AS open, price AS high, price AS low, price * 2 AS close, 5.0 AS volume
  FROM firstq WHERE symbol % 3 = 0), fresh AS (
 SELECT symbol, date, price AS open, price AS high, price AS low, price AS close, 0.0 AS volume FROM firstq f
 WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.symbol = f.symbol AND s.date = f.date))
SELECT {BAR_SQL} FROM stored UNION ALL SELECT {BAR_SQL} FROM fresh""",
)
def insert_daily_bar_if_absent(spark, d):
    q = t.quotes(spark, d)
    stored = tiers.daily_bars_from_quotes(q.where(F.col("symbol") % 3 == 0)).select(
        "symbol", "date", "open", "high", "low", (F.col("close") * 2).alias("close"), F.lit(5.0).alias("volume")
    )
    return bar_out(tiers.insert_daily_bar_if_absent(stored, q))


@query(
    "upsert_latest_quote",
    f"""WITH {QUOTES}, old AS (SELECT symbol, arg_max(row(price, source, quote_id), row(ts, quote_id)) AS q FROM quotes
  WHERE ts < TIMESTAMP '2024-01-16' GROUP BY symbol),
new AS (SELECT symbol, arg_max(row(price, source, quote_id), row(ts, quote_id)) AS q FROM quotes
  WHERE ts >= TIMESTAMP '2024-01-16' AND event_type_ok GROUP BY symbol)
SELECT symbol, {q6('q[1]', 'price')}, q[2] AS source, q[3] AS quote_id FROM new
UNION ALL SELECT symbol, {q6('q[1]', 'price')}, q[2] AS source, q[3] AS quote_id FROM old
WHERE symbol NOT IN (SELECT symbol FROM new)""".replace("event_type_ok", "source = 'purchase'"),
)
def upsert_latest_quote(spark, d):
    q = t.quotes(spark, d)
    cut = F.lit("2024-01-16").cast("timestamp")
    order = F.struct("ts", "quote_id")
    stored = tiers.pick_per_key(q.where(F.col("ts") < cut), ["symbol"], order, "last")
    fresh = q.where((F.col("ts") >= cut) & (F.col("source") == "purchase"))
    out = tiers.upsert_latest_quote(stored, fresh)
    return out.select("symbol", r6("price").alias("price"), "source", "quote_id")


DATE_TEXT_SQL = BAR_SQL.replace("symbol, date,", "symbol, strftime(date, '%Y-%m-%d') AS date,")


@query(
    "merge_fetched_bars",
    f"""WITH {TIERS} SELECT {DATE_TEXT_SQL} FROM past UNION ALL
SELECT {DATE_TEXT_SQL} FROM latest l WHERE NOT EXISTS (SELECT 1 FROM past p WHERE l.symbol = p.symbol AND l.date = p.date)""",
)
def merge_fetched_bars(spark, d):
    return bar_out(tiers.merge_fetched_bars(past(spark, d), latest(spark, d)))


# ---- prediction table ---------------------------------------------------------------------


def sample_predictions(spark, d):
    """A forecast frame: last close per nation symbol, raised by 0.01 % a day."""
    last = t.bars_nation(spark, d).groupBy("symbol").agg(F.max_by("close", "date").alias("c"), F.max("date").alias("d0"))
    rows = last.select("*", F.inline(sc.horizons()))
    return rows.select(
        "symbol",
        t.category_of(F.col("symbol")).alias("category"),
        F.date_add("d0", F.col("days")).alias("date"),
        "horizon",
        (F.col("c") * (F.lit(1.0) + F.col("days") / F.lit(10000.0))).alias("predicted_price"),
        F.col("c").alias("current_price"),
    )


HZ = "hz AS (SELECT * FROM (VALUES ('1D', 1), ('1W', 7), ('1M', 30), ('1Y', 365), ('5Y', 1825)) AS h(horizon, days))"
SAMPLE = f"""{BARS_N}, {HZ}, lastc AS (SELECT symbol, arg_max(close, date) AS c, max(date) AS d0 FROM bars GROUP BY symbol),
sp AS (SELECT symbol, CASE WHEN symbol % 2 = 0 THEN 'us_stocks' ELSE 'ind_stocks' END AS category, d0 + days AS date, horizon,
  c * (1.0 + days / 10000.0) AS predicted_price, c AS current_price, days FROM lastc, hz)"""
PRED_DEFAULTS = """0.0::DOUBLE AS confidence, 0.0::DOUBLE AS confidence_low, 0.0::DOUBLE AS confidence_high, '' AS algorithm_used,
 'USD' AS currency, NULL::TIMESTAMP AS last_updated, 0.0::DOUBLE AS model_accuracy, 0::BIGINT AS data_points_used"""
PRED_SQL = f"symbol, category, date, horizon, {q6('predicted_price', 'predicted_price')}, {q6('current_price', 'current_price')}, {PRED_DEFAULTS}"


def pred_out(df):
    return df.withColumns({c: r6(c) for c in ("predicted_price", "current_price")})


def stored_predictions(spark, d):
    path = scratch_path(spark, "predictions")
    pred.write_predictions(sample_predictions(spark, d), path)
    return path


@query("write_predictions", f"WITH {SAMPLE} SELECT {PRED_SQL} FROM (SELECT * REPLACE (CASE WHEN symbol % 3 = 0 THEN predicted_price * 2 ELSE predicted_price END AS predicted_price) FROM sp)")
def write_predictions(spark, d):
    """Every third symbol is written again; the others stay as they were."""
    path = stored_predictions(spark, d)
    again = sample_predictions(spark, d).where(F.col("symbol") % 3 == 0)
    pred.write_predictions(again.withColumn("predicted_price", F.col("predicted_price") * 2), path)
    return pred_out(pred.read_predictions(spark, path))


@query("read_predictions", f"WITH {SAMPLE} SELECT {PRED_SQL} FROM sp WHERE symbol = 4 AND category = 'us_stocks'")
def read_predictions(spark, d):
    return pred_out(pred.read_predictions(spark, stored_predictions(spark, d), 4, "us_stocks"))


@query(
    "replace_predictions_by_horizon",
    f"""WITH {SAMPLE}, new AS (SELECT * REPLACE (predicted_price * 2 AS predicted_price) FROM sp WHERE horizon IN ('1D', '1M') AND symbol % 3 = 0)
SELECT {PRED_SQL} FROM new UNION ALL SELECT {PRED_SQL} FROM sp WHERE NOT (horizon IN ('1D', '1M') AND symbol % 3 = 0)""",
)
def replace_predictions_by_horizon(spark, d):
    old = pred.prediction_frame(sample_predictions(spark, d))
    new = old.where(F.col("horizon").isin("1D", "1M") & (F.col("symbol") % 3 == 0))
    new = new.withColumn("predicted_price", F.col("predicted_price") * 2)
    return pred_out(pred.replace_predictions_by_horizon(old, new))


@query("delete_predictions", f"WITH {SAMPLE} SELECT {PRED_SQL} FROM sp WHERE symbol % 2 = 0 AND symbol % 4 <> 2")
def delete_predictions(spark, d):
    path = stored_predictions(spark, d)
    symbols = sample_predictions(spark, d).select("symbol")
    pred.delete_stored_predictions(spark, path, symbols.where("symbol % 4 = 2"))
    pred.delete_stored_predictions(spark, path, symbols.where("symbol % 2 = 1"))  # empties a category
    return pred_out(pred.read_predictions(spark, path))


# ---- index and instrument files -------------------------------------------------------------


def index_file(spark, d):
    path = scratch_path(spark, "index")
    t.dim_supplier(spark, d).withColumnRenamed("symbol", "Symbol").write.option("header", True).csv(path)
    return path


@query("read_index", f"WITH {DIM} SELECT symbol, company_name, sector, market_cap, headquarters, exchange, currency, nullif(isin, '') AS isin, category FROM dim")
def read_index(spark, d):
    return refs.read_index(spark, index_file(spark, d))


@query("list_symbols", f"WITH {DIM} SELECT category, symbol FROM dim")
def list_symbols(spark, d):
    return refs.list_symbols(t.dim_supplier(spark, d))


@query(
    "read_instruments",
    f"""WITH {DIM} SELECT upper(symbol) AS symbol, isin || 'N' AS isin FROM dim WHERE isin <> ''""",
)
def read_instruments(spark, d):
    """Two entries per Indian symbol (the second wins) and entries the reader must reject."""
    dim = t.dim_supplier(spark, d).where(F.col("category") == "ind_stocks")

    def item(exchange, kind, isin):
        return F.struct(
            F.lit(exchange).alias("exchange"), F.lit(kind).alias("instrument_type"),
            F.concat(F.col("symbol"), F.lit(" ")).alias("trading_symbol"), isin.alias("isin"),
        )

    new = F.when(F.col("isin") != "", F.concat("isin", F.lit("N"))).otherwise(F.lit(""))
    doc = F.map_from_arrays(
        F.array(*[F.concat(F.lit(p), F.col("symbol")) for p in ("a|", "b|", "c|", "d|")]),
        F.array(item("NSE_EQ", "EQ", F.col("isin")), item("NSE_EQ", "EQ", new),
                item("NSE_FO", "FUT", F.lit("X")), item("NSE_EQ", "BE", F.lit("Y"))),
    )
    path = scratch_path(spark, "instruments")
    dim.select(F.to_json(F.struct(doc.alias("data")))).write.text(path)
    return refs.read_instruments(spark, path)


# ---- set operations ---------------------------------------------------------------------------


@query(
    "union_differing_columns",
    f"""WITH {BARS_S}, {LASTQ} SELECT symbol, date, {q6('close', 'close')}, NULL::DOUBLE AS price FROM bars
UNION ALL SELECT symbol, date, NULL::DOUBLE AS close, {q6('price', 'price')} FROM lastq""",
)
def union_differing_columns(spark, d):
    both = tiers.union_all_columns(
        t.bars_supplier(spark, d).select("symbol", "date", "close"),
        last_quotes(spark, d).select("symbol", "date", "price"),
    )
    return both.select("symbol", "date", r6("close").alias("close"), r6("price").alias("price"))


@query(
    "distinct_on_key",
    f"""WITH {QUOTES} SELECT symbol, CAST(ts AS DATE) AS date, arg_max(quote_id, row(ts, quote_id)) AS quote_id,
 {q6('arg_max(price, row(ts, quote_id))', 'price')} FROM quotes GROUP BY 1, 2""",
)
def distinct_on_key(spark, d):
    q = t.quotes(spark, d).withColumn("date", F.to_date("ts"))
    last = tiers.pick_per_key(q, ["symbol", "date"], F.struct("ts", "quote_id"), "last")
    return last.select("symbol", "date", "quote_id", r6("price").alias("price"))


@query("except_on_key", f"WITH {QUOTES} SELECT DISTINCT symbol FROM quotes WHERE symbol NOT IN (SELECT s_suppkey FROM supplier)")
def except_on_key(spark, d):
    return tiers.except_on_key(t.quotes(spark, d), t.supplier_category(spark, d))
