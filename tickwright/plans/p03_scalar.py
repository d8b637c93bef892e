"""Queries for projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwright.functions import scalar as sc
from tickwright.functions.numeric import nan_to_num, null_if_not_finite, r6
from tickwright.operators import joins, tiers
from tickwright.schema import HORIZON_DAYS
from tickwright.sources import tables as t

from .p02_dims import CAND, candidates
from .registry import BARS_S, CATS, DIM, query
from .registry import r6 as q6


@query("standardize_columns", f'WITH {BARS_S} SELECT symbol, date, {q6("close", "close")}, {q6("high", "adjusted_close")}, {q6("low", "company_name")} FROM bars')
def standardize_columns(spark, d):
    raw = t.bars_supplier(spark, d).select(
        F.col("symbol").alias("Symbol"), F.col("date").alias("Date"), r6("close").alias("Close"),
        r6("high").alias("Adj Close"), r6("low").alias("Company Name"),
    )
    return sc.standardize_columns(raw)


@query("normalize_bar_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders")
def normalize_bar_date(spark, d):
    """Local midnights with an offset, as the Indian history files carry them."""
    o = t.table(spark, d, "orders")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("+05:30"))
    return o.select("o_orderkey", sc.bar_date(F.when(F.col("o_orderkey") % 2 == 0, text).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("date"))


@query("sort_by_symbol", f"WITH {DIM} SELECT symbol, company_name, category FROM dim ORDER BY symbol")
def sort_by_symbol(spark, d):
    return t.dim_supplier(spark, d).select("symbol", "company_name", "category").orderBy("symbol")


@query("valid_symbol", "SELECT p_partkey, coalesce(length(trim(p_name)) BETWEEN 1 AND 10, false) AS valid FROM part")
def valid_symbol(spark, d):
    return t.table(spark, d, "part").select("p_partkey", sc.valid_symbol("p_name").alias("valid"))


@query(
    "valid_price",
    """SELECT p_partkey, coalesce(try_cast(CASE p_partkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN '-5' WHEN 2 THEN '0'
 ELSE printf('%.2f', p_retailprice) END AS DOUBLE) > 0, false) AS valid FROM part""",
)
def valid_price(spark, d):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, "n/a").when(k == 1, "-5").when(k == 2, "0").otherwise(F.format_string("%.2f", "p_retailprice"))
    return t.table(spark, d, "part").select("p_partkey", sc.valid_price(text).alias("valid"))


DATE_TEXT = """CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN year(o_orderdate) || '-2-' || day(o_orderdate)
 WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END"""


@query(
    "valid_date_string",
    f"""SELECT o_orderkey, regexp_matches({DATE_TEXT}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') AND try_cast({DATE_TEXT} AS DATE) IS NOT NULL AS valid FROM orders""",
)
def valid_date_string(spark, d):
    k, ts = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(ts, "yyyy-MM-dd"))
        .when(k == 1, F.concat_ws("-", F.year(ts), F.lit(2), F.dayofmonth(ts)))
        .when(k == 2, F.date_format(ts, "dd/MM/yyyy"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    )
    return t.table(spark, d, "orders").select("o_orderkey", sc.valid_date_string(text).alias("valid"))


META = "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ' NaN ' WHEN 2 THEN '  ' WHEN 3 THEN 'none' WHEN 4 THEN 'Null' ELSE '  ' || c_name || ' ' END"


@query("clean_metadata", f"SELECT c_custkey, CASE WHEN {META} IS NULL OR lower(trim({META})) IN ('', 'nan', 'none', 'null') THEN 'N/A' ELSE trim({META}) END AS value FROM customer")
def clean_metadata(spark, d):
    k = F.col("c_custkey") % 6
    raw = (
        F.when(k == 0, F.lit(None)).when(k == 1, " NaN ").when(k == 2, "  ").when(k == 3, "none").when(k == 4, "Null")
        .otherwise(F.concat(F.lit("  "), "c_name", F.lit(" ")))
    )
    return t.table(spark, d, "customer").select("c_custkey", sc.clean_metadata(raw).alias("value"))


RAW_SYMBOL = """CASE p_partkey % 6 WHEN 0 THEN 'sym' || p_partkey || '.NS' WHEN 1 THEN 'AB' || p_partkey || '.us' WHEN 2 THEN 'Sym' || p_partkey
 WHEN 3 THEN 'tatabank' || p_partkey WHEN 4 THEN 'LT' ELSE replace(p_name, ' ', '') END"""
PARTS = "RELIANCE|TCS|INFY|HDFC|ICICI|WIPRO|MARUTI|BAJAJ|TATA|ADANI|LT|ITC|BHARTI|ONGC|SBI|NTPC|POWER|COAL|GAIL|BPCL|HPCL|IOC|BANK"


def raw_symbols(spark, d):
    k, key = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    s = (
        F.when(k == 0, F.concat(F.lit("sym"), key, F.lit(".NS")))
        .when(k == 1, F.concat(F.lit("AB"), key, F.lit(".us")))
        .when(k == 2, F.concat(F.lit("Sym"), key))
        .when(k == 3, F.concat(F.lit("tatabank"), key))
        .when(k == 4, "LT")
        .otherwise(F.replace("p_name", F.lit(" "), F.lit("")))
    )
    return t.table(spark, d, "part").select("p_partkey", s.alias("symbol"))


@query(
    "categorize_symbol",
    f"""WITH {DIM}, raw AS (SELECT p_partkey, {RAW_SYMBOL} AS symbol FROM part), b AS (SELECT *, upper(trim(symbol)) AS u,
 split_part(upper(trim(symbol)), '.', 1) AS base FROM raw), m AS (SELECT upper(symbol) AS s, min(category) AS c FROM dim GROUP BY 1)
SELECT p_partkey, symbol, CASE WHEN u LIKE '%.NS' OR u LIKE '%.BO' THEN 'ind_stocks' WHEN u LIKE '%.US' THEN 'us_stocks' WHEN c IS NOT NULL THEN c
 WHEN length(base) >= 3 AND regexp_matches(base, '{PARTS}') THEN 'ind_stocks' ELSE 'us_stocks' END AS category FROM b LEFT JOIN m ON m.s = b.base""",
)
def categorize_symbol(spark, d):
    dim = t.dim_supplier(spark, d).withColumn("symbol", F.upper("symbol"))
    return sc.categorize_symbol(raw_symbols(spark, d), dim)


@query(
    "categorize_simple",
    f"""WITH raw AS (SELECT p_partkey, {RAW_SYMBOL} AS symbol FROM part) SELECT p_partkey, CASE WHEN symbol = upper(symbol) AND
 regexp_matches(symbol, '[A-Za-z]') AND NOT contains(symbol, '.') THEN 'ind_stocks' ELSE 'us_stocks' END AS category FROM raw""",
)
def categorize_simple(spark, d):
    return raw_symbols(spark, d).select("p_partkey", sc.categorize_simple("symbol").alias("category"))


@query("exchange_ticker", f"WITH raw AS (SELECT p_partkey, {RAW_SYMBOL} AS symbol FROM part) SELECT p_partkey, split_part(symbol, '.', 1) || '.NS' AS ticker FROM raw")
def exchange_ticker(spark, d):
    return raw_symbols(spark, d).select("p_partkey", sc.exchange_ticker("symbol").alias("ticker"))


CAT3 = "CASE c_custkey % 3 WHEN 0 THEN 'us_stocks' WHEN 1 THEN 'ind_stocks' ELSE 'other' END"


@query("currency_for_category", f"SELECT c_custkey, CASE WHEN {CAT3} = 'ind_stocks' THEN 'INR' ELSE 'USD' END AS currency FROM customer")
def currency_for_category(spark, d):
    k = F.col("c_custkey") % 3
    cat = F.when(k == 0, "us_stocks").when(k == 1, "ind_stocks").otherwise("other")
    return t.table(spark, d, "customer").select("c_custkey", sc.currency_for_category(cat).alias("currency"))


@query(
    "convert_usd_inr",
    f"""SELECT c_custkey, {q6('CASE WHEN c_acctbal <= 0 THEN 0.0 ELSE c_acctbal * 83.5 END', 'inr')},
 {q6('CASE WHEN c_acctbal <= 0 THEN 0.0 ELSE c_acctbal / 83.5 END', 'usd')} FROM customer""",
)
def convert_usd_inr(spark, d):
    return t.table(spark, d, "customer").select(
        "c_custkey", r6(sc.convert_usd_inr("c_acctbal", 83.5)).alias("inr"), r6(sc.convert_inr_usd("c_acctbal", 83.5)).alias("usd")
    )


PRICE_N = "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END"
SRC, DST = "CASE WHEN c_custkey % 2 = 0 THEN 'USD' ELSE 'INR' END", "CASE WHEN c_custkey % 3 = 0 THEN 'USD' ELSE 'INR' END"
RATE_N = "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 80.0 + c_nationkey END"


def price_rows(spark, d):
    k = F.col("c_custkey")
    return t.table(spark, d, "customer").select(
        "c_custkey", F.when(k % 5 != 0, F.col("c_acctbal")).alias("price"),
        F.when(k % 2 == 0, "USD").otherwise("INR").alias("src"), F.when(k % 3 == 0, "USD").otherwise("INR").alias("dst"),
        F.when(k % 4 != 0, F.lit(80.0) + F.col("c_nationkey")).alias("rate"),
    )


@query(
    "convert_price",
    f"""WITH p AS (SELECT c_custkey, {PRICE_N} AS price, {SRC} AS src, {DST} AS dst, {RATE_N} AS rate FROM customer)
SELECT c_custkey, {q6("CASE WHEN price IS NULL THEN 0.0 WHEN src = dst THEN price WHEN src = 'USD' THEN price * coalesce(rate, 83.5) ELSE price / coalesce(rate, 83.5) END", 'converted')} FROM p""",
)
def convert_price(spark, d):
    return price_rows(spark, d).select("c_custkey", r6(sc.convert_price("price", "src", "dst", F.col("rate"))).alias("converted"))


CUR3 = "CASE c_custkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'INR' ELSE 'EUR' END"


@query(
    "format_price",
    f"""WITH p AS (SELECT c_custkey, printf('%.2f', coalesce({PRICE_N}, 0.0)) AS s, {CUR3} AS cur FROM customer)
SELECT c_custkey, CASE cur WHEN 'USD' THEN '$' || s WHEN 'INR' THEN '₹' || s ELSE s || ' ' || cur END AS price FROM p""",
)
def format_price(spark, d):
    k = F.col("c_custkey") % 3
    rows = price_rows(spark, d).withColumn("cur", F.when(k == 0, "USD").when(k == 1, "INR").otherwise("EUR"))
    return rows.select("c_custkey", sc.format_price("price", "cur").alias("price"))


@query(
    "format_price_grouped",
    """WITH p AS (SELECT o_orderkey, printf('%.2f', o_totalprice) AS s FROM orders), q AS (SELECT *, split_part(s, '.', 1) AS i, split_part(s, '.', 2) AS f FROM p)
SELECT o_orderkey, '₹' || CASE WHEN length(i) <= 3 THEN i ELSE
 ltrim(regexp_replace(lpad(left(i, length(i) - 3), 12, ' '), '(..)', '\\1,', 'g'), ' ,') || right(i, 3) END || '.' || f AS price FROM q""",
)
def format_price_grouped(spark, d):
    return t.table(spark, d, "orders").select("o_orderkey", sc.format_price_grouped("o_totalprice").alias("price"))


@query(
    "normalize_ohlc_currency",
    f"""WITH {BARS_S}, {CATS}, j AS (SELECT *, CASE WHEN category = 'ind_stocks' THEN 82.0 ELSE 1.0 END AS k FROM bars JOIN cats USING (symbol))
SELECT symbol, date, {q6('open / k', 'open')}, {q6('high / k', 'high')}, {q6('low / k', 'low')}, {q6('close / k', 'close')} FROM j""",
)
def normalize_ohlc_currency(spark, d):
    b = t.bars_supplier(spark, d).join(t.supplier_category(spark, d), "symbol")
    rates = t.table(spark, d, "supplier").groupBy(t.category_of(F.col("s_nationkey")).alias("category")).agg(F.lit(82.0).alias("rate"))
    out = tiers.normalize_ohlc_currency(b, rates)
    return out.select("symbol", "date", *[r6(c).alias(c) for c in ("open", "high", "low", "close")])


RATE_SOURCES = ["purchase", "view", "click"]


@query(
    "fx_rate",
    f"""WITH r AS (SELECT CAST(ts AS DATE) AS date, CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS pri,
  arg_max(value - 100.0, row(ts, event_id)) AS rate FROM events WHERE event_type IN ('purchase', 'view', 'click') GROUP BY 1, 2)
SELECT date, {q6('coalesce(arg_min(rate, pri) FILTER (rate > 0), 83.5)', 'rate')} FROM r GROUP BY date""",
)
def fx_rate(spark, d):
    q = t.quotes(spark, d).where(F.col("source").isin(RATE_SOURCES))
    rank = F.when(F.col("source") == "purchase", 0).when(F.col("source") == "view", 1).otherwise(2)
    last = q.groupBy(F.to_date("ts").alias("date"), rank.alias("priority")).agg(
        F.max_by(F.col("price") - 100.0, F.struct("ts", "quote_id")).alias("rate")
    )
    return joins.fx_rate(last, ["date"]).withColumn("rate", r6("rate"))


FXQ = "fx AS (SELECT ts AS fts, value / 10.0 + 60.0 AS rate FROM events WHERE event_type = 'purchase')"


@query(
    "fx_rate_as_of",
    f"""WITH {FXQ}, q AS (SELECT event_id AS quote_id, ts FROM events WHERE event_type <> 'purchase')
SELECT quote_id, {q6('coalesce(rate, 83.5)', 'rate')} FROM (SELECT q.quote_id, q.ts, fx.fts, fx.rate FROM q ASOF LEFT JOIN (SELECT * FROM fx) fx ON q.ts >= fx.fts) j
WHERE fts IS NOT NULL AND ts < fts + INTERVAL 3600 SECOND
UNION ALL SELECT quote_id, 83.5 AS rate FROM (SELECT q.quote_id, q.ts, fx.fts FROM q ASOF LEFT JOIN fx ON q.ts >= fx.fts) j
WHERE fts IS NULL OR ts >= fts + INTERVAL 3600 SECOND""",
)
def fx_rate_as_of(spark, d):
    q = t.quotes(spark, d)
    fx = q.where(F.col("source") == "purchase").select("ts", (F.col("price") / 10.0 + 60.0).alias("rate"))
    out = joins.fx_rate_as_of(q.where(F.col("source") != "purchase").select("quote_id", "ts"), fx)
    return out.select("quote_id", r6("rate").alias("rate"))


@query(
    "horizon_days",
    """WITH h AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '1D' WHEN 1 THEN '1w' WHEN 2 THEN '1M' WHEN 3 THEN '1y' WHEN 4 THEN '5Y' ELSE '2D' END AS horizon FROM customer),
v AS (SELECT *, CASE upper(horizon) WHEN '1D' THEN 1 WHEN '1W' THEN 7 WHEN '1M' THEN 30 WHEN '1Y' THEN 365 WHEN '5Y' THEN 1825 ELSE 1 END AS days FROM h)
SELECT c_custkey, horizon, CAST(days AS INTEGER) AS days, DATE '2024-06-30' + CAST(days AS INTEGER) AS prediction_date FROM v""",
)
def horizon_days(spark, d):
    k = F.col("c_custkey") % 7
    names = list(HORIZON_DAYS)
    h = F.when(k == 0, names[0]).when(k == 1, "1w").when(k == 2, names[2]).when(k == 3, "1y").when(k == 4, names[4]).otherwise("2D")
    rows = t.table(spark, d, "customer").select("c_custkey", h.alias("horizon"))
    return rows.select("*", sc.horizon_days("horizon").alias("days"), sc.prediction_date("horizon", "2024-06-30").alias("prediction_date"))


ODD = "CASE c_custkey % 5 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN '-Infinity'::DOUBLE WHEN 3 THEN NULL ELSE c_acctbal END"


def odd(spark, d):
    k = F.col("c_custkey") % 5
    v = (
        F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf")))
        .when(k == 4, F.col("c_acctbal"))
    )
    return t.table(spark, d, "customer").select("c_custkey", v.alias("x"))


@query("null_if_not_finite", f"WITH o AS (SELECT c_custkey, {ODD} AS x FROM customer) SELECT c_custkey, CASE WHEN isfinite(x) THEN x END AS x FROM o")
def null_if_not_finite_q(spark, d):
    return odd(spark, d).select("c_custkey", null_if_not_finite("x").alias("x"))


@query(
    "nan_to_num",
    f"""WITH o AS (SELECT c_custkey, {ODD} AS x FROM customer) SELECT c_custkey, CASE WHEN x IS NULL OR isnan(x) THEN 0.0 WHEN isinf(x) AND x > 0 THEN 1e6
 WHEN isinf(x) THEN -1e6 ELSE x END AS feature, CASE WHEN x IS NULL OR isnan(x) THEN 0.0 WHEN isinf(x) AND x > 0 THEN 50.0 WHEN isinf(x) THEN -50.0 ELSE x END AS target FROM o""",
)
def nan_to_num_q(spark, d):
    return odd(spark, d).select("c_custkey", nan_to_num("x").alias("feature"), nan_to_num("x", 0.0, 50.0, -50.0).alias("target"))


@query("impute_median")
def impute_median(spark, d):
    from tickwright.operators.regression import impute_median as impute

    rows = odd(spark, d).withColumn("none", F.lit(None).cast("double"))
    out = impute(rows, ["x", "none"])
    return out.select("c_custkey", r6("x").alias("x"), r6("none").alias("none"))


@query(
    "change_pct",
    f"""SELECT o_orderkey, {q6('o_totalprice * 1.1 - cur', 'change')}, {q6('CASE WHEN cur = 0 THEN 0.0 ELSE (o_totalprice * 1.1 - cur) / nullif(cur, 0) * 100.0 END', 'change_pct')}
FROM (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE o_totalprice END AS cur FROM orders)""",
)
def change_pct(spark, d):
    o = t.table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") * 1.1).alias("p"), F.when(F.col("o_orderkey") % 10 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("c")
    )
    return o.select("o_orderkey", r6(sc.change("p", "c")).alias("change"), r6(sc.change_pct("p", "c")).alias("change_pct"))


@query(
    "confidence_band",
    """WITH v AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS c FROM events) SELECT event_id,
 CASE WHEN c IS NULL THEN 'none' WHEN c >= 61 THEN 'high' WHEN c >= 31 THEN 'medium' ELSE 'low' END AS band,
 CASE WHEN c IS NULL THEN 'none' WHEN c >= 70 THEN 'high' WHEN c >= 50 THEN 'medium' ELSE 'low' END AS band_wide FROM v""",
)
def confidence_band(spark, d):
    v = F.when(F.col("event_id") % 9 != 0, F.col("value"))
    return t.table(spark, d, "events").select(
        "event_id", sc.confidence_band(v).alias("band"), sc.confidence_band(v, 70.0, 50.0).alias("band_wide")
    )


@query(
    "quote_json",
    f"""WITH {CAND} SELECT symbol, '{{"symbol":"' || upper(symbol) || '","price":12.5,"company_name":"' || coalesce(company_name, upper(symbol)) || '"}}' AS doc FROM cand""",
)
def quote_json(spark, d):
    return candidates(spark, d).select("symbol", sc.quote_json("symbol", F.lit("12.5"), "company_name").alias("doc"))


@query(
    "encode_categories",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1.0 WHEN 'F' THEN 2.0 ELSE 0.0 END::DOUBLE AS status,
 CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 2.0 ELSE 9.0 END::DOUBLE AS priority FROM orders""",
)
def encode_categories(spark, d):
    return t.table(spark, d, "orders").select(
        "o_orderkey", sc.encode_categories("o_orderstatus", {"O": 1, "F": 2}).alias("status"),
        sc.encode_categories("o_orderpriority", {"1-URGENT": 1, "2-HIGH": 2}, 9.0).alias("priority"),
    )
