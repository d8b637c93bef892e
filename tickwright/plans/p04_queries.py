"""Queries for the read operators of the service."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwright.functions.numeric import r6
from tickwright.operators import query as op
from tickwright.schema import SEARCH_CAP, SEARCH_PER_CATEGORY
from tickwright.sources import tables as t

from .p01_files import KEEP_FIRST_SQL, LASTQ, TIERS, bar_out, last_quotes, latest, past, permanent
from .registry import BARS_S, CATS, DIM, QUOTES, query
from .registry import r6 as q6


def search_dim(spark, d):
    """A searchable index: parts as listings (symbol from key and brand, name from the part)."""
    return t.table(spark, d, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"),
        F.col("p_name").alias("company_name"),
        F.when(F.col("p_size") % 2 == 0, "us_stocks").otherwise("ind_stocks").alias("category"),
    )


SEARCH_DIM = "sdim AS (SELECT 'P' || p_partkey AS symbol, p_name AS company_name, CASE WHEN p_size % 2 = 0 THEN 'us_stocks' ELSE 'ind_stocks' END AS category FROM part)"


def search_sql(text):
    return f"""{SEARCH_DIM}, hits AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY symbol, company_name) AS rk FROM sdim
 WHERE contains(lower(symbol), '{text}') OR contains(lower(company_name), '{text}')),
found AS (SELECT symbol, arg_min(company_name, (category <> 'us_stocks')) AS name FROM hits WHERE rk <= 10 GROUP BY symbol)"""


@query("search", f"WITH {search_sql('ring')} SELECT symbol, name FROM found")
def search(spark, d):
    return op.search(search_dim(spark, d), " Ring", False, SEARCH_PER_CATEGORY, SEARCH_CAP)


@query(
    "search_all",
    f"""WITH {SEARCH_DIM} SELECT symbol, arg_min(company_name, (category <> 'us_stocks')) AS name FROM sdim
 WHERE contains(lower(symbol), 'ring') OR contains(lower(company_name), 'ring') GROUP BY symbol""",
)
def search_all(spark, d):
    """Every match, without the limits of the report."""
    return op.search(search_dim(spark, d), "ring")


@query("search_with_fallback", f"WITH {search_sql('inc.')}, pop AS (SELECT DISTINCT symbol FROM found) SELECT * FROM (VALUES ('AAPL', 'Apple Inc.'), ('GOOGL', 'Alphabet Inc.'), ('AMZN', 'Amazon.com Inc.'), ('TSLA', 'Tesla Inc.'), ('META', 'Meta Platforms Inc.'), ('NFLX', 'Netflix Inc.')) v(symbol, name) WHERE (SELECT count(*) FROM pop) = 0 UNION ALL SELECT symbol, name FROM found")
def search_with_fallback(spark, d):
    return op.search_with_fallback(search_dim(spark, d), "inc.", SEARCH_PER_CATEGORY, SEARCH_CAP)


AS_OF = "2000-12-31"


def history_sql(period_filter):
    return f"""WITH {BARS_S}, {CATS} SELECT symbol, strftime(date, '%Y-%m-%d') AS date, {", ".join(q6(c, c) for c in ("open", "high", "low", "close"))},
 volume, CASE WHEN category IS NULL THEN 'USD' WHEN category = 'ind_stocks' THEN 'INR' ELSE 'USD' END AS currency
 FROM bars LEFT JOIN (SELECT * FROM cats WHERE symbol % 3 = 0) USING (symbol) WHERE {period_filter}"""


def hist(period):
    def run(spark, d):
        dim = t.supplier_category(spark, d).where(F.col("symbol") % 3 == 0)
        dim = dim.withColumn("currency", F.when(F.col("category") == "ind_stocks", "INR").otherwise("USD"))
        out = op.history(t.bars_supplier(spark, d), dim, period, AS_OF, "2000-01-01")
        return out.withColumns({c: r6(c) for c in ("open", "high", "low", "close")})

    return run


query("history_week", history_sql(f"date >= DATE '{AS_OF}' - 7"))(hist("week"))
query("history_month", history_sql(f"date >= DATE '{AS_OF}' - 30"))(hist("month"))
query("history_year", history_sql("date >= DATE '2000-01-01'"))(hist("year"))
query("history_5year", history_sql("true"))(hist("5year"))


@query("needs_more_points", f"WITH {BARS_S} SELECT symbol, count(*) AS n, count(*) < 20 AS needs_more FROM bars WHERE date >= DATE '{AS_OF}' - 90 GROUP BY symbol")
def needs_more_points(spark, d):
    b = t.bars_supplier(spark, d).where(F.col("date") >= F.date_sub(F.lit(AS_OF).cast("date"), 90))
    return op.needs_more_points(b, "month")


TAIL = f"""WITH {TIERS}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn,
 max(CASE WHEN date >= DATE '{AS_OF}' - DAYS THEN 1 ELSE 0 END) OVER (PARTITION BY symbol) AS has FROM u),
u2 AS (SELECT 1)
SELECT symbol, date, {q6('close', 'close')} FROM b WHERE CASE WHEN has = 1 THEN date >= DATE '{AS_OF}' - DAYS ELSE rn <= ROWS_ END"""
MIXED = "u AS (SELECT * FROM past WHERE symbol % 2 = 1 UNION ALL SELECT * FROM latest WHERE symbol % 2 = 0 AND date <= DATE '2000-12-25')"


def mixed(spark, d):
    """Histories that end at different dates, so both branches occur."""
    p = past(spark, d).where(F.col("symbol") % 2 == 1)
    l = latest(spark, d).where((F.col("symbol") % 2 == 0) & (F.col("date") <= F.lit("2000-12-25").cast("date")))
    return p.unionByName(l)


def tail_sql(days, rows):
    return TAIL.replace("DAYS", str(days)).replace("ROWS_", str(rows)).replace("b AS (SELECT *, row", f"{MIXED}, b AS (SELECT *, row")


def tail(period):
    return lambda spark, d: op.fallback_tail(mixed(spark, d), period, AS_OF).select("symbol", "date", r6("close").alias("close"))


query("fallback_tail_week", tail_sql(14, 10))(tail("week"))
query("fallback_tail_month", tail_sql(60, 30))(tail("month"))
query("fallback_tail_year", tail_sql(-100000, 250))(tail("year"))


@query("merge_points", KEEP_FIRST_SQL)
def merge_points(spark, d):
    from tickwright.operators.tiers import combine

    return bar_out(combine(past(spark, d), latest(spark, d), "first"))


@query(
    "latest_price_per_symbol",
    f"""WITH {BARS_S}, {CATS} SELECT symbol, {q6('arg_max(close, date)', 'price')}, max(date) AS timestamp,
 CASE WHEN category = 'ind_stocks' THEN 'INR' ELSE 'USD' END AS currency, category FROM bars JOIN cats USING (symbol) GROUP BY symbol, category""",
)
def latest_price_per_symbol(spark, d):
    b = t.bars_supplier(spark, d).join(t.supplier_category(spark, d), "symbol")
    return op.latest_price_per_symbol(b).withColumn("price", r6("price"))


OHLCV_AGG = ", ".join(q6(f"arg_max({c}, row(live, date))", c) for c in ("open", "high", "low", "close", "volume"))


@query(
    "latest_day_ohlcv",
    f"""WITH {TIERS}, u AS (SELECT *, 1 AS live FROM latest WHERE symbol % 2 = 0 UNION ALL SELECT *, 0 AS live FROM permanent)
SELECT symbol, arg_max(date, row(live, date)) AS date, {OHLCV_AGG} FROM u GROUP BY symbol""",
)
def latest_day_ohlcv(spark, d):
    out = op.latest_day_ohlcv(latest(spark, d).where(F.col("symbol") % 2 == 0), permanent(spark, d))
    return bar_out(out)


@query(
    "price_card",
    f"""WITH {TIERS}, {LASTQ}, {DIM}, dk AS (SELECT * EXCLUDE (symbol), CAST(substr(symbol, 4) AS BIGINT) AS symbol FROM dim),
st AS (SELECT symbol, max(date) AS d1, arg_max(open, date) AS o, arg_max(high, date) AS h, arg_max(low, date) AS l, arg_max(close, date) AS c,
 arg_max(volume, date) AS v FROM latest GROUP BY symbol), lq AS (SELECT symbol, price AS lp FROM lastq WHERE symbol % 2 = 0),
j AS (SELECT dk.*, lp, st.*EXCL, coalesce(lp, c) AS px FROM dk LEFT JOIN lq USING (symbol) LEFT JOIN st USING (symbol) WHERE coalesce(lp, c) IS NOT NULL)
SELECT symbol, {q6('px', 'price')}, CASE WHEN lp IS NULL THEN 'stored' ELSE 'live' END AS source, lp IS NOT NULL AS source_reliable,
 CASE WHEN lp IS NULL THEN d1 END AS data_date, company_name, sector, market_cap, headquarters, exchange, currency,
 {q6('o', 'open')}, {q6('h', 'high')}, {q6('l', 'low')}, {q6('c', 'close')}, v AS volume,
 {q6("CASE WHEN currency = 'USD' THEN px * 83.5 ELSE px END", 'price_inr')}, {q6("CASE WHEN currency = 'INR' THEN px / 83.5 ELSE px END", 'price_usd')},
 83.5::DOUBLE AS exchange_rate FROM j""".replace("st.*EXCL", "st.d1, st.o, st.h, st.l, st.c, st.v"),
)
def price_card(spark, d):
    dim = t.dim_supplier(spark, d).withColumn("symbol", F.substr("symbol", F.lit(4), F.lit(20)).cast("bigint"))
    live = last_quotes(spark, d).where(F.col("symbol") % 2 == 0)
    out = op.price_card(live, op.latest_row(latest(spark, d)), dim)
    return out.withColumns({c: r6(c) for c in ("price", "open", "high", "low", "close", "price_inr", "price_usd")})


@query("last_n", f"WITH {BARS_S}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars) SELECT symbol, date, {q6('close', 'close')} FROM n WHERE rn <= 100")
def last_n(spark, d):
    return op.last_n(t.bars_supplier(spark, d), 100).select("symbol", "date", r6("close").alias("close"))


@query(
    "chart_domain",
    f"""WITH {BARS_S}, e AS (SELECT symbol, min(close * 83.5) AS lo, max(close * 83.5) AS hi FROM bars GROUP BY symbol)
SELECT symbol, {q6('lo', 'lo')}, {q6('hi', 'hi')}, {q6('lo - (hi - lo) * 0.1', 'axis_min')}, {q6('hi + (hi - lo) * 0.1', 'axis_max')} FROM e""",
)
def chart_domain(spark, d):
    out = op.chart_domain(t.bars_supplier(spark, d), 83.5)
    return out.select("symbol", *[r6(c).alias(c) for c in ("lo", "hi", "axis_min", "axis_max")])
