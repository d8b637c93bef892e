"""Queries for dimension maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwright.functions.numeric import r6
from tickwright.operators import dims
from tickwright.schema import DIM_COLUMNS
from tickwright.sources import tables as t

from .registry import BARS_S, DIM, query
from .registry import r6 as q6

COLS = ", ".join(DIM_COLUMNS)
# The stored index: suppliers whose key is not a multiple of four.
HELD = "held AS (SELECT * FROM dim WHERE CAST(substr(symbol, 4) AS INTEGER) % 4 <> 0)"


def key_of(c="symbol"):
    return F.substr(F.col(c), F.lit(4), F.lit(20)).cast("int")


def held(spark, d):
    return t.dim_supplier(spark, d).where(key_of() % 4 != 0)


def candidates(spark, d):
    """Lower-case and unknown symbols from the customer table."""
    c = t.table(spark, d, "customer")
    return c.select(
        F.concat(F.lit("sym"), F.col("c_custkey").cast("string")).alias("symbol"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("company_name"),
        t.category_of(F.col("c_nationkey")).alias("category"),
    )


CAND = """cand AS (SELECT 'sym' || c_custkey AS symbol, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS company_name,
 CASE WHEN c_nationkey % 2 = 0 THEN 'us_stocks' ELSE 'ind_stocks' END AS category FROM customer)"""


@query(
    "dim_insert_if_absent",
    f"""WITH {DIM}, {HELD}, {CAND} SELECT {COLS}, category FROM held UNION ALL
SELECT upper(symbol), coalesce(company_name, upper(symbol)), 'N/A', '', 'N/A', 'N/A',
 CASE WHEN category = 'ind_stocks' THEN 'INR' ELSE 'USD' END, '', category FROM cand
WHERE upper(symbol) NOT IN (SELECT upper(symbol) FROM held)""",
)
def dim_insert_if_absent(spark, d):
    return dims.dim_insert_if_absent(held(spark, d), candidates(spark, d))


def facts(spark, d):
    """Order lines by supplier symbol, plus symbols that only customers have."""
    seen = t.table(spark, d, "lineitem").select(F.concat(F.lit("Sym"), F.col("l_suppkey").cast("string")).alias("symbol"))
    extra = t.table(spark, d, "customer").select(F.concat(F.lit("Sym"), F.col("c_custkey").cast("string")).alias("symbol"))
    return seen.unionByName(extra)


FACTS = """facts AS (SELECT DISTINCT symbol FROM (SELECT 'Sym' || l_suppkey AS symbol FROM lineitem
 UNION ALL SELECT 'Sym' || c_custkey AS symbol FROM customer))"""


@query(
    "dim_sync_from_facts",
    f"""WITH {DIM}, {HELD}, {FACTS} SELECT {COLS}, category FROM held UNION ALL
SELECT f.symbol, coalesce(m.company_name, f.symbol), coalesce(m.sector, 'Unknown'), coalesce(m.market_cap, 'Unknown'),
 coalesce(m.headquarters, 'Unknown'), coalesce(m.exchange, 'Unknown'), coalesce(m.currency, 'Unknown'), coalesce(m.isin, ''), m.category
FROM facts f LEFT JOIN dim m USING (symbol) WHERE f.symbol NOT IN (SELECT symbol FROM held)""",
)
def dim_sync_from_facts(spark, d):
    return dims.dim_sync_from_facts(held(spark, d), facts(spark, d), t.dim_supplier(spark, d))


@query(
    "dim_restrict_and_fill",
    f"""WITH {DIM}, {HELD}, {FACTS} SELECT f.symbol, coalesce(company_name, f.symbol) AS company_name, coalesce(sector, 'Unknown') AS sector,
 coalesce(market_cap, '') AS market_cap, coalesce(headquarters, 'Unknown') AS headquarters, coalesce(exchange, 'NSE') AS exchange,
 coalesce(currency, '') AS currency, coalesce(isin, '') AS isin FROM facts f LEFT JOIN held USING (symbol)""",
)
def dim_restrict_and_fill(spark, d):
    return dims.dim_restrict_and_fill(held(spark, d), facts(spark, d), "NSE")


@query(
    "dim_bootstrap",
    f"""WITH {DIM}, {HELD}, n AS (SELECT count(*) AS n FROM held) SELECT {COLS} FROM held, n WHERE n >= 400 UNION ALL
SELECT symbol, company_name, sector, market_cap, headquarters, exchange, 'USD', '' FROM dim, n WHERE n < 400 AND category = 'us_stocks'""",
)
def dim_bootstrap(spark, d):
    master = t.dim_supplier(spark, d).where(F.col("category") == "us_stocks")
    index = held(spark, d)
    return dims.dim_bootstrap(index, master, "us_stocks", rebuild=dims.dim_is_small(index))


@query(
    "dim_guard_no_shrink",
    f"""WITH {DIM}, {HELD} SELECT (SELECT count(*) FROM dim) AS old_rows, (SELECT count(*) FROM held) AS new_rows,
 (SELECT count(*) FROM held) >= (SELECT count(*) FROM dim) AS ok""",
)
def dim_guard_no_shrink(spark, d):
    return dims.dim_guard_no_shrink(t.dim_supplier(spark, d), held(spark, d))


def corrections(spark, d):
    return t.table(spark, d, "customer").where(F.col("c_custkey") % 6 == 1).select(
        F.concat(F.lit("SYM"), F.col("c_custkey").cast("string")).alias("symbol"),
        F.concat(F.lit("INE"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("isin"),
    )


CORR = """corr AS (SELECT 'SYM' || c_custkey AS symbol, 'INE' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS isin
 FROM customer WHERE c_custkey % 6 = 1)"""


@query(
    "dim_update_isin",
    f"""WITH {DIM}, {HELD}, {CORR} SELECT h.symbol, coalesce(c.isin, h.isin) AS isin, c.isin IS NOT NULL AND h.isin <> c.isin AS updated
FROM held h LEFT JOIN corr c ON upper(h.symbol) = c.symbol""",
)
def dim_update_isin(spark, d):
    return dims.dim_update_isin(held(spark, d), corrections(spark, d)).select("symbol", "isin", "updated")


@query("dim_update_isin_not_found", f"WITH {DIM}, {HELD}, {CORR} SELECT symbol, isin FROM corr WHERE symbol NOT IN (SELECT upper(symbol) FROM held)")
def isin_not_found(spark, d):
    return dims.isin_not_found(held(spark, d), corrections(spark, d))


LOOKUP_SQL = f"""WITH {DIM}, {CAND} SELECT c.symbol, d.company_name, d.sector, d.market_cap, d.headquarters, d.exchange, d.currency, d.isin
FROM cand c LEFT JOIN dim d ON upper(c.symbol) = upper(d.symbol)"""


@query("dim_lookup", LOOKUP_SQL)
def dim_lookup(spark, d):
    return dims.dim_lookup(candidates(spark, d).select("symbol"), t.dim_supplier(spark, d).drop("category"))


@query(
    "resolve_isin",
    f"""WITH {DIM}, {HELD}, {CAND}, r AS (SELECT c.symbol, coalesce(CASE c.symbol WHEN 'sym3' THEN 'INE000FIXED3' WHEN 'sym8' THEN 'INE000FIXED8' END,
 nullif(trim(h.isin), ''), nullif(trim(i.isin), '')) AS isin FROM cand c LEFT JOIN held h ON upper(h.symbol) = upper(c.symbol)
 LEFT JOIN dim i ON upper(i.symbol) = upper(c.symbol))
SELECT symbol, 'NSE_EQ|' || isin AS instrument_key FROM r""",
)
def resolve_isin(spark, d):
    fixed = {"SYM3": "INE000FIXED3", "SYM8": "INE000FIXED8"}
    return dims.resolve_isin(candidates(spark, d), fixed, held(spark, d), t.dim_supplier(spark, d))


@query(
    "dim_audit",
    f"""WITH {DIM} SELECT category, count(*) AS row_count, {q6('100.0 * count(*) FILTER (isin <> $$$$) / count(*)', 'isin_coverage')},
 bool_and(currency = CASE WHEN category = 'ind_stocks' THEN 'INR' ELSE 'USD' END) AS currency_ok, true AS columns_ok
FROM dim GROUP BY category""".replace("$$$$", "''"),
)
def dim_audit(spark, d):
    return dims.dim_audit(t.dim_supplier(spark, d)).withColumn("isin_coverage", r6("isin_coverage"))


@query("isin_format_valid", f"WITH {DIM} SELECT symbol, isin, length(isin) = 12 AND starts_with(isin, 'INE') AS valid FROM dim")
def isin_format_valid(spark, d):
    return t.dim_supplier(spark, d).select("symbol", "isin", dims.isin_format_valid().alias("valid"))


@query("isin_sample")
def isin_sample(spark, d):
    return dims.isin_sample(t.dim_supplier(spark, d), 20)


@query("find_orphans", f"WITH {DIM}, {HELD}, {FACTS} SELECT symbol FROM facts WHERE symbol NOT IN (SELECT symbol FROM held)")
def find_orphans(spark, d):
    return dims.find_orphans(facts(spark, d), held(spark, d))


REPORT = "n AS (SELECT symbol, count(*) AS n, max(date) AS d1 FROM bars GROUP BY symbol), want AS (SELECT c_custkey AS symbol FROM customer)"


def wanted(spark, d):
    return t.table(spark, d, "customer").select(F.col("c_custkey").alias("symbol"))


@query(
    "completeness_report",
    f"""WITH {BARS_S}, {REPORT} SELECT symbol, n IS NOT NULL AS file_exists, coalesce(n, 0) AS row_count, coalesce(n, 0) >= 100 AS valid,
 coalesce(n, 0) < 100 AS needs_download FROM want LEFT JOIN n USING (symbol)""",
)
def completeness_report(spark, d):
    return dims.completeness_report(wanted(spark, d), t.bars_supplier(spark, d))


@query(
    "freshness_report",
    f"""WITH {BARS_S}, {REPORT} SELECT symbol, coalesce(n, 0) AS row_count, d1 AS last_date,
 coalesce(date_diff('day', d1, DATE '2001-10-31') <= 7, false) AS recent,
 NOT coalesce(date_diff('day', d1, DATE '2001-10-31') <= 7, false) AS needs_download FROM want LEFT JOIN n USING (symbol)""",
)
def freshness_report(spark, d):
    return dims.freshness_report(wanted(spark, d), t.bars_supplier(spark, d), "2001-10-31")
