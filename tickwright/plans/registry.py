"""Query registry: name -> Spark callable and, where SQL can say it, oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its oracle."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# ---- SQL fragments shared by the oracles -------------------------------------------------

TICKS = """ticks AS (
  SELECT l_suppkey AS supplier, CAST(l_shipdate AS DATE) AS day,
         floor(p_retailprice * (1.0 - l_discount) * 100.0 + 0.5003) / 100.0 AS px, l_quantity, l_orderkey, l_linenumber
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""

_AGG = """arg_min(px, row(l_orderkey, l_linenumber, px)) AS open, max(px) AS high, min(px) AS low,
         arg_max(px, row(l_orderkey, l_linenumber, px)) AS close, sum(l_quantity) AS volume"""

BARS_S = f"""{TICKS},
bars AS (SELECT supplier AS symbol, day AS date, {_AGG} FROM ticks GROUP BY supplier, day)"""

BARS_N = f"""{TICKS},
bars AS (
  SELECT CAST(s_nationkey AS BIGINT) AS symbol,
         CAST('1970-01-01' AS DATE)
           + CAST(floor(date_diff('day', DATE '1970-01-01', day) / 4.0) * 4 AS INTEGER) AS date,
         {_AGG}
  FROM ticks JOIN supplier ON s_suppkey = supplier GROUP BY 1, 2)"""

CATS = """cats AS (
  SELECT s_suppkey AS symbol,
         CASE WHEN s_nationkey % 2 = 0 THEN 'us_stocks' ELSE 'ind_stocks' END AS category
  FROM supplier)"""

DIM = """dim AS (
  SELECT 'Sym' || s_suppkey AS symbol, s_name AS company_name, r_name AS sector,
         printf('%.2f', s_acctbal) AS market_cap, n_name AS headquarters,
         CASE WHEN s_nationkey % 2 = 0 THEN 'NASDAQ' ELSE 'NSE' END AS exchange,
         CASE WHEN s_nationkey % 2 = 0 THEN 'USD' ELSE 'INR' END AS currency,
         CASE WHEN s_nationkey % 2 = 1 AND s_suppkey % 3 <> 0
              THEN 'INE' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') ELSE '' END AS isin,
         CASE WHEN s_nationkey % 2 = 0 THEN 'us_stocks' ELSE 'ind_stocks' END AS category
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""

QUOTES = """quotes AS (
  SELECT user_id AS symbol, ts, value AS price, event_type AS source, event_id AS quote_id FROM events)"""


def r6(expr: str, name: str) -> str:
    return f"floor(({expr}) * 1e6 + 0.5003) / 1e6 AS {name}"


def roll(fn: str, c: str, n: int, w: str = "w") -> str:
    """Rolling aggregate with the minimum-period rule, over a named window's partition/order."""
    frame = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({c}) {frame} = {n} THEN {fn}({c}) {frame} END)"


def lag(c: str, k: int = 1) -> str:
    return f"lag({c}, {k}) OVER (PARTITION BY symbol ORDER BY date)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"
