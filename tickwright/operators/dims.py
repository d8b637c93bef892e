"""Symbol index (dimension) maintenance. Symbols compare case-insensitively."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwright.functions.scalar import currency_for_category
from tickwright.schema import DIM_COLUMNS, MASTER_COLUMNS

KEY = "_key"


def keyed(df: DataFrame, c: str = "symbol") -> DataFrame:
    return df.withColumn(KEY, F.upper(F.trim(F.col(c))))


def unique_by_key(df: DataFrame) -> DataFrame:
    """One row per upper-case symbol (smallest row), combined on the map side."""
    k = keyed(df)
    rest = [c for c in k.columns if c != KEY]
    return k.groupBy(KEY).agg(F.min(F.struct(*rest)).alias("_r")).select(KEY, "_r.*")


def _col(df: DataFrame, name: str, default):
    empty_is_missing = F.nullif(F.trim(F.col(name)), F.lit("")) if name in df.columns else F.lit(None)
    return F.coalesce(empty_is_missing, default).alias(name)


def dim_insert_if_absent(dim: DataFrame, new: DataFrame) -> DataFrame:
    """Adds unknown symbols with default metadata."""
    fresh = unique_by_key(new).join(keyed(dim).select(KEY), KEY, "left_anti")
    rows = fresh.select(
        F.upper(F.trim("symbol")).alias("symbol"),
        _col(fresh, "company_name", F.upper(F.trim(F.col("symbol")))),
        _col(fresh, "sector", F.lit("N/A")),
        _col(fresh, "market_cap", F.lit("")),
        _col(fresh, "headquarters", F.lit("N/A")),
        _col(fresh, "exchange", F.lit("N/A")),
        _col(fresh, "currency", currency_for_category("category")),
        _col(fresh, "isin", F.lit("")),
        F.col("category"),
    )
    return dim.select(*DIM_COLUMNS, "category").unionByName(rows)


def dim_sync_from_facts(dim: DataFrame, facts: DataFrame, master: DataFrame) -> DataFrame:
    """Adds every fact symbol the dimension lacks, with metadata from ``master`` or Unknown."""
    seen = keyed(facts.select("symbol").distinct()).groupBy(KEY).agg(F.min("symbol").alias("symbol"))
    missing = seen.join(keyed(dim).select(KEY), KEY, "left_anti")
    source = unique_by_key(master)
    found = missing.join(source.drop("symbol"), KEY, "left")
    rows = found.select(
        "symbol",
        *[
            _col(found, c, F.lit("Unknown") if c != "company_name" else F.col("symbol"))
            for c in ("company_name", "sector", "market_cap", "headquarters", "exchange")
        ],
        _col(found, "currency", F.lit("Unknown")),
        _col(found, "isin", F.lit("")),
        "category",
    )
    return dim.select(*DIM_COLUMNS, "category").unionByName(rows)


def dim_restrict_and_fill(dim: DataFrame, symbols: DataFrame, default_exchange: str) -> DataFrame:
    """Exactly the listed symbols; those unknown get sector Unknown and the default exchange."""
    wanted = symbols.select("symbol").distinct()
    joined = wanted.join(dim.select(*DIM_COLUMNS), "symbol", "left")
    return joined.select(
        "symbol",
        F.coalesce("company_name", "symbol").alias("company_name"),
        F.coalesce("sector", F.lit("Unknown")).alias("sector"),
        F.coalesce("market_cap", F.lit("")).alias("market_cap"),
        F.coalesce("headquarters", F.lit("Unknown")).alias("headquarters"),
        F.coalesce("exchange", F.lit(default_exchange)).alias("exchange"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in DIM_COLUMNS[6:]],
    )


def dim_is_small(dim: DataFrame, least: int = 400) -> bool:
    """Whether an index has too few rows to be trusted."""
    return dim.limit(least).count() < least


def dim_bootstrap(dim: DataFrame, master: DataFrame, category: str, rebuild: bool) -> DataFrame:
    """``dim`` as it is, or, on ``rebuild``, the index made from the master columns."""
    missing = [c for c in MASTER_COLUMNS if c not in master.columns]
    if missing:
        raise ValueError(f"master index lacks columns: {missing}")
    rebuilt = master.select(
        *MASTER_COLUMNS, currency_for_category(F.lit(category)).alias("currency"), F.lit("").alias("isin")
    )
    return (rebuilt if rebuild else dim).select(*DIM_COLUMNS)


def dim_guard_no_shrink(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: both counts and whether the new dimension may replace the old one."""
    sides = old.select(F.lit(0).alias("s")).unionByName(new.select(F.lit(1).alias("s")))
    return sides.agg(
        F.count_if(F.col("s") == 0).alias("old_rows"), F.count_if(F.col("s") == 1).alias("new_rows")
    ).withColumn("ok", F.col("new_rows") >= F.col("old_rows"))


def dim_update_isin(dim: DataFrame, corrections: DataFrame) -> DataFrame:
    """Applies ISIN corrections; ``updated`` marks the rows that changed."""
    fix = unique_by_key(corrections).select(KEY, F.col("isin").alias("_isin"))
    joined = keyed(dim).join(fix, KEY, "left")
    changed = F.col("_isin").isNotNull() & (F.coalesce("isin", F.lit("")) != F.col("_isin"))
    keep = [c for c in dim.columns if c != "isin"]
    return joined.select(
        *keep, F.coalesce("_isin", "isin").alias("isin"), changed.alias("updated")
    )


def isin_not_found(dim: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections whose symbol the dimension lacks."""
    return keyed(corrections).join(keyed(dim).select(KEY), KEY, "left_anti").drop(KEY)


def dim_lookup(symbols: DataFrame, dim: DataFrame) -> DataFrame:
    """Metadata per symbol, NULL where unknown (left equi join on the upper-case symbol)."""
    meta = unique_by_key(dim.drop("category") if "category" in symbols.columns else dim).drop("symbol")
    return keyed(symbols).join(meta, KEY, "left").drop(KEY)


def resolve_isin(symbols: DataFrame, fixed: dict[str, str], dim: DataFrame, instruments: DataFrame) -> DataFrame:
    """First non-empty ISIN of the fixed map, the dimension and the instruments."""
    s = keyed(symbols.select("symbol").distinct())
    d = unique_by_key(dim.select("symbol", "isin")).select(KEY, F.col("isin").alias("_d"))
    i = unique_by_key(instruments.select("symbol", "isin")).select(KEY, F.col("isin").alias("_i"))
    known = F.lit(None).cast("string")
    if fixed:
        pairs = F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv])
        known = F.try_element_at(pairs, F.col(KEY))
    isin = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (known, F.col("_d"), F.col("_i"))])
    return (
        s.join(d, KEY, "left")
        .join(i, KEY, "left")
        .select("symbol", F.when(isin.isNotNull(), F.concat_ws("|", F.lit("NSE_EQ"), isin)).alias("instrument_key"))
    )


def dim_audit(dim: DataFrame) -> DataFrame:
    """Rows, ISIN coverage, column order and currency check per category."""
    ordered = dim.columns[: len(DIM_COLUMNS)] == DIM_COLUMNS
    filled = F.count_if(F.length(F.trim("isin")) > 0)
    expected = currency_for_category("category")
    return dim.groupBy("category").agg(
        F.count(F.lit(1)).alias("row_count"),
        (filled * F.lit(100.0) / F.count(F.lit(1))).alias("isin_coverage"),
        F.bool_and(F.col("currency") == expected).alias("currency_ok"),
        F.lit(ordered).alias("columns_ok"),
    )


def isin_format_valid(c="isin"):
    """Twelve characters starting with INE."""
    return (F.length(c) == 12) & F.col(c).startswith("INE")


def isin_sample(dim: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of ``n`` rows with the format flag (top-n by hash, no full sort)."""
    h = F.xxhash64(F.lit(seed), "symbol")
    return (
        dim.where(F.length("isin") > 0)
        .orderBy(h, "symbol")
        .limit(n)
        .select("symbol", "isin", isin_format_valid().alias("valid"))
    )


def find_orphans(facts: DataFrame, dim: DataFrame) -> DataFrame:
    """Fact symbols without a dimension row."""
    seen = keyed(facts.select("symbol").distinct())
    return seen.join(keyed(dim).select(KEY), KEY, "left_anti").select("symbol")


def completeness_report(symbols: DataFrame, bars: DataFrame, min_rows: int = 100) -> DataFrame:
    """Per listed symbol: present, row count, enough rows, needs download."""
    counts = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return (
        symbols.select("symbol")
        .distinct()
        .join(counts, "symbol", "left")
        .select(
            "symbol",
            F.col("_n").isNotNull().alias("file_exists"),
            n.alias("row_count"),
            (n >= min_rows).alias("valid"),
            (n < min_rows).alias("needs_download"),
        )
    )


def freshness_report(symbols: DataFrame, bars: DataFrame, as_of, max_age: int = 7) -> DataFrame:
    """Per listed symbol: rows, last date and whether it is recent on ``as_of``."""
    stats = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), F.max("date").alias("last_date"))
    recent = F.coalesce(F.date_diff(F.lit(as_of).cast("date"), F.col("last_date")) <= max_age, F.lit(False))
    return (
        symbols.select("symbol")
        .distinct()
        .join(stats, "symbol", "left")
        .select(
            "symbol",
            F.coalesce("_n", F.lit(0)).alias("row_count"),
            "last_date",
            recent.alias("recent"),
            (~recent).alias("needs_download"),
        )
    )
