"""Scalar column functions: dates, validity checks, currency, formatting, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.functions.numeric import col
from tickwright.schema import COLUMN_VARIANTS, FALLBACK_USD_INR, HORIZON_DAYS, IND_NAME_PARTS


def standardize_columns(df: DataFrame) -> DataFrame:
    """Known header variants to their standard names, everything in lower case."""
    return df.toDF(*[COLUMN_VARIANTS.get(c, c).lower() for c in df.columns])


def bar_date(c) -> Column:
    """Exchange-local calendar date of a date or timestamp text; the offset is not applied."""
    return F.substr(col(c), F.lit(1), F.lit(10)).try_cast("date")


def valid_symbol(c) -> Column:
    return F.coalesce(F.length(F.trim(col(c))).between(1, 10), F.lit(False))


def valid_price(c) -> Column:
    return F.coalesce(col(c).try_cast("double") > 0, F.lit(False))


def valid_date_string(c) -> Column:
    """``yyyy-mm-dd`` (one or two digits for month and day) and a real date."""
    shaped = col(c).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    return F.coalesce(shaped & col(c).try_cast("date").isNotNull(), F.lit(False))


def clean_metadata(c) -> Column:
    v = F.trim(col(c))
    bad = v.isNull() | F.lower(v).isin("", "nan", "none", "null")
    return F.when(bad, F.lit("N/A")).otherwise(v)


def base_symbol(c) -> Column:
    return F.split_part(F.upper(F.trim(col(c))), F.lit("."), F.lit(1))


def categorize_symbol(df: DataFrame, dim: DataFrame, c: str = "symbol", out: str = "category") -> DataFrame:
    """Listing category: suffix, then index membership (Indian first), then name parts, else US."""
    members = (
        dim.groupBy(F.col("symbol").alias("_base"))
        .agg(F.min("category").alias("_member"))  # ind_stocks sorts before us_stocks
    )
    up = F.upper(F.trim(F.col(c)))
    base = base_symbol(c)
    parts = base.rlike("|".join(IND_NAME_PARTS)) & (F.length(base) >= 3)
    value = (
        F.when(up.endswith(".NS") | up.endswith(".BO"), F.lit("ind_stocks"))
        .when(up.endswith(".US"), F.lit("us_stocks"))
        .when(F.col("_member").isNotNull(), F.col("_member"))
        .when(parts, F.lit("ind_stocks"))
        .otherwise(F.lit("us_stocks"))
    )
    return (
        df.withColumn("_base", base).join(members, "_base", "left").withColumn(out, value).drop("_base", "_member")
    )


def categorize_simple(c) -> Column:
    """Upper-case symbols without a dot are Indian, the rest US."""
    c = col(c)
    upper = (c == F.upper(c)) & c.rlike("[A-Za-z]")
    return F.when(upper & ~c.contains("."), F.lit("ind_stocks")).otherwise(F.lit("us_stocks"))


def exchange_ticker(c) -> Column:
    return F.concat(F.split_part(col(c), F.lit("."), F.lit(1)), F.lit(".NS"))


def currency_for_category(c) -> Column:
    c = col(c)
    return F.when(c == "ind_stocks", F.lit("INR")).otherwise(F.lit("USD"))


def convert_usd_inr(amount, rate) -> Column:
    return F.when(col(amount) <= 0, F.lit(0.0)).otherwise(col(amount) * rate)


def convert_inr_usd(amount, rate) -> Column:
    return F.when(col(amount) <= 0, F.lit(0.0)).otherwise(col(amount) / rate)


def convert_price(price, source, target, rate=None) -> Column:
    """NULL and NaN give 0; unknown currency pairs stay unchanged."""
    p, s, t = col(price), col(source), col(target)
    r = F.lit(FALLBACK_USD_INR) if rate is None else F.coalesce(rate, F.lit(FALLBACK_USD_INR))
    return (
        F.when(p.isNull() | F.isnan(p), F.lit(0.0))
        .when(s == t, p)
        .when((s == "USD") & (t == "INR"), p * r)
        .when((s == "INR") & (t == "USD"), p / r)
        .otherwise(p)
    )


def format_price(price, currency) -> Column:
    """``$%.2f``, rupees with plain digits, or ``%.2f CUR``; missing prices give zero."""
    p, c = col(price), col(currency)
    text = F.format_string("%.2f", F.coalesce(F.when(~F.isnan(p), p), F.lit(0.0)))
    return (
        F.when(c == "USD", F.concat(F.lit("$"), text))
        .when(c == "INR", F.concat(F.lit("₹"), text))
        .otherwise(F.concat(text, F.lit(" "), c))
    )


def format_price_grouped(price) -> Column:
    """Rupees with lakh grouping: the last three digits, then groups of two."""
    p = col(price)
    text = F.format_string("%.2f", F.coalesce(F.when(~F.isnan(p), p), F.lit(0.0)))
    return F.concat(F.lit("₹"), F.regexp_replace(text, r"(?<=\d)(?=(\d\d)*\d{3}\.)", ","))


def horizon_days(h, strict: bool = False) -> Column:
    """Calendar days of a horizon, any case; unknown is 1, or an error when ``strict``."""
    days = F.create_map(*[F.lit(x) for kv in HORIZON_DAYS.items() for x in kv])
    found = F.try_element_at(days, F.upper(col(h)))
    if strict:
        return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown horizon "), col(h))).cast("int"))
    return F.coalesce(found, F.lit(1))


def prediction_date(h, as_of) -> Column:
    return F.date_add(F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of, horizon_days(h))


def horizons() -> Column:
    """The five horizons as an array of (horizon, days), for ``inline``."""
    return F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(d).alias("days")) for h, d in HORIZON_DAYS.items()])


def change(predicted, current) -> Column:
    return col(predicted) - col(current)


def change_pct(predicted, current) -> Column:
    p, c = col(predicted), col(current)
    return F.when(c == 0, F.lit(0.0)).otherwise((p - c) / F.nullif(c, F.lit(0.0)) * F.lit(100.0))


def confidence_band(c, high: float = 61.0, medium: float = 31.0) -> Column:
    c = col(c)
    return (
        F.when(c.isNull(), F.lit("none"))
        .when(c >= high, F.lit("high"))
        .when(c >= medium, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def quote_json(symbol, price, company) -> Column:
    """JSON text of a quote: upper-case symbol, numeric price, company defaulting to the symbol."""
    up = F.upper(F.trim(col(symbol)))
    return F.to_json(
        F.struct(
            up.alias("symbol"),
            col(price).cast("double").alias("price"),
            F.coalesce(F.nullif(F.trim(col(company)), F.lit("")), up).alias("company_name"),
        )
    )


def encode_categories(c, codes: dict[str, float], default: float = 0.0) -> Column:
    """Text codes as doubles; unknown text gets ``default``."""
    table = F.create_map(*[F.lit(x) for k, v in codes.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, col(c)), F.lit(default))
