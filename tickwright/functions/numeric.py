"""Guards for NULL, NaN, infinity and division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_not_finite(c) -> Column:
    """NaN and the infinities become NULL (S1)."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def nan_to_num(c, nan: float = 0.0, posinf: float = 1e6, neginf: float = -1e6) -> Column:
    """Replace NULL/NaN and the infinities by finite numbers."""
    c = col(c).cast("double")
    return (
        F.when(c.isNull() | F.isnan(c), F.lit(nan))
        .when(c == F.lit(float("inf")), F.lit(posinf))
        .when(c == F.lit(float("-inf")), F.lit(neginf))
        .otherwise(c)
    )


def ratio(num, den, fill: float | None = None) -> Column:
    """``num / den`` that yields NULL (or ``fill``) for a zero or NULL denominator (S3, S4)."""
    out = F.try_divide(col(num), col(den))
    return out if fill is None else F.coalesce(out, F.lit(fill))


def clip(c, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def piecewise(c, pieces, otherwise: Column) -> Column:
    """A ``when`` ladder: first piece whose upper bound holds ``c``."""
    c = col(c)
    out = None
    for upper, value in pieces:
        out = F.when(c <= F.lit(upper), value) if out is None else out.when(c <= F.lit(upper), value)
    return out.otherwise(otherwise)


def r6(c) -> Column:
    """The one agreed rounding of reported doubles (S10).

    Half up on the scaled value with a small nudge, so that decimal ties, which two engines
    may hold as neighbouring doubles, land on the same side everywhere.
    """
    return F.floor(col(c) * F.lit(1e6) + F.lit(0.5003)) / F.lit(1e6)


def round_to(c, digits: int) -> Column:
    """Half-up rounding for stored money, score and accuracy columns."""
    scale = 10.0**digits
    return F.floor(col(c) * F.lit(scale) + F.lit(0.5000001)) / F.lit(scale)
