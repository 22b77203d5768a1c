"""Exact money and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


# From here on every double is a whole number.
WHOLE_FROM = 2.0**53


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(price: Column | str) -> Column:
    """Price as whole cents, so that sums are exact and independent of row order."""
    return F.round(col(price) * 100).cast("bigint")


def from_cents(c: Column | str) -> Column:
    return col(c).cast("double") / 100


def _rounded(x: Column, digits: int, how) -> Column:
    """Rounded as a decimal where doubles have a fraction at all; larger ones are whole as they are."""
    plain = x.cast("double")
    return F.when(F.abs(plain) < WHOLE_FROM, how(x.cast(DecimalType(30, 12)), digits).cast("double")).otherwise(plain)


def half_up(x: Column | str, digits: int = 0) -> Column:
    """Round half away from zero, as SQL numeric does; result is a double."""
    return _rounded(col(x), digits, F.round)


def half_even(x: Column | str, digits: int = 0) -> Column:
    """Round half to even, as dataframe libraries do; result is a double."""
    if digits == 0:
        return F.rint(col(x).cast("double"))
    return _rounded(col(x), digits, F.bround)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double; null where b is zero."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def percent(a: Column | str, b: Column | str, digits: int = 2) -> Column:
    return half_up(ratio(a, b) * 100, digits)


def growth_percent(now: Column | str, before: Column | str, digits: int = 2) -> Column:
    """(now / before - 1) * 100; null for the first period."""
    return half_up((ratio(now, before) - 1) * 100, digits)


def try_number(text: Column | str, kind: str = "double") -> Column:
    """Decimal comma, blanks and stray letters repaired; unparsable text becomes null.

    Texts are repaired before the cast, as every failing cast costs an exception.
    """
    repaired = F.regexp_replace(F.translate(col(text), ",", "."), r"[^0-9.\-]", "")
    return F.nullif(repaired, F.lit("")).try_cast(kind)
