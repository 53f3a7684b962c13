"""Error predicates: boolean columns that are true for rows that break a rule.

NULL passes every format rule (completeness is a rule of its own), so each
predicate is written to be NULL or false for a NULL input.  Only ``try_*``
casts are used: raw text must never abort a job under ANSI mode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.clock import AsOf, day

# Patterns, lists and bounds that results depend on.
EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"
PHONE_PATTERN = r"^\+?[0-9]{1,4}[-.\s]?[0-9]{3,4}[-.\s]?[0-9]{4}\z"
COUNTRIES = (
    "USA", "Canada", "UK", "Mexico", "India", "Australia", "Germany", "France", "Japan", "China",
)
CURRENCIES_CORE = ("USD", "EUR", "GBP", "CAD", "JPY", "AUD", "CHF", "CNY", "INR", "MXN")
CURRENCIES = CURRENCIES_CORE + ("BRL", "NZD", "SEK")
EARLIEST_DATE = "1900-01-01"


def as_number(c: Column, scale: int = 0) -> Column:
    """Parse to a fixed-scale number; scale 0 rounds half up to whole numbers."""
    return c.try_cast(f"decimal(38,{scale})")


def as_date(c: Column, formats: Sequence[str] = ()) -> Column:
    """Parse to a date: the default cast first, then each extra pattern."""
    parsed = c.try_cast("date")
    if not formats:
        return parsed
    return F.coalesce(parsed, *[F.try_to_date(c, f) for f in formats])


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def missing(c: Column) -> Column:
    return c.isNull()


def any_missing(cols: Sequence[Column]) -> Column:
    broken = cols[0].isNull()
    for c in cols[1:]:
        broken = broken | c.isNull()
    return broken


def not_email(c: Column) -> Column:
    return ~c.cast("string").rlike(EMAIL_PATTERN)


def not_phone(c: Column) -> Column:
    return ~c.cast("string").rlike(PHONE_PATTERN)


def not_date(c: Column, formats: Sequence[str] = ()) -> Column:
    return c.isNotNull() & as_date(c, formats).isNull()


def not_number(c: Column, scale: int = 0) -> Column:
    return c.isNotNull() & as_number(c, scale).isNull()


def not_positive(c: Column, scale: int = 0) -> Column:
    n = as_number(c, scale)
    return c.isNotNull() & (n.isNull() | (n <= 0))


def negative(c: Column, scale: int = 0) -> Column:
    n = as_number(c, scale)
    return c.isNotNull() & (n.isNull() | (n < 0))


def not_in(c: Column, allowed: Sequence[str]) -> Column:
    """Outside the allowed list; an unknown list falls back to the empty string."""
    return ~c.cast("string").isin(list(allowed) or [""])


def outside_date_range(c: Column, as_of: AsOf, formats: Sequence[str] = ()) -> Column:
    d = as_date(c, formats)
    return c.isNotNull() & (
        d.isNull() | (d > day(as_of)) | (d < F.lit(EARLIEST_DATE).cast("date"))
    )


def older_than(c: Column, as_of: AsOf, max_age_days: int, formats: Sequence[str] = ()) -> Column:
    """Dated more than ``max_age_days`` before ``as_of``; unreadable dates pass."""
    return as_date(c, formats) < F.date_sub(day(as_of), int(max_age_days))
