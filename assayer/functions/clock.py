"""Explicit "now": every operator takes ``as_of`` instead of reading the wall clock.

A literal instant lets Catalyst fold the date filters into the scan, and makes a
run repeatable when a lost executor forces tasks to be computed again.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

AsOf = str | datetime | date


def instant(as_of: AsOf) -> Column:
    """``as_of`` as a zone-free timestamp literal."""
    return F.lit(str(as_of)).cast("timestamp_ntz")


def day(as_of: AsOf) -> Column:
    """The calendar day of ``as_of``."""
    return F.to_date(instant(as_of))


def start_of_day(as_of: AsOf) -> Column:
    """Midnight of ``as_of``'s day as a zone-free timestamp."""
    return F.to_date(instant(as_of)).cast("timestamp_ntz")


def days_before(as_of: AsOf, days: int) -> Column:
    """The instant ``days`` whole days before ``as_of``."""
    return instant(as_of) - F.make_dt_interval(F.lit(int(days)))


def batch_id(as_of: AsOf) -> Column:
    """Load batch label ``BATCH_yyyyMMdd_HHmmss``."""
    return F.concat(F.lit("BATCH_"), F.date_format(instant(as_of), "yyyyMMdd_HHmmss"))
