"""Date and event-time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

# Accepted textual date layouts, tried in this order.
DATE_FORMATS = ("M/d/yyyy", "yyyy-MM-dd", "M/d/yyyy H:mm", "yyyy-MM-dd HH:mm:ss")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c, formats=DATE_FORMATS) -> Column:
    """P5: text to DATE; the first layout that parses wins, otherwise NULL."""
    c = _c(c)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in formats])


def parse_utc_timestamp(c) -> Column:
    """Text with an optional offset, read as an instant, kept in UTC
    (the session time zone is pinned to UTC)."""
    c = _c(c)
    return F.coalesce(
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ssXXX")),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(c, F.lit("M/d/yyyy")),
    )


def instant_micros(c, is_date: bool) -> Column:
    """Epoch microseconds of a DATE (its UTC midnight) or a TIMESTAMP; no
    session time zone enters either form."""
    c = _c(c)
    if is_date:
        return F.unix_date(c).cast("long") * F.lit(MICROS_PER_DAY)
    return F.unix_micros(c)


def days_between(later, earlier, later_is_date: bool = True, earlier_is_date: bool = False) -> Column:
    """Signed whole days from ``earlier`` to ``later``, rounded down
    (half a day before the event is day -1). DATE inputs count as UTC
    midnight."""
    a = instant_micros(later, later_is_date)
    b = instant_micros(earlier, earlier_is_date)
    return F.floor((a - b) / F.lit(float(MICROS_PER_DAY))).cast("int")


def utc_midnight(date_col) -> Column:
    """TIMESTAMP at the UTC midnight of a DATE, whatever the session zone."""
    return F.timestamp_seconds(F.unix_date(_c(date_col)).cast("long") * F.lit(86400))


def season_of_month(month) -> Column:
    """12,1,2 -> 0; 3-5 -> 1; 6-8 -> 2; 9-11 -> 3."""
    return F.floor(F.pmod(_c(month), F.lit(12)) / F.lit(3)).cast("int")


def flag(cond: Column) -> Column:
    """P10: boolean to 0/1 integer (NULL stays NULL)."""
    return cond.cast("int")
