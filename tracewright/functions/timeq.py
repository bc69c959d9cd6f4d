"""Event time as long nanoseconds, and civil buckets derived from it.

Event time never goes through a timestamp, which has microseconds only; calendar functions work on whole seconds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def nanos(ts: Column) -> Column:
    """Nanoseconds since 1970 of a timestamp without time zone, read as UTC (the session's time zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def floor_div(x: Column, width: int) -> Column:
    """Floor division of longs by a positive width; ``div`` truncates towards zero, so the remainder goes first."""
    return F.call_function("div", x - F.pmod(x, F.lit(width).cast("long")), F.lit(width).cast("long"))


def local_second(ns: Column, offset_s: int = 0) -> Column:
    """Seconds since 1970 on a clock that is ``offset_s`` ahead of UTC."""
    return floor_div(ns, SECOND) + offset_s


def hour_of_day(ns: Column, offset_s: int = 0) -> Column:
    return floor_div(F.pmod(local_second(ns, offset_s), F.lit(86_400).cast("long")), 3600).cast("int")


def civil_day(ns: Column, offset_s: int = 0) -> Column:
    """Days since 1970-01-01."""
    return floor_div(local_second(ns, offset_s), 86_400)


def weekday_monday(ns: Column, offset_s: int = 0) -> Column:
    """0 is Monday; 1970-01-01 was a Thursday."""
    return F.pmod(civil_day(ns, offset_s) + 3, F.lit(7).cast("long")).cast("int")


def weekday_sunday(ns: Column, offset_s: int = 0) -> Column:
    """0 is Sunday."""
    return F.pmod(civil_day(ns, offset_s) + 4, F.lit(7).cast("long")).cast("int")


def hour_of_week(ns: Column, offset_s: int = 0) -> Column:
    """0 is Sunday 00:00, 167 is Saturday 23:00."""
    return weekday_sunday(ns, offset_s) * 24 + hour_of_day(ns, offset_s)


def week_start_day(ns: Column, offset_s: int = 0) -> Column:
    """Days since 1970 of the Monday of the week."""
    return civil_day(ns, offset_s) - weekday_monday(ns, offset_s)
