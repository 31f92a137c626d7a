"""Time expressions. Inputs are timestamps without zone; the session zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Output formats.
STORED_FORMAT = "yyyy-MM-dd HH:mm:ss"
DISPLAY_FORMAT = "MMMM dd, yyyy 'at' hh:mm a"

DAY = 86400


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, rounded down."""
    return F.floor((_micros(end) - _micros(start)) / F.lit(1000000))


def _parts(start: Column, end: Column) -> tuple[Column, Column, Column]:
    secs = seconds_between(start, end)
    rest = F.pmod(secs, F.lit(DAY))
    return (
        F.floor(secs / DAY),
        F.floor(rest / 3600),
        F.floor((rest % 3600) / 60),
    )


def period_string(start: Column, end: Column) -> Column:
    """``"1 days 3 hours 4 minutes"``; null when either end is null.

    Days are rounded down, so a negative period has negative days and a
    positive rest.
    """
    days, hours, minutes = _parts(start, end)
    text = F.format_string("%d days %d hours %d minutes", days, hours, minutes)
    return F.when(start.isNotNull() & end.isNotNull(), text)


def _counted(n: Column, unit: str) -> Column:
    plural = F.when(n == 1, F.lit(unit)).otherwise(F.lit(unit + "s"))
    return F.when(n > 0, F.concat_ws(" ", n.cast("string"), plural))


def gap_string(start: Column, end: Column) -> Column:
    """``"1 day, 3 hours, 4 minutes"``: zero parts left out, null without both ends."""
    days, hours, minutes = _parts(start, end)
    text = F.concat_ws(", ", _counted(days, "day"), _counted(hours, "hour"), _counted(minutes, "minute"))
    text = F.when(text == "", F.lit("less than a minute")).otherwise(text)
    return F.when(start.isNotNull() & end.isNotNull(), text)


def parse_ts(text: Column) -> Column:
    """Timestamp from text; text that is no timestamp becomes null."""
    return text.try_cast("timestamp_ntz")


def format_ts(ts: Column) -> Column:
    return F.date_format(ts, STORED_FORMAT)


def display_ts(ts: Column) -> Column:
    """``"March 05, 2150 at 01:30 PM"``."""
    return F.date_format(ts, DISPLAY_FORMAT)


def date_key(ts: Column) -> Column:
    return F.to_date(ts)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th … with 11th to 13th."""
    suffix = (
        F.when((n % 100).between(11, 13), F.lit("th"))
        .when(n % 10 == 1, F.lit("st"))
        .when(n % 10 == 2, F.lit("nd"))
        .when(n % 10 == 3, F.lit("rd"))
        .otherwise(F.lit("th"))
    )
    return F.concat(n.cast("string"), suffix)
