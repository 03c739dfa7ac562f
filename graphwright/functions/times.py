"""Times of records: truncation, periods and textual forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"second": 1_000_000, "millisecond": 1000, "microsecond": 1}


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less time, whatever the session's zone."""
    start = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", start, ts.cast("timestamp_ntz"))


def epoch_s(ts: Column) -> Column:
    """Whole seconds since 1970, truncated."""
    return F.floor(epoch_us(ts) / 1_000_000).cast("long")


def in_period(ts: Column, low: Column | None, high: Column | None, unit: str = "second") -> Column:
    """Whether ts lies between both ends, all truncated to the unit; both ends count."""
    size = _UNITS[unit]

    def cut(c: Column) -> Column:
        return F.floor(epoch_us(c) / size)

    out = F.lit(True)
    if low is not None:
        out = out & (cut(ts) >= cut(low))
    if high is not None:
        out = out & (cut(ts) <= cut(high))
    return F.coalesce(out, F.lit(False))


def access_time(text: Column) -> Column:
    """Instant of 02/Jan/2006:15:04:05 -0700; null unless the offset is a real one."""
    ok = text.rlike(r"^\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-](0\d|1\d|2[0-3])[0-5]\d$")
    return F.when(ok, F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss xx")))


def header_time(text: Column) -> Column:
    """Instant of 01/02/2006 15:04:05.000 -0700."""
    return F.try_to_timestamp(text, F.lit("MM/dd/yyyy HH:mm:ss.SSS xx"))


def audit_time(line: Column) -> Column:
    """Instant of audit(seconds.milliseconds:serial)."""
    s = F.regexp_extract(line, r"audit\((\d+)\.(\d{3}):(\d+)\)", 1)
    ms = F.regexp_extract(line, r"audit\((\d+)\.(\d{3}):(\d+)\)", 2)
    return F.when(s != "", F.timestamp_millis(s.cast("long") * 1000 + ms.cast("long")))


def precision_of_fraction(digits: Column) -> Column:
    """Precision that a fraction of so many digits has; it is truncated to that."""
    return F.when(digits >= 6, "microsecond").when(digits >= 3, "millisecond").otherwise("second")


def interpreted(local: Column, offset_minutes: Column) -> Column:
    """Instant (zone-less, UTC) of a local time under a UTC offset within 18 hours."""
    shifted = F.timestamp_add("MINUTE", -offset_minutes, local)
    return F.when(F.abs(offset_minutes) <= 18 * 60, shifted)


def constraint(ts: Column, precision: Column) -> tuple[Column, Column]:
    """First and last microsecond that a time of a precision can stand for."""
    # fixed values: lengths in microseconds
    width = (
        F.when(precision == "minute", 60_000_000)
        .when(precision == "second", 1_000_000)
        .when(precision == "millisecond", 1000)
        .otherwise(1)
    )
    low = F.floor(epoch_us(ts) / width) * width
    return low.cast("long"), (low + width - 1).cast("long")
