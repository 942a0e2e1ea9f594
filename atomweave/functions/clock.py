"""Stamps YYYY-MM-DDTHH:MM:SS.mmmZ and spans between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORM = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
STAMP = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?(?:Z|\+00:00)?$"


def parse_millis(stamp: Column) -> Column:
    """Milliseconds since 1970 of a stamp in any accepted spelling; null where it is none."""
    s = F.trim(stamp)
    frac = F.rpad(F.substring(F.regexp_extract(s, STAMP, 3), 1, 3), 3, "0")
    day = F.concat_ws(" ", F.regexp_extract(s, STAMP, 1), F.regexp_extract(s, STAMP, 2))
    seconds = F.unix_seconds(F.try_to_timestamp(F.concat(day, F.lit(" +0000")), F.lit("yyyy-MM-dd HH:mm:ss Z")))
    return F.when(s.rlike(STAMP), seconds * 1000 + frac.cast("long"))


def format_millis(ms: Column) -> Column:
    """The canonical stamp of milliseconds, whatever the session's time zone."""
    at = F.timestamp_millis(ms.cast("long"))
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), FORM)


def canonicalize(stamp: Column) -> Column:
    """A stamp in its canonical spelling; one that does not parse stays as it is."""
    return F.coalesce(format_millis(parse_millis(stamp)), stamp)


def shift(stamp: Column, seconds: Column | float) -> Column:
    seconds = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return format_millis(parse_millis(stamp) + (seconds * 1000).cast("long"))


def elapsed_days(start: Column, end: Column) -> Column:
    """Days between two stamps, no less than 0; 0 where either does not parse."""
    days = (parse_millis(end) - parse_millis(start)) / F.lit(86_400_000.0)
    return F.coalesce(F.greatest(days, F.lit(0.0)), F.lit(0.0))


def days_between(start: Column, end: Column) -> Column:
    """elapsed_days of timestamp columns."""
    days = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86_400_000_000.0)
    return F.coalesce(F.greatest(days, F.lit(0.0)), F.lit(0.0))
