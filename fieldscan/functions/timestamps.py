"""Zone-checked timestamps, UTC day keys and elapsed time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = r"(Z|[+-]\d\d:?\d\d)$"
MICROS_PER_DAY = 86_400_000_000


def zoned_timestamp(text: Column, require_time: bool = True) -> Column:
    """ISO-8601 text with an explicit zone as a timestamp; NULL otherwise.

    Spark alone reads zone-less text in the session zone, so the zone is
    checked on the text first.
    """
    pattern = ("T.*" if require_time else "") + ZONE
    return F.when(text.rlike(pattern), F.try_to_timestamp(text))


def iso_utc(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def calendar_utc(text: Column) -> Column:
    """Form input ``yyyy-MM-ddTHH:mm[:ss]``, read as UTC; impossible dates give NULL."""
    full = F.when(F.length(text) == 16, F.concat(text, F.lit(":00"))).otherwise(text)
    parsed = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?$"),
                    F.try_to_timestamp(F.concat(full, F.lit("Z"))))
    return F.when(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss") == full, parsed)


def utc_day(instant: Column) -> Column:
    return F.to_date(instant)


def gap_micros(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier)


def valid_range(start: Column, end: Column) -> Column:
    """Both ends present and in order (the range is inclusive)."""
    return F.coalesce(start <= end, F.lit(False))
