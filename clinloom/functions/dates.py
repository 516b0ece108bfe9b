"""Date/time expressions (D-1, D-2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# DICOM study date ("yyyyMMdd") and time: hours, minutes and seconds as far as given,
# with an optional fraction of any length.
STUDY_FORMAT = "yyyyMMdd HHmmss.SSSSSS"
TIME_PATTERN = r"^(\d{2}(?:\d{2}(?:\d{2})?)?)(?:\.(\d+))?$"


def study_timestamp(date: Column, time: Column, on_error: str = "fail") -> Column:
    """D-1: join the DICOM date and time strings and parse them.

    ``03``, ``0315``, ``031500`` and ``031500.25`` are all valid times; digits beyond
    microseconds are cut.  A null date or time gives null.  Anything else that does not
    parse fails the job, or becomes null with ``on_error='null'``.
    """
    if on_error not in ("fail", "null"):
        raise ValueError("on_error must be 'fail' or 'null'")
    clock = F.rpad(F.regexp_extract(time, TIME_PATTERN, 1), 6, "0")
    fraction = F.rpad(F.substring(F.regexp_extract(time, TIME_PATTERN, 2), 1, 6), 6, "0")
    known = F.when(time.rlike(TIME_PATTERN) & date.rlike(r"^\d{8}$"),
                   F.concat(date, F.lit(" "), clock, F.lit("."), fraction))
    parsed = F.try_to_timestamp(known, F.lit(STUDY_FORMAT)).cast("timestamp_ntz")
    if on_error == "null":
        return parsed
    bad = parsed.isNull() & date.isNotNull() & time.isNotNull()
    return F.when(bad, F.raise_error(F.concat(F.lit("not a study time: "), date, F.lit(" "), time))
                  .cast("timestamp_ntz")).otherwise(parsed)


def to_day(ts: Column) -> Column:
    """D-2: calendar day of a timestamp."""
    return F.to_date(ts)


def iso(ts: Column) -> Column:
    """Render a timestamp as ``yyyy-MM-dd HH:mm:ss.SSSSSS`` (sink / comparison form)."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
