"""Times: ISO-8601 texts, elapsed seconds, what is left of a break."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parsed_time(c: Column | str) -> Column:
    """Timestamp of an ISO-8601 text; null for what is none."""
    return _col(c).cast("string").try_cast("timestamp")


def iso_text(c: Column | str) -> Column:
    """ISO-8601 text of a timestamp in UTC, with microseconds."""
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), _col(c).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def elapsed_seconds(start: Column | str, end: Column | str) -> Column:
    """Seconds between two ISO-8601 texts or timestamps, with fractions; null if either is."""
    micros = lambda c: F.unix_micros(parsed_time(c))
    return (micros(end) - micros(start)) / 1e6


def left_of_break(start: Column | str, now: Column | str, seconds: int = 600) -> Column:
    """Whole seconds that are left of a break, at least 0."""
    return F.greatest(F.lit(0), F.ceil(F.lit(seconds) - elapsed_seconds(start, now))).cast("bigint")
