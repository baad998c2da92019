"""Event time: UTC everywhere, TIMESTAMP_NTZ once parsed.

Casting to and from strings goes through the session time zone, so every job
calls ``session.require_utc`` before it builds a plan with these.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_event_time(iso: Column) -> Column:
    """ISO-8601 text to a UTC timestamp; an offset other than Z is honoured.

    Under ANSI mode text that is not a timestamp raises instead of turning null.
    """
    return F.to_timestamp(iso).cast("timestamp_ntz")


def try_event_time(iso: Column) -> Column:
    """The same, but null for text that is no time."""
    return F.try_to_timestamp(iso).cast("timestamp_ntz")


def iso_utc(ts: Column) -> Column:
    """A UTC timestamp as bronze stores it, to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def landing_day(iso: Column) -> Column:
    """The UTC day of ISO-8601 text, the same day silver gives it; null if it is no time."""
    return event_day(try_event_time(iso))


def event_day(ts: Column) -> Column:
    """The day an event occurred, as the ``dt`` partition value."""
    return F.date_format(ts, "yyyy-MM-dd")


def iso_day(iso: Column) -> Column:
    """The day as written, without parsing it: the UTC day of times that end in Z only."""
    return F.substring(iso, 1, 10)


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.expr("interval 1 second") * seconds


def clamp(ts: Column, as_of: Column) -> Column:
    """An event is never recorded after the moment it is reported."""
    return F.least(ts, as_of)
