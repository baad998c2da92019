"""Column expressions shared by the operators."""

from tallyhouse.functions.event_time import (
    clamp,
    event_day,
    iso_day,
    iso_utc,
    landing_day,
    parse_event_time,
    plus_seconds,
    try_event_time,
)
from tallyhouse.functions.identifiers import padded_id, pick, random_token, short_token
from tallyhouse.functions.lifecycle import (
    LIFECYCLE_RANK,
    TIEBREAKS,
    lifecycle_rank,
    newest_first,
    precedence,
)

__all__ = [
    "LIFECYCLE_RANK",
    "TIEBREAKS",
    "clamp",
    "event_day",
    "iso_day",
    "iso_utc",
    "landing_day",
    "lifecycle_rank",
    "newest_first",
    "padded_id",
    "parse_event_time",
    "pick",
    "plus_seconds",
    "precedence",
    "random_token",
    "short_token",
    "try_event_time",
]
