"""Identifiers, tokens and keyed choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded_id(prefix: str, number: Column, width: int) -> Column:
    """``prefix`` and the number, zero-padded to ``width``; longer numbers stay whole."""
    digits = number.cast("string")
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.concat(F.lit(prefix), padded)


def pick(values: Sequence[str], key: Column) -> Column:
    """The value a key maps to, cycling through ``values``."""
    choices = F.array(*[F.lit(value) for value in values])
    return F.get(choices, (key % len(values)).cast("int"))


def short_token(key: Column) -> Column:
    """A 16-digit token that repeats for the same key."""
    return F.concat(F.lit("tok_"), F.substring(F.md5(key.cast("string").cast("binary")), 1, 16))


def random_token() -> Column:
    """A token of the same form that never repeats."""
    return F.concat(F.lit("tok_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16))
