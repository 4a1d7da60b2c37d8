"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once for each row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def checked(value: Column, ok: Column, message: str) -> Column:
    """``value`` where ``ok``, else an error; null values pass."""
    return F.when(value.isNull() | ok, value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.coalesce(value.cast("string"), F.lit("null")))))


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
