"""Error arrays: a record is valid when its array of messages is empty."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldscan.functions.reflectance import is_finite
from fieldscan.functions.text import is_blank


def message(failed: Column, text: str) -> Column:
    return F.when(F.coalesce(failed, F.lit(True)), F.lit(text))


def errors(*messages: Column) -> Column:
    return F.array_compact(F.array(*messages))


def not_in(value: Column, allowed: Iterable[str]) -> Column:
    return value.isNull() | ~value.isin(*allowed)


def out_of_range(value: Column, low: float | None, high: float | None, required: bool = True) -> Column:
    """Nonfinite or outside [low, high]; a missing optional value passes."""
    bad = ~is_finite(value)
    if low is not None:
        bad = bad | (value < low)
    if high is not None:
        bad = bad | (value > high)
    return bad if required else value.isNotNull() & bad


def blank_optional(text: Column) -> Column:
    return text.isNotNull() & is_blank(text)


def close_to(actual: Column, expected: Column, absolute: float = 1e-9, relative: float = 1e-10) -> Column:
    """Both missing, or equal within max(absolute, relative * larger magnitude)."""
    tolerance = F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(actual), F.abs(expected)))
    return F.coalesce(F.abs(actual - expected) <= tolerance, actual.isNull() & expected.isNull())
