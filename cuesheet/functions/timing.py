"""Seconds, frames and decibels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cuesheet.functions.text import strip

# What counts as an authored number of seconds.
NUMBER = "^[+-]?([0-9](_?[0-9])*)?(\\.([0-9](_?[0-9])*)?)?([eE][+-]?[0-9](_?[0-9])*)?$"


def to_frames(seconds: Column, rate) -> Column:
    """Nearest frame, ties to the even one."""
    return F.rint(seconds * F.lit(rate) if not isinstance(rate, Column) else seconds * rate).cast("bigint")


def to_seconds(frames: Column, rate) -> Column:
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    return F.when(rate <= 0, F.lit(0.0)).otherwise(frames.cast("double") / rate)


def truncated_frame(seconds: Column, rate) -> Column:
    """First frame at or before a time, never negative."""
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    return F.greatest(F.lit(0), F.floor(F.greatest(seconds * rate, F.lit(0.0))).cast("bigint"))


def parse_seconds(raw: Column) -> Column:
    """Number of seconds of an authored attribute, null when it is not a number."""
    text = strip(raw)
    has_digit = text.rlike("[0-9]") & ~text.rlike("^[+-]?[eE]")
    digits = F.replace(text, F.lit("_"), F.lit(""))
    return F.when(text.rlike(NUMBER) & has_digit, digits.try_cast("double"))


def overrides(planned: Column, rendered: Column) -> Column:
    """A planned gap or margin wins unless it is zero."""
    return F.coalesce(F.nullif(planned, F.lit(0.0)), rendered, F.lit(0.0))


def db_gain(decibels) -> Column:
    decibels = decibels if isinstance(decibels, Column) else F.lit(float(decibels))
    return F.pow(F.lit(10.0), decibels / F.lit(20.0))


def clean_zero(value: Column, digits: int) -> Column:
    """Rounded value without negative zero."""
    rounded = F.round(value, digits)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)
