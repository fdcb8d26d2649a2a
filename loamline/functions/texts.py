"""Text expressions for reasons, topics and blank tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def reason_family(reason: Column) -> Column:
    """The part of a reason before its detail."""
    return F.substring_index(reason, ":", 1)


def flagged(flags: dict[str, Column]) -> Column:
    """Comma list of the names whose flag is true, in the given order; empty text when none is."""
    return F.concat_ws(",", *[F.when(flag, F.lit(name)) for name, flag in flags.items()])


def any_of(flags: dict[str, Column]) -> Column:
    """True when at least one flag is."""
    return reduce(Column.__or__, flags.values())


def is_blank(value: Column) -> Column:
    return value.isNull() | (value == "")


def topic_segment(topic: Column, position: int) -> Column:
    """A segment of a slash-separated topic; negative positions count from the end."""
    return F.try_element_at(F.split(topic, "/"), F.lit(position))
