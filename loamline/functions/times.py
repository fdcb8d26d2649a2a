"""Time expressions. None of them reads the clock unless ``as_of`` is left out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The common form: extended ISO date, optionally with a time and a zone.
_PLAIN_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"
# All forms: calendar or week date, extended or basic, any one-character separator before the time.
_DATE = r"(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(-[1-7])?|\d{4}W\d{2}[1-7]?)"
_HOUR, _SIXTY = r"([01]\d|2[0-3])", r"[0-5]\d"
_CLOCK = (rf"{_HOUR}((:{_SIXTY}(:{_SIXTY}([.,]\d+)?)?)?|({_SIXTY}({_SIXTY}([.,]\d+)?)?)?)")
_ZONE = rf"(Z|[+-]{_HOUR}(:?{_SIXTY}(:?{_SIXTY}(\.\d+)?)?)?)?"
_ANY_ISO = rf"^{_DATE}([^Z]{_CLOCK}{_ZONE})?$"


def as_of_column(as_of: dt.datetime | str | Column | None) -> Column:
    """The reference instant of a report; only ``None`` means now."""
    if as_of is None:
        return F.current_timestamp()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def parse_event_time(text: Column) -> Column:
    """Text to timestamp, NULL when unreadable.

    Text must begin with a year: Spark completes a bare ``12:30`` with today's date, which would
    make a verdict depend on the day it is computed.
    """
    return F.when(text.rlike(r"^\s*\d{4}"), F.try_to_timestamp(text))


def is_iso_timestamp(text: Column) -> Column:
    """True for text in any ISO 8601 date or date-time form that names a real day and time.

    The common form is decided first; the other forms are looked at only where it does not match.
    """
    plain = text.rlike(_PLAIN_ISO) & F.try_to_timestamp(text).isNotNull()
    calendar = F.try_to_date(F.regexp_replace(
        F.substring(text, 1, 10), r"^(\d{4})-?(\d{2})-?(\d{2}).*$", "$1-$2-$3")).isNotNull()
    # Week 53 exists only in years whose 28 December lies in it.
    last_day = F.try_to_date(F.concat(F.substring(text, 1, 4), F.lit("-12-28")))
    week = (text.rlike(r"^\d{4}-?W(0[1-9]|[1-4]\d|5[0-2])")
            | (text.rlike(r"^\d{4}-?W53") & (F.weekofyear(last_day) == 53)))
    general = text.rlike(_ANY_ISO) & F.when(text.substr(5, 2).contains("W"), week).otherwise(calendar)
    return F.when(plain, True).otherwise(F.coalesce(general, F.lit(False)))


def boundaries_crossed(unit: str, start: Column, end: Column) -> Column:
    """How many minute or hour marks lie between two instants (not elapsed whole units)."""
    return F.timestamp_diff(unit.upper(), F.date_trunc(unit, start), F.date_trunc(unit, end))


def elapsed(unit_seconds: int, start: Column, end: Column) -> Column:
    """Elapsed time as a double, exact to the microsecond."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(unit_seconds * 1_000_000.0)


def age_minutes(seen: Column, as_of: Column) -> Column:
    """Age in minutes, rounded to one decimal, ties to even."""
    return F.bround(elapsed(60, seen, as_of), 1)


def on_day_circle(hour: Column) -> tuple[Column, Column]:
    """Sine and cosine of the hour on a 24-hour circle, so that 23 h and 0 h are neighbours."""
    angle = hour * F.lit(2.0) * F.pi() / F.lit(24.0)
    return F.sin(angle), F.cos(angle)


def version_stamp(as_of: Column) -> Column:
    """A version name whose text order is its time order."""
    return F.date_format(as_of, "yyyyMMdd'T'HHmmss'Z'")
