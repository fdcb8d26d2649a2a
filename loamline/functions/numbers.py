"""Rounding, exact means, bounded division.

Doubles are added in whole numbers: each value is cut into ``LIMBS`` limbs of ``LIMB`` bits, every limb is
summed as a bigint, and only the totals become a double again. So a sum is the same in whatever order
partial aggregates arrive, and a replay or a lost executor cannot change its last digit. Buffers are numbers of
fixed width, which keeps aggregates in hash tables with a combine before the shuffle.

Values below 2^83 (9.7e24) in size have all their bits above 2^-84 in limbs: everything for sizes from
2^-31 (4.7e-10) on. What is left of smaller ones goes into ``rest``, and larger values, infinities and
NaN into ``wide``, which are plain double sums. A limb holds 2^35 values before a bigint ends; Spark's
ANSI mode then raises. States that are kept are carried first, so merging starts from small limbs again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB, LIMBS, LOWEST = 28, 6, -84
_BASE = float(1 << LIMB)
_WIDE = 2.0 ** (LOWEST + LIMB * LIMBS - 1)
_NAMES = [f"l{i}" for i in range(LIMBS)]
SUM_TYPE = "struct<" + ", ".join(f"{n}: bigint" for n in _NAMES) + ", rest: double, wide: double, n: bigint>"


def round_exact(value: Column, digits: int) -> Column:
    """Round half up, once, on the shortest decimal reading of a double; NaN and infinities stay."""
    return F.round(value.cast("double"), digits)


def _double(value: float) -> str:
    return f"{value!r}D"


def exact_sum(value: str) -> Column:
    """Aggregate: the state of an exact sum of the non-NULL values, with their number.

    Like the functions below it takes SQL text, so that its many small steps reach the JVM as one.
    """
    x = f"CAST({value} AS DOUBLE)"
    inside = f"abs({x}) < {_double(_WIDE)}"
    plain = f"CASE WHEN {inside} THEN {x} END"
    # The value in units of each limb, rounded to whole units; products with powers of two are exact.
    units = [f"rint({plain} * {_double(2.0 ** -(LOWEST + LIMB * i))})" for i in range(LIMBS)]
    limbs = [f"{low} - {high} * {_double(_BASE)}" for low, high in zip(units, units[1:])] + [units[-1]]
    fields = [f"'{name}', sum(CAST({limb} AS BIGINT))" for name, limb in zip(_NAMES, limbs)]
    fields += [f"'rest', sum({plain} - {units[0]} * {_double(2.0 ** LOWEST)})",
               f"'wide', sum(CASE WHEN NOT {inside} THEN {x} END)", f"'n', count({x})"]
    return F.expr(f"named_struct({', '.join(fields)})")


def merged_sum(state: str) -> Column:
    """Aggregate: the state of all values behind several states."""
    return F.expr("named_struct(" + ", ".join(f"'{name}', sum({state}.{name})" for name in [*_NAMES, "rest", "wide", "n"]) + ")")


def carried(state: str) -> Column:
    """The same sum with every limb but the highest within its bits."""
    fields, carry = [], "0L"
    for name in _NAMES[:-1]:
        limb = f"({state}.{name} + {carry})"
        carry = f"shiftright({limb} + {1 << (LIMB - 1)}L, {LIMB})"
        fields.append(f"'{name}', {limb} - shiftleft({carry}, {LIMB})")
    fields.append(f"'{_NAMES[-1]}', {state}.{_NAMES[-1]} + {carry}")
    fields += [f"'{name}', {state}.{name}" for name in ("rest", "wide", "n")]
    return F.expr(f"named_struct({', '.join(fields)})")


def total_text(state: str) -> str:
    """SQL text of the sum as a double, from the smallest limb up; 0 where there were no values."""
    parts = [f"coalesce({state}.rest, 0D)"]
    parts += [f"coalesce({state}.{name} * {_double(2.0 ** (LOWEST + LIMB * i))}, 0D)" for i, name in enumerate(_NAMES)]
    return "(" + " + ".join([*parts, f"coalesce({state}.wide, 0D)"]) + ")"


def mean_of(state: str, digits: int) -> Column:
    """Rounded mean from the state of a sum; NULL when there is nothing to average."""
    return F.expr(f"round(try_divide({total_text(state)}, {state}.n), {digits})")


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, 0 where whole is 0, ties to even."""
    return F.bround(F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0)), digits)


def clamp(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit a value to given bounds."""
    if low is not None:
        value = F.greatest(value, F.lit(low))
    if high is not None:
        value = F.least(value, F.lit(high))
    return value


def outside(value: Column, low: float, high: float, inclusive: bool = True) -> Column:
    """Range violation; NULL counts as no violation. With ``inclusive`` the bounds themselves are good."""
    bad = ((value < low) | (value > high)) if inclusive else ((value <= low) | (value >= high))
    return F.coalesce(bad, F.lit(False))
