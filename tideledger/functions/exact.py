"""Exact integer arithmetic on ``decimal(38,0)`` columns.

Money is held as whole *units*.  One collateral coin is ``65536 * 10**14``
units, so every native amount with at most 14 decimal digits and every entry
price with a 1/65536 residue is a whole number of units.  Columns in units end
in ``_u``.  A scale that does not fit raises instead of rounding.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEC = T.DecimalType(38, 0)
Q16 = 65_536
UNIT_DIGITS = 14
UNITS_PER_COIN = Q16 * 10**UNIT_DIGITS
PPM = 1_000_000


def dec(value) -> Column:
    """A column or Python integer as ``decimal(38,0)``."""
    if isinstance(value, int):
        return F.expr(f"cast('{value}' as decimal(38,0))")
    return (F.col(value) if isinstance(value, str) else value).cast(DEC)


def pow10(exponent: Column) -> Column:
    """10**exponent for 0..28; any other exponent raises under ANSI mode."""
    powers = ", ".join(f"cast('{10**n}' as decimal(38,0))" for n in range(29))
    return F.element_at(F.expr(f"array({powers})"), exponent.cast("int") + 1)


def trunc_div(numerator: Column, denominator) -> Column:
    """Integer quotient truncated toward zero, null when the denominator is 0.

    The remainder is removed first, so the decimal division is exact and the
    long-typed ``div`` operator is never needed.
    """
    a, b = dec(numerator), dec(denominator)
    return F.when(b != 0, ((a - a % b) / b).cast(DEC))


def units_from_native(native: Column, decimals: Column) -> Column:
    """Native integer with ``decimals`` digits -> units; too fine a scale raises."""
    return dec(native) * dec(Q16) * pow10(F.lit(UNIT_DIGITS) - decimals)


def units_to_native(units: Column, decimals: int = 6) -> Column:
    """Units -> native integer at a fixed number of digits, truncated toward zero."""
    return trunc_div(units, Q16 * 10 ** (UNIT_DIGITS - decimals))


def to_long(value: Column) -> Column:
    return value.cast("long")


def ratio_ppm(numerator: Column, denominator: Column) -> Column:
    """Ratio truncated toward zero at six decimals, in parts per million."""
    return to_long(trunc_div(dec(numerator) * dec(PPM), denominator))


def known_sum(value: Column) -> Column:
    """Sum over a group that is null as soon as one input is null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.coalesce(F.sum(value), dec(0)))


def known_sum_where(condition: Column, value: Column) -> Column:
    """``known_sum`` over the rows of a group that satisfy ``condition``."""
    wanted = F.count(F.when(condition, F.lit(1)))
    found = F.count(F.when(condition, value))
    return F.when(wanted == found, F.coalesce(F.sum(F.when(condition, value)), dec(0)))


def decimal18(units: Column) -> Column:
    """Served form of a unit amount: ``decimal(38,18)`` truncated toward zero."""
    whole = trunc_div(units, UNITS_PER_COIN)
    rest = dec(units) % dec(UNITS_PER_COIN)
    fraction = trunc_div(rest * dec(10**4), Q16).cast(T.DecimalType(18, 0))
    tail = (fraction / F.lit(Decimal(10**18)).cast(T.DecimalType(19, 0))).cast(T.DecimalType(38, 18))
    return (whole.cast(T.DecimalType(20, 0)).cast(T.DecimalType(38, 18)) + tail).cast(T.DecimalType(38, 18))


def percent_text(ppm: Column) -> Column:
    """A ppm ratio as a percentage with at most two decimals, zeros trimmed."""
    hundredths = dec(F.abs(ppm)) - dec(F.abs(ppm)) % dec(100)
    hundredths = (hundredths / dec(100)).cast("long")
    sign = F.when((ppm < 0) & (hundredths > 0), F.lit("-")).otherwise(F.lit(""))
    whole = (hundredths - hundredths % 100).cast(DEC) / dec(100)
    text = F.concat(
        sign, whole.cast("long").cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0")
    )
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
