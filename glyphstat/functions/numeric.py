"""Numeric expressions with numpy's rounding and pandas' division rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def scaled(value: Column, decimals: int) -> Column:
    """``value`` in units of 10^-decimals, rounded half to even, as an exact BIGINT bucket."""
    return F.rint(value * F.lit(float(10**decimals))).cast("bigint")


def unscaled(bucket: Column, decimals: int) -> Column:
    return bucket / F.lit(float(10**decimals))


def significant(value: Column, digits: int) -> Column:
    """``value`` rounded to so many significant digits, half to even; 0 and infinities stay.

    Powers of ten up to 22 are exact, so smaller values are scaled in two steps.
    """
    places = F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(value)))
    near, ten = F.least(F.abs(places), F.lit(22.0)), F.lit(10.0)
    one, two = F.pow(ten, near), F.pow(ten, F.abs(places) - near)
    rounded = F.when(places >= 0, F.rint(value * one * two) / one / two).otherwise(F.rint(value / one / two) * one * two)
    return F.when((value == 0) | (F.abs(value) == INF) | F.isnan(value), value).otherwise(rounded)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or missing."""
    return F.when(b != 0, a / b)


def relative_difference(value: Column, reference: Column, inf_as_null: bool = False) -> Column:
    """(value - reference) / reference with 0/0 = null and x/0 = infinity (or null)."""
    at_zero = F.lit(None).cast("double") if inf_as_null else F.when(value > 0, F.lit(INF))
    return F.when(reference == 0, at_zero).otherwise((value - reference) / reference)


def log_ratio(value: Column, reference: Column) -> Column:
    """ln(value / reference), null where it would be infinite or undefined."""
    return F.when((value > 0) & (reference > 0), F.ln(value / reference))
