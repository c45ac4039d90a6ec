"""Significance of the two-sample Kolmogorov-Smirnov statistic."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_TERMS = 25


def _tail(z: Column) -> Column:
    """P(K >= z) of the Kolmogorov distribution."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(_TERMS)),
        F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * z * z),
    )
    # The tail differs from 1 by less than 1e-12 below 0.2, where the series cancels.
    return F.when(z < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def p_series(d: Column, n: Column, m: Column) -> Column:
    """Limiting p-value."""
    # Divide first: the product of two large counts would not fit a BIGINT.
    return _tail(d * F.sqrt(n / (n + m) * m))
