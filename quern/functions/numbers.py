"""Number columns: half-even rounding, safe division, evenly spaced grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Half-even rounding of the double."""
    return F.bround(col(x).cast("double"), digits)


def ratio(a: Column | str, b: Column | str) -> Column:
    """``a / b``; 0 where ``b`` is 0."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def spaced(low: Column, high: Column, n: int) -> Column:
    """An array of ``n`` evenly spaced numbers whose end point is exact."""
    step = (high - low) / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, high).otherwise(low + i * step))
