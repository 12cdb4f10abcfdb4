"""Statistics of short arrays as column expressions (series windows, JSON point lists)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def squared_deviations(values: Column, center: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - center) * (x - center))


def std_sample(values: Column, center: Column) -> Column:
    return F.sqrt(F.try_divide(squared_deviations(values, center), F.size(values) - 1))


def std_population(values: Column, center: Column) -> Column:
    return F.sqrt(F.try_divide(squared_deviations(values, center), F.size(values)))


def slope(values: Column) -> Column:
    """Least-squares slope of the values on their positions 0..n-1; 0 for fewer than two."""
    n = F.size(values)
    middle = (n - 1) / F.lit(2.0)
    moments = F.transform(values, lambda x, i: x * (i - middle))
    spread = n * (n * n - 1) / F.lit(12.0)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.try_divide(total(moments), spread))


def quantile(ascending: Column, share: float) -> Column:
    """Linearly interpolated quantile of an already sorted array."""
    position = (F.size(ascending) - 1) * F.lit(float(share))
    low = F.floor(position).cast("int")
    high = F.ceil(position).cast("int")
    a, b = F.get(ascending, low), F.get(ascending, high)
    return a + (b - a) * (position - low)
