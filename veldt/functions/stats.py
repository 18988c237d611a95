"""Aggregate expressions with the guards that ANSI mode and missing values ask for.

Each function returns a Column for use in agg(), or over a window when
`over` is given. Pairs count only where both sides are present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _on(c: Column, over: WindowSpec | None) -> Column:
    return c.over(over) if over is not None else c


def weighted_mean(value: Column, weight: Column) -> Column:
    """NULL values carry no weight; a total weight of 0 gives NULL."""
    present = F.when(value.isNotNull(), weight)
    return F.try_divide(F.sum(value * weight), F.sum(present))


def strict_sum(value: Column) -> Column:
    """NULL if any value is missing."""
    return F.when(F.count(value) == F.count("*"), F.sum(value))


def guarded_corr(x: Column, y: Column, least: int = 4, over: WindowSpec | None = None) -> Column:
    """Pearson's r; NULL below `least` pairs or without variance on either side."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    n, cov = _on(F.count(px), over), _on(F.covar_pop(px, py), over)
    sx, sy = _on(F.stddev_pop(px), over), _on(F.stddev_pop(py), over)
    return F.when((n >= least) & (sx > 0) & (sy > 0), F.try_divide(cov, sx * sy))


def slope(x: Column, y: Column, least: int = 3, over: WindowSpec | None = None) -> Column:
    """Least-squares slope of y on x; NULL below `least` pairs or for constant x."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    n, cov, var = _on(F.count(px), over), _on(F.covar_pop(px, py), over), _on(F.var_pop(px), over)
    return F.when(n >= least, F.try_divide(cov, F.nullif(var, F.lit(0.0))))


def detrended(df: DataFrame, keys: list[str], x: str, y: str, name: str) -> DataFrame:
    """df with the residual of y from its least-squares line in each group; NULL below 3 pairs."""
    w = Window.partitionBy(*keys)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    px, py = F.when(both, F.col(x)), F.when(both, F.col(y))
    fitted = F.avg(py).over(w) + slope(F.col(x), F.col(y), over=w) * (px - F.avg(px).over(w))
    return df.withColumn(name, py - fitted)


def coefficient_of_variation(v: Column, sample: bool = False) -> Column:
    spread = F.stddev_samp(v) if sample else F.stddev_pop(v)
    return F.try_divide(spread, F.nullif(F.avg(v), F.lit(0.0)))


def detrended_cv(residual: Column, value: Column) -> Column:
    """Population spread of the residuals over the mean; NULL below 3 values or for a mean of 0."""
    return F.when(F.count(value) >= 3, F.try_divide(F.stddev_pop(residual), F.nullif(F.avg(value), F.lit(0.0))))


def thom_shape(v: Column) -> Column:
    """Thom's closed form for the shape of a gamma distribution, over positive values; needs 4 of them."""
    wet = F.when(v > 0, v)
    a = F.log(F.avg(wet)) - F.avg(F.log(wet))
    return F.when((F.count(wet) >= 4) & (a > 0), (F.lit(1.0) + F.sqrt(F.lit(1.0) + F.lit(4.0) * a / 3)) / (F.lit(4.0) * a))


def zero_probability(v: Column) -> Column:
    return F.try_divide(F.count_if(v <= 0).cast("double"), F.count(v))
