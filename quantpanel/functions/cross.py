"""Operators across the symbols of one date. `by` names what makes a cross-section: the date, and a candidate if there are several."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DATE = ("dt",)


def rank(x: Column, by: Sequence[str] = DATE) -> Column:
    """Percentile rank in (0, 1]; ties share the average, invalid cells don't count."""
    section = Window.partitionBy(*by)
    first = F.rank().over(section.orderBy(x.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), F.try_divide(first + (ties - 1) / F.lit(2.0), F.count(x).over(section)))


def zscore(x: Column, by: Sequence[str] = DATE) -> Column:
    """(x - mean) / sample deviation; invalid where that is 0 or undefined."""
    section = Window.partitionBy(*by)
    return F.try_divide(x - F.avg(x).over(section), F.stddev_samp(x).over(section))


def demean(x: Column, by: Sequence[str] = DATE) -> Column:
    return x - F.avg(x).over(Window.partitionBy(*by))


def scale(x: Column, k: float = 1.0, by: Sequence[str] = DATE) -> Column:
    """x times k over the sum of |x|; invalid where that is 0."""
    return F.try_divide(x, F.sum(F.abs(x)).over(Window.partitionBy(*by))) * F.lit(float(k))


OPERATORS = {"rank": rank, "zscore": zscore, "demean": demean, "scale": scale}
