"""Operators along the rows of one symbol, on a dense panel. A value needs its whole past window; nothing reads the future.

`by` names what a series is: the symbol, and a candidate if there are several.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

SYMBOL = ("symbol",)
#: Up to this width a linear decay is a sum of lags; beyond it, one fold over the window's array. A table can also get wide
#: decays in linear time, as columns of its own (recurrences.linear_decay).
LAGS = 16


def width(d: int) -> int:
    """A window or lag; below 1 it would read the future."""
    if int(d) < 1:
        raise ValueError(f"a window or lag is at least 1, not {d}")
    return int(d)


def series(by: Sequence[str] = SYMBOL) -> WindowSpec:
    return Window.partitionBy(*by).orderBy("dt")


def frame(d: int, by: Sequence[str] = SYMBOL) -> WindowSpec:
    return series(by).rowsBetween(-(width(d) - 1), 0)


def full(x: Column, d: int, value: Column, by: Sequence[str] = SYMBOL) -> Column:
    """`value` where all d cells of the window are valid."""
    return F.when(F.count(x).over(frame(d, by)) == d, value)


def delay(x: Column, d: int, by: Sequence[str] = SYMBOL) -> Column:
    return F.lag(x, width(d)).over(series(by))


def delta(x: Column, d: int, by: Sequence[str] = SYMBOL) -> Column:
    return x - delay(x, d, by)


def ts_mean(x: Column, d: int, by: Sequence[str] = SYMBOL) -> Column:
    return full(x, d, F.avg(x).over(frame(d, by)), by)


def ts_std(x: Column, d: int, by: Sequence[str] = SYMBOL) -> Column:
    return full(x, d, F.stddev_samp(x).over(frame(d, by)), by)


def ts_sum(x: Column, d: int, by: Sequence[str] = SYMBOL) -> Column:
    return full(x, d, F.sum(x).over(frame(d, by)), by)


def ts_min(x: Column, d: int, by: Sequence[str] = SYMBOL) -> Column:
    return full(x, d, F.min(x).over(frame(d, by)), by)


def ts_max(x: Column, d: int, by: Sequence[str] = SYMBOL) -> Column:
    return full(x, d, F.max(x).over(frame(d, by)), by)


def ts_rank(x: Column, d: int, by: Sequence[str] = SYMBOL) -> Column:
    """Share of the window's values that don't exceed the last one."""
    values = F.collect_list(x).over(frame(d, by))
    return full(x, d, F.size(F.filter(values, lambda v: v <= F.element_at(values, -1))) / F.lit(float(width(d))), by)


def ts_cov(a: Column, b: Column, d: int, by: Sequence[str] = SYMBOL) -> Column:
    return full(a, d, full(b, d, F.covar_samp(a, b).over(frame(d, by)), by), by)


def ts_corr(a: Column, b: Column, d: int, by: Sequence[str] = SYMBOL) -> Column:
    """Pearson, from covariance and deviations: the built-in raises on a constant window."""
    f = frame(d, by)
    spread = F.stddev_samp(a).over(f) * F.stddev_samp(b).over(f)
    return full(a, d, full(b, d, F.try_divide(F.covar_samp(a, b).over(f), spread), by), by)


def decay_linear(x: Column, d: int, by: Sequence[str] = SYMBOL) -> Column:
    """Mean with weights 1 .. d, the newest heaviest."""
    total = width(d) * (d + 1) / 2
    if d <= LAGS:
        value = sum((F.lag(x, k).over(series(by)) * float(d - k) for k in range(1, d)), x * float(d)) / F.lit(total)
    else:
        weighted = F.zip_with(F.collect_list(x).over(frame(d, by)), F.sequence(F.lit(1), F.lit(d)), lambda v, w: v * w)
        value = F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v) / F.lit(total)
    return full(x, d, value, by)


def product(x: Column, d: int, by: Sequence[str] = SYMBOL) -> Column:
    return full(x, d, F.aggregate(F.collect_list(x).over(frame(d, by)), F.lit(1.0), lambda a, v: a * v), by)


OPERATORS = {"delay": delay, "delta": delta, "ts_mean": ts_mean, "ts_std": ts_std, "ts_sum": ts_sum, "ts_min": ts_min, "ts_max": ts_max, "ts_rank": ts_rank, "ts_corr": ts_corr, "ts_cov": ts_cov, "decay_linear": decay_linear, "product": product}
