"""Operators on single cells (Column -> Column). Null is an invalid cell and stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def neg(x: Column) -> Column:
    return -x


def pos(x: Column) -> Column:
    return +1 * x


def sub(a: Column, b: Column) -> Column:
    return a - b


def add(a: Column, b: Column) -> Column:
    """A helper; sums are no admitted factor shape."""
    return a + b


def mul(x: Column, k: float) -> Column:
    return x * F.lit(float(k))


def div(a: Column | float, b: Column | float) -> Column:
    """Null where the denominator is 0."""
    a, b = (F.lit(float(v)) if isinstance(v, (int, float)) else v for v in (a, b))
    return F.try_divide(a, b)


def absolute(x: Column) -> Column:
    return F.abs(x)


def sign(x: Column) -> Column:
    return F.signum(x)


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def power(x: Column, p: float) -> Column:
    """Real power: p <= 0 masks 0, a fractional p masks negative cells."""
    domain = F.lit(True)
    if p <= 0:
        domain = domain & (x != 0)
    if not float(p).is_integer():
        domain = domain & (x >= 0)
    return F.when(domain, F.pow(F.when(domain, x), F.lit(float(p))))


def signed_power(x: Column, p: float) -> Column:
    """sign(x) * |x| ** p; p <= 0 masks 0."""
    domain = (x != 0) if p <= 0 else F.lit(True)
    return F.when(domain, F.signum(x) * F.pow(F.abs(F.when(domain, x)), F.lit(float(p))))


def at_most(x: Column, k: float) -> Column:
    return F.when(x.isNotNull(), F.least(x, F.lit(float(k))))


def at_least(x: Column, k: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(k))))


OPERATORS = {"neg": neg, "sub": sub, "mul": mul, "div": div, "abs": absolute, "sign": sign, "signed_log1p": signed_log1p, "pow": power, "signed_pow": signed_power, "min": at_most, "max": at_least}
