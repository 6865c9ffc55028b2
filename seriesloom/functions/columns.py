"""Column expressions: everything here stays inside code generation."""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(value: Column) -> Column:
    """NaN as NULL: a missing value has one form."""
    return F.when(~F.isnan(value), value)


def page_row(t: Column, n: int) -> Column:
    return F.pmod(t, F.lit(n)).cast("long")


def page_col(t: Column, n: int) -> Column:
    return F.floor(t / n).cast("long")


def series_index(row: Column, col: Column, n: int) -> Column:
    return (col * n + row).cast("long")


def normalize(value: Column, high: Column, low: Column) -> Column:
    """(x - mid) / half range; a constant series has no range and gives NULL."""
    half = (high - low) / 2
    return (value - (high + low) / 2) / F.nullif(half, F.lit(0.0))


def unnormalize(value: Column, high: Column, low: Column) -> Column:
    return value * ((high - low) / 2) + (high + low) / 2


def clip(value: Column, low: Column, high: Column) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def lcg(t: Column) -> Column:
    """A fixed pseudo-random number in [0, 1) for an index: the same in every engine and partitioning."""
    return F.pmod(t * 1103515245 + 12345, F.lit(2147483648)) / F.lit(2147483648.0)


def harmonics(i: Column, sine: list[tuple[float, float]], cosine: list[tuple[float, float]], steps: int, start: int = 0) -> Column:
    """Sum of a * sin(2 pi i P / steps) and b * cos(...) over (coefficient, period) pairs; 0 before start."""
    angle = lambda p: i * F.lit(float(p)) * F.lit(2 * pi) / F.lit(float(steps))
    terms = [F.lit(float(a)) * F.sin(angle(p)) for a, p in sine] + [F.lit(float(b)) * F.cos(angle(p)) for b, p in cosine]
    return F.when(i >= start, reduce(lambda x, y: x + y, terms, F.lit(0.0))).otherwise(0.0)


def linear_trend(i: Column, power: float, displacement: float) -> Column:
    return F.pow(i.cast("double"), F.lit(float(power))) + F.lit(float(displacement))


def log_trend(i: Column, displacement: float) -> Column:
    return F.log(i.cast("double") + 1) + F.lit(float(displacement))


def exp_trend(i: Column, dampening: float, displacement: float) -> Column:
    return F.exp(-i.cast("double") * F.lit(float(dampening))) + F.lit(float(displacement))
