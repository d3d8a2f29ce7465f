"""Column expressions for vectors, segments and scanlines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def single(x: Column) -> Column:
    """A value through single precision, as vertices are stored."""
    return x.cast("float").cast("double")


def length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def normalised(dx: Column, dy: Column) -> tuple[Column, Column]:
    """Unit vector; (1, 0) for a vector shorter than 1e-9."""
    n = length(dx, dy)
    tiny = n < 1e-9
    return F.when(tiny, F.lit(1.0)).otherwise(dx / n), F.when(tiny, F.lit(0.0)).otherwise(dy / n)


def pixel_from(x: Column) -> Column:
    """First pixel whose centre is at or beyond ``x``."""
    return F.ceil(x - F.lit(0.5)).cast("int")


def wrapped(angle: Column) -> Column:
    """An angle difference in (-pi, pi]."""
    return F.when(angle > F.pi(), angle - 2 * F.pi()).when(angle < -F.pi(), angle + 2 * F.pi()).otherwise(angle)
