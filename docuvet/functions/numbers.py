"""Exact score arithmetic: everything that is rounded is a decimal first."""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def dec(value, precision: int = 18, scale: int = 6) -> Column:
    """A column, or a number, as a decimal of the given size."""
    if isinstance(value, (int, str, Decimal)):
        value = F.lit(Decimal(str(value)))
    return value.cast(f"decimal({precision},{scale})")


def clamp(value: Column, low, high) -> Column:
    return F.greatest(dec(low), F.least(dec(high), dec(value)))


def round1(value: Column) -> Column:
    return F.round(dec(value), 1).cast("decimal(9,1)")
