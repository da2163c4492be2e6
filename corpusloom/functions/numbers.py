"""Number shaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_fraction(value: Column) -> Column:
    """True for a positive fractional part; the remainder keeps the sign, so -1.5 has none."""
    return value % 1 > 0


def as_integer(value: Column) -> Column:
    """Truncated whole number where the decimal counts as whole, else NULL."""
    return F.when(~has_fraction(value), value.cast("bigint"))


def as_double(value: Column) -> Column:
    """Floating number where the decimal has a fraction, else NULL."""
    return F.when(has_fraction(value), value.cast("double"))


def number_json(value: Column) -> Column:
    """The decimal as JSON number text: whole numbers without a point."""
    return F.coalesce(as_integer(value).cast("string"), as_double(value).cast("string"))
