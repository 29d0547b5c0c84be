"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units, powers of 1024.
SIZE_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]


def lenient_double(text: Column) -> Column:
    """Text as a number; NULL when it is not one."""
    return text.try_cast("double")


def cut_decimals(value: Column, places: int) -> Column:
    """Drop digits after ``places`` decimals, toward zero."""
    factor = 10**places
    return (value * F.lit(factor)).cast("bigint") / F.lit(float(factor))


def percentage(part: Column, rest: Column) -> Column:
    """``part`` of ``part + rest`` in percent, one decimal; NULL when both are zero."""
    return F.round(F.try_divide(part, part + rest) * 100, 1)


def hundredths(value: Column) -> Column:
    """A two-decimal amount as whole hundredths, so that sums are exact in any order."""
    return F.round(value * 100).cast("bigint")


def readable_size(size: Column) -> Column:
    """Bytes as text with two decimals and a unit, for example ``1.50 KiB``."""

    def in_unit(power: int) -> Column:
        scaled = F.round(size / F.lit(float(1024**power)), 2).cast("decimal(20,2)")
        return F.concat(scaled.cast("string"), F.lit(" " + SIZE_UNITS[power]))

    powers = range(len(SIZE_UNITS) - 1, 0, -1)
    return F.coalesce(*[F.when(size >= 1024**p, in_unit(p)) for p in powers], in_unit(0))


def gibibytes(size: Column) -> Column:
    return F.round(size / F.lit(float(1024**3)), 2)
