"""Human-readable sizes and durations, rounded like JavaScript ``toFixed``
(the exact binary value, ties up)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioscale.functions._util import ColumnOrName, col, int_div

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30


def _in_units(size: Column, unit: int, digits: int) -> tuple[Column, Column]:
    """Whole units and the rounded decimal digits, in integers only: dividing
    by a power of two is exact, so half-up here is exact as well."""
    power = 10**digits
    scaled = int_div((size % unit) * power + unit // 2, unit)
    return int_div(size, unit) + int_div(scaled, power), scaled % power


def _short_decimal(whole: Column, hundredths: Column) -> Column:
    """``whole.hh`` without trailing zeros."""
    tenths = int_div(hundredths, 10).cast("string")
    fraction = (
        F.when(hundredths == 0, "")
        .when(hundredths % 10 == 0, F.concat(F.lit("."), tenths))
        .otherwise(F.concat(F.lit("."), F.lpad(hundredths.cast("string"), 2, "0")))
    )
    return F.concat(whole.cast("string"), fraction)


def format_bytes(size: ColumnOrName) -> Column:
    """``0 B``, ``1.5 KB``, ``12.34 MB``; GB is the largest unit."""
    size = col(size).cast("bigint")

    def text(unit: int, name: str) -> Column:
        return F.concat(_short_decimal(*_in_units(size, unit, 2)), F.lit(f" {name}"))

    return (
        F.when(size < KIB, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < MIB, text(KIB, "KB"))
        .when(size < GIB, text(MIB, "MB"))
        .otherwise(text(GIB, "GB"))
    )


def size_in_mb(size: ColumnOrName) -> Column:
    """Size in MB with exactly two decimals, as text without the unit."""
    whole, hundredths = _in_units(col(size).cast("bigint"), MIB, 2)
    return F.concat(whole.cast("string"), F.lit("."), F.lpad(hundredths.cast("string"), 2, "0"))


def format_size(size: ColumnOrName) -> Column:
    """``12 B``, ``1.5 KB``, ``3.0 MB``: always one decimal above bytes."""
    size = col(size).cast("bigint")

    def text(unit: int, name: str) -> Column:
        whole, tenths = _in_units(size, unit, 1)
        return F.concat(whole.cast("string"), F.lit("."), tenths.cast("string"), F.lit(f" {name}"))

    return (
        F.when(size < KIB, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < MIB, text(KIB, "KB"))
        .otherwise(text(MIB, "MB"))
    )


def _seconds(ms: Column) -> Column:
    """Milliseconds as seconds with two decimals. Only odd multiples of 1/8 s
    are exact ties in binary, and those must go up; ``format_number`` would
    take them to the even digit, so they are nudged first."""
    seconds = ms.cast("double") / F.lit(1000.0)
    eighths = seconds * 8
    tie = (eighths == F.floor(eighths)) & (F.pmod(F.floor(eighths), F.lit(2)) == 1)
    nudged = seconds + F.when(tie, 0.001).otherwise(0.0)
    return F.call_function("format_number", nudged, F.lit("0.00"))


def _duration(ms: ColumnOrName, gap: str) -> Column:
    ms = col(ms)
    whole = F.round(ms.cast("double")).cast("bigint").cast("string")
    return F.when(ms < 1000, F.concat(whole, F.lit(gap + "ms"))).otherwise(
        F.concat(_seconds(ms), F.lit(gap + "s"))
    )


def format_time(ms: ColumnOrName) -> Column:
    """``950 ms`` or ``1.25 s``."""
    return _duration(ms, " ")


def format_duration(ms: ColumnOrName) -> Column:
    """``950ms`` or ``1.25s``."""
    return _duration(ms, "")
