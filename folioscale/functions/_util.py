from __future__ import annotations

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def int_div(a: Column, b: Column | int) -> Column:
    """Integer division (``div``), truncating; operands must be integral."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("bigint"))


def floor_div(a: Column, b: int) -> Column:
    """Integer division rounding down, also for negative ``a``."""
    return int_div(a - F.pmod(a, F.lit(b)), b)


def null_if_zero(value: Column) -> Column:
    return F.nullif(value, F.lit(0))


def null_if_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))
