"""Page lists as typed by users."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioscale.functions._util import ColumnOrName, col

_MAX_PAGE = (1 << 63) - 1


def parse_page_list(text: ColumnOrName) -> Column:
    """``'3, 5abc, 2-4, x, -1'`` -> ``[3, 5, 2]`` (ARRAY<BIGINT>).

    Each comma-separated part contributes its leading integer; parts without
    one and non-positive numbers are dropped, and ``2-4`` is not a range. A
    number too large for BIGINT stays in the list (as the largest BIGINT): the
    list must not become empty because of it, as an empty list means all pages.
    """

    def leading_int(part: Column) -> Column:
        digits = F.regexp_extract(part, r"^[\s\p{Z}\x{FEFF}]*([+-]?[0-9]+)", 1)
        too_large = (digits != "") & ~digits.startswith("-")
        return F.coalesce(digits.try_cast("bigint"), F.when(too_large, F.lit(_MAX_PAGE)))

    numbers = F.transform(F.split(F.coalesce(col(text), F.lit("")), ","), leading_int)
    return F.filter(numbers, lambda page: page > 0)
