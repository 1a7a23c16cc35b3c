"""Byte ranges, cache blocks and request ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioscale.constants import BLOCK_BYTES
from folioscale.functions._util import ColumnOrName, col, int_div


def block_offset(pos: ColumnOrName) -> Column:
    """Start of the block that holds byte ``pos``."""
    pos = col(pos).cast("bigint")
    return pos - pos % BLOCK_BYTES


def block_fetch_size(pos: ColumnOrName, file_size: ColumnOrName) -> Column:
    """Bytes to fetch for the block holding ``pos``; NULL past the end of file,
    where there is nothing to fetch."""
    remaining = col(file_size).cast("bigint") - block_offset(pos)
    return F.when(remaining > 0, F.least(F.lit(BLOCK_BYTES).cast("bigint"), remaining))


def block_range_header(start: ColumnOrName, size: ColumnOrName) -> Column:
    """``bytes=start-end`` with an inclusive end."""
    start = col(start).cast("bigint")
    end = start + col(size) - 1
    return F.concat(F.lit("bytes="), start.cast("string"), F.lit("-"), end.cast("string"))


def first_block(pos: ColumnOrName) -> Column:
    return int_div(col(pos).cast("bigint"), BLOCK_BYTES)


def last_block(pos: ColumnOrName, length: ColumnOrName, file_size: ColumnOrName) -> Column:
    """Last block touched by a read clipped at the end of file."""
    end = F.least(col(pos).cast("bigint") + col(length), col(file_size).cast("bigint"))
    return int_div(end - 1, BLOCK_BYTES)


def request_id_pack(task: ColumnOrName, seq: ColumnOrName) -> Column:
    """``task << 16 | seq``, both wrapping at 16 bits; BIGINT."""
    low16 = F.lit(0xFFFF).cast("bigint")
    task = col(task).cast("bigint").bitwiseAND(low16)
    seq = col(seq).cast("bigint").bitwiseAND(low16)
    return F.shiftleft(task, 16).bitwiseOR(seq)


def request_task(request_id: ColumnOrName) -> Column:
    return F.shiftrightunsigned(col(request_id).cast("bigint"), 16)


def request_seq(request_id: ColumnOrName) -> Column:
    return col(request_id).cast("bigint").bitwiseAND(F.lit(0xFFFF).cast("bigint"))
