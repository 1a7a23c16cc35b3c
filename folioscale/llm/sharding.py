"""Shards by a Feistel permutation of global row numbers.

Rows get numbers 0 to N-1 in an order fixed by their content. A keyed
permutation of that range scatters them; shard and slot follow from the
permuted number alone: ``number % shards`` and ``number div shards``. So shard
sizes differ by one row at most, and where a row went can be computed.

The permutation is a Feistel network over a rectangle of about ``sqrt(N)`` by
``sqrt(N)``. The rectangle holds a few numbers beyond N-1; a number that lands
there is permuted again until it is in range (cycle walking).

Nulls: a null text counts as no bytes; null ids are numbered like any other.
Equal rows are interchangeable and get different numbers. An empty table gives
an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscale.llm.common import stored

ROUNDS = 6
ROWS_PER_BLOCK = 50_000
#: Up to 4096 rows the walk is given every step it could need. Beyond, less
#: than one number in 64 is out of range, so 24 such in a row do not happen.
LONG_WALK = 24


def permuted(number: Column, rows: int, key: int) -> Column:
    """Where the permutation of 0..rows-1 takes ``number``."""
    left = math.isqrt(max(rows - 1, 0)) + 1
    right = -(-max(rows, 1) // left)
    walk = LONG_WALK if rows > 4096 else left * right - rows + 1

    def step(state: Column, index: Column) -> Column:
        turn = index % ROUNDS
        x, y = state["x"], state["y"]
        new_x = F.when(turn % 2 == 1, (x + F.pmod(F.xxhash64(y, F.lit(key), turn), F.lit(left))) % left).otherwise(x)
        new_y = F.when(turn % 2 == 0, (y + F.pmod(F.xxhash64(x, F.lit(key), turn), F.lit(right))) % right).otherwise(y)
        ended = (turn == ROUNDS - 1) & (new_x * right + new_y < rows)
        moved = F.struct(new_x.cast("long").alias("x"), new_y.cast("long").alias("y"), ended.alias("ended"))
        return F.when(state["ended"], state).otherwise(moved)

    number = number.cast("long")
    low = number % right
    start = F.struct(((number - low) / right).cast("long").alias("x"), low.alias("y"), F.lit(False).alias("ended"))
    steps = F.sequence(F.lit(0), F.lit(ROUNDS * walk - 1))
    return F.aggregate(
        steps,
        start,
        step,
        lambda state: F.when(state["ended"], state["x"] * right + state["y"]).otherwise(
            F.raise_error(F.lit("the cycle walk did not end")).cast("long")
        ),
    )


def numbered_rows(rows: DataFrame, total: int) -> DataFrame:
    """Add ``number``: 0 to total-1, by the content of the (small) rows only.

    Rows are dealt to blocks by hash, numbered within a block, and shifted by
    what the blocks before hold. Equal rows are counted first and unfolded last.
    """
    names = rows.columns
    blocks = max(1, -(-total // ROWS_PER_BLOCK))
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    counted = stored(counted.withColumn("_block", F.pmod(F.xxhash64(*names), F.lit(blocks))), "row-numbers")
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counted.groupBy("_block")
        .agg(F.sum("_copies").alias("_rows"))
        .select("_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    earlier = Window.partitionBy("_block").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_offset") + F.coalesce(F.sum("_copies").over(earlier), F.lit(0))
    return (
        counted.join(offsets, "_block")
        .withColumn("_first", first)
        .select(*names, "_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_copy"))
        .select(*names, (F.col("_first") + F.col("_copy")).alias("number"))
    )


def assign_shards(
    docs: DataFrame, shards: int = 24, key: int = 1, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; size is UTF-8 bytes and 8 more."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    total = docs.count()
    place = permuted(F.col("number"), total, key)
    return (
        numbered_rows(rows, total)
        .withColumn("place", place)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
            ((F.col("place") - F.pmod("place", F.lit(shards))) / shards).cast("long").alias("slot"),
        )
    )
