"""Byte-range read traces and what a per-task LRU block cache makes of them.

A trace carries ``task_id, seq, pos, len, file_size``; ``seq`` numbers the
reads of a task and is unique within it.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from folioscale.constants import BLOCK_BYTES, CACHE_BLOCKS
from folioscale.functions._util import floor_div
from folioscale.functions.blocks import block_fetch_size, first_block, last_block
from folioscale.operators.pages import explode_range

READS_PER_CHUNK = 1 << 23


def _clipped(reads: DataFrame) -> DataFrame:
    """Reads that touch anything, with the blocks they touch."""
    return reads.where((F.col("pos") < F.col("file_size")) & (F.col("len") > 0)).withColumns(
        {"first_block": first_block("pos"), "last_block": last_block("pos", "len", "file_size")}
    )


def blocks_of_read(reads: DataFrame) -> DataFrame:
    """One row per block a read touches, clipped at the end of the file."""
    touched = explode_range(_clipped(reads), F.col("first_block"), F.col("last_block"), "block")
    offset = F.col("block") * BLOCK_BYTES
    return touched.select(
        "task_id",
        "seq",
        offset.alias("block_offset"),
        block_fetch_size(offset, "file_size").alias("fetch_size"),
    )


def block_first_touch(reads: DataFrame) -> DataFrame:
    """Compulsory misses: the first read of each block by each task. A minimum
    per key, so it combines before the shuffle."""
    return blocks_of_read(reads).groupBy("task_id", "block_offset").agg(F.min("seq").alias("first_seq"))


def _values(batch: pa.RecordBatch, *names: str) -> list[list]:
    """Columns as Python lists, by way of numpy: many times faster."""
    return [batch.column(name).to_numpy(zero_copy_only=False).tolist() for name in names]


class _Recency:
    """The blocks an LRU cache holds, least recently used first."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.blocks: OrderedDict[int, int] = OrderedDict()

    def touch(self, block: int, seq: int) -> bool:
        held = block in self.blocks
        self.blocks[block] = seq
        self.blocks.move_to_end(block)
        if len(self.blocks) > self.capacity:
            self.blocks.popitem(last=False)
        return held


_Batches = Iterator[pa.RecordBatch]


def _replay(capacity: int) -> Callable[[_Batches], _Batches]:
    """Mark touches as hits, over rows sorted by (task, chunk, seed first, seq,
    block). Seeds are what the cache held when the chunk began."""

    def run(batches: _Batches) -> _Batches:
        current, cache = None, _Recency(capacity)
        for batch in batches:
            columns = _values(batch, "task_id", "chunk", "is_read", "seq", "block")
            hits = []
            for task, chunk, is_read, seq, block in zip(*columns):
                if (task, chunk) != current:
                    current, cache = (task, chunk), _Recency(capacity)
                held = cache.touch(block, seq)
                if is_read:
                    hits.append(held)
            reads = batch.filter(batch.column("is_read"))
            yield pa.RecordBatch.from_arrays(
                [reads.column("task_id"), reads.column("seq"), reads.column("block"),
                 reads.column("file_size"), pa.array(hits, pa.bool_())],
                names=["task_id", "seq", "block", "file_size", "hit"],
            )

    return run


def _carry(capacity: int) -> Callable[[_Batches], _Batches]:
    """For each chunk but the first of a task, emit what the cache holds at its
    start, over chunk summaries sorted by (task, chunk, last_seq, block)."""
    names = ["task_id", "chunk", "seq", "block"]

    def run(batches: _Batches) -> _Batches:
        task, chunk, cache = None, None, _Recency(capacity)
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            columns = _values(batch, "task_id", "chunk", "last_seq", "block")
            for row_task, row_chunk, last_seq, block in zip(*columns):
                if row_task != task:
                    task, chunk, cache = row_task, row_chunk, _Recency(capacity)
                elif row_chunk != chunk:
                    chunk = row_chunk
                    out.extend((task, chunk, seq, held) for held, seq in cache.blocks.items())
                cache.touch(block, last_seq)
            arrays = [pa.array(values, pa.int64()) for values in zip(*out)] if out else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _chunked(reads: DataFrame, reads_per_chunk: int) -> DataFrame:
    """Reads with ``is_long`` and their ``chunk``: tasks with more than
    ``reads_per_chunk`` reads are cut every ``reads_per_chunk`` sequence
    numbers, hence into chunks of at most that many reads.

    The ids of long tasks are broadcast: at most (number of reads) /
    ``reads_per_chunk`` of them exist, about a hundred thousand in 10^12 reads.
    """
    long_tasks = (
        reads.groupBy("task_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > reads_per_chunk)
        .select("task_id", F.lit(True).alias("is_long"))
    )
    chunk = F.when(F.col("is_long"), floor_div(F.col("seq"), reads_per_chunk))
    return reads.join(F.broadcast(long_tasks), "task_id", "left").withColumn(
        "chunk", F.coalesce(chunk, F.lit(0).cast("bigint"))
    )


def _seeds(chunked: DataFrame, capacity: int) -> DataFrame:
    """Cache content at the start of each later chunk of long tasks.

    A chunk is summed up by the last ``capacity`` distinct blocks it touched,
    which is all that a later chunk can see of it. Summaries are taken in
    parallel; only they pass through the per-task carry.
    """
    newest = Window.partitionBy("task_id", "chunk").orderBy(F.desc("last_seq"), F.desc("block"))
    touched = explode_range(
        chunked.where(F.col("is_long")), F.col("first_block"), F.col("last_block"), "block"
    )
    summaries = (
        touched.groupBy("task_id", "chunk", "block")
        .agg(F.max("seq").alias("last_seq"))
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= capacity)
        .select("task_id", "chunk", "last_seq", "block")
    )
    return (
        summaries.repartition("task_id")
        .sortWithinPartitions("task_id", "chunk", "last_seq", "block")
        .mapInArrow(_carry(capacity), "task_id bigint, chunk bigint, seq bigint, block bigint")
    )


def cache_attribution(
    reads: DataFrame, capacity: int = CACHE_BLOCKS, reads_per_chunk: int = READS_PER_CHUNK
) -> DataFrame:
    """Every block touch as hit or miss under an LRU cache per task.

    Reads, not touches, are shuffled, once, by (task, chunk): a huge task is
    cut into chunks, so that it does not end up in one partition, and each
    chunk starts from the cache content its predecessors leave behind. A Python
    pass carries only that content.
    """
    clipped = _clipped(reads).select("task_id", "seq", "first_block", "last_block", "file_size")
    chunked = _chunked(clipped, reads_per_chunk)
    seeds = _seeds(chunked, capacity).select(
        "task_id",
        "chunk",
        F.lit(False).alias("is_read"),
        "seq",
        F.col("block").alias("first_block"),
        F.col("block").alias("last_block"),
        F.lit(0).cast("bigint").alias("file_size"),
    )
    ordered = (
        chunked.drop("is_long")
        .withColumn("is_read", F.lit(True))
        .unionByName(seeds)
        .repartition("task_id", "chunk")
        .sortWithinPartitions("task_id", "chunk", "is_read", "seq", "first_block")
    )
    touches = explode_range(ordered, F.col("first_block"), F.col("last_block"), "block").select(
        "task_id", "chunk", "is_read", "seq", "block", "file_size"
    )
    offset = F.col("block") * BLOCK_BYTES
    return touches.mapInArrow(
        _replay(capacity), "task_id bigint, seq bigint, block bigint, file_size bigint, hit boolean"
    ).select(
        "task_id",
        "seq",
        offset.alias("block_offset"),
        "hit",
        F.when(F.col("hit"), 0).otherwise(block_fetch_size(offset, "file_size")).alias("fetched_bytes"),
    )


def stream_stats(attributed: DataFrame) -> DataFrame:
    """Per task: requests, hits, misses, bytes fetched. Only misses lead to a
    request, so the two counts are equal."""
    misses = F.count_if(~F.col("hit"))
    return attributed.groupBy("task_id").agg(
        misses.alias("total_requests"),
        F.count_if(F.col("hit")).alias("cache_hits"),
        misses.alias("cache_misses"),
        F.sum("fetched_bytes").cast("bigint").alias("total_bytes_fetched"),
    )
