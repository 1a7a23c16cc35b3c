"""Trace and timing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscale.constants import CACHE_BLOCKS
from folioscale.functions.display import format_bytes, format_size
from folioscale.functions.names import short_name
from folioscale.operators.bench import bench_pivot
from folioscale.operators.cache import READS_PER_CHUNK, cache_attribution, stream_stats


def trace_report(
    reads: DataFrame, capacity: int = CACHE_BLOCKS, reads_per_chunk: int = READS_PER_CHUNK
) -> DataFrame:
    """Per task: cache statistics, hit rate and traffic of its reads."""
    stats = stream_stats(cache_attribution(reads, capacity, reads_per_chunk))
    touches = F.col("cache_hits") + F.col("cache_misses")
    return stats.withColumns(
        {
            "hit_rate": F.try_divide(F.col("cache_hits").cast("double"), touches),
            "fetched": format_bytes("total_bytes_fetched"),
        }
    )


def bench_report(runs: DataFrame) -> DataFrame:
    """The summary table: file, size, pages, and a time per format."""
    return bench_pivot(runs).select(
        short_name("file").alias("file"),
        format_size("file_size").alias("size"),
        "pages",
        "webp",
        "png",
        "jpg",
    )
