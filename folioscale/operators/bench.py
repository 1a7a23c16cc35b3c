"""Timing tables: one row per (file, format) measurement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from folioscale.constants import BENCH_FORMATS
from folioscale.functions.display import format_time


def bench_rollup(runs: DataFrame) -> DataFrame:
    """Per file and format: total time, time per page, bytes, pages."""
    return (
        runs.groupBy("file", "format")
        .agg(
            F.max("file_size").alias("file_size"),
            F.sum("total_ms").cast("bigint").alias("total_ms"),
            F.sum("output_bytes").cast("bigint").alias("output_bytes"),
            F.sum("pages").cast("bigint").alias("pages"),
        )
        .withColumn("ms_per_page", F.try_divide(F.col("total_ms").cast("double"), F.col("pages")))
    )


def bench_pivot(runs: DataFrame, formats: Sequence[str] = BENCH_FORMATS) -> DataFrame:
    """One row per file and the total time of each format as text, ``-`` where
    it was not measured. Conditional sums over the known formats: one shuffle,
    and no job to find out the values."""
    totals = [F.sum(F.when(F.col("format") == name, F.col("total_ms"))).alias(name) for name in formats]
    wide = runs.groupBy("file").agg(
        F.max("file_size").alias("file_size"), F.max("pages").cast("int").alias("pages"), *totals
    )
    texts = {name: F.coalesce(format_time(F.col(name)), F.lit("-")) for name in formats}
    return wide.withColumns(texts)
