"""Bringing together everything known about a page in one aggregation.

Requests, page objects, page sizes and results all are keyed by (document,
page). Instead of joining them one by one, their rows are stacked and grouped
once: one shuffle, reduced by partial aggregation before it, so neither a page
requested over and over nor one with very many objects becomes a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from folioscale.operators.pages import explode_range
from folioscale.session import default_partitions


def _count(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def _one_row(value: str, rank: Column) -> Column:
    """``value`` of the row with the highest rank. With a number as rank the
    buffers are of fixed width, so rows are combined in a hash table; a maximum
    of structs would sort every row first."""
    return F.max_by(F.col(value), rank)


def _size(name: str) -> Column:
    """From the widest size of a page. Within 1/1024 pt a hash decides, so that
    width and height always come from one row."""
    width = F.least(F.greatest(F.col("width_pt") * 1024, F.lit(0.0)), F.lit(float((1 << 31) - 1))).cast("bigint")
    known = F.col("width_pt").isNotNull() | F.col("height_pt").isNotNull()
    rank = F.shiftleft(F.coalesce(width, F.lit(0).cast("bigint")), 31) + _hash(31, "width_pt", "height_pt")
    return _one_row(name, F.when(known, rank))


def _outcome(name: str) -> Column:
    """From a successful result before a failed one; among those a hash of the
    values decides, so that all come from one row."""
    names = ("success", "size_bytes", "render_ms", "encode_ms")
    known = reduce(lambda a, b: a | b, (F.col(column).isNotNull() for column in names))
    success = F.coalesce(F.col("success"), F.lit(False)).cast("bigint")
    rank = F.shiftleft(success, 60) + _hash(60, *names)
    return _one_row(name, F.when(known, rank))


def _hash(bits: int, *names: str) -> Column:
    return F.xxhash64(*names).bitwiseAND(F.lit((1 << bits) - 1))


_AGGREGATES = {
    "copies": lambda: _count(F.col("copies")),
    "text_objects": lambda: _count(F.col("text_objects")),
    "image_objects": lambda: _count(F.col("image_objects")),
    "width_pt": lambda: _size("width_pt"),
    "height_pt": lambda: _size("height_pt"),
    "success": lambda: _outcome("success"),
    "size_bytes": lambda: F.when(_outcome("success"), _outcome("size_bytes")),
    "render_ms": lambda: _outcome("render_ms"),
    "encode_ms": lambda: _outcome("encode_ms"),
}


def requested_pages(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """``doc_id, page_num, copies``: the requests as they are (valid or not),
    and all pages of documents without any."""
    one = F.lit(1).cast("bigint").alias("copies")
    listed = requests.select("doc_id").distinct()
    unlisted = docs.select("doc_id", "num_pages").join(listed, "doc_id", "left_anti")
    whole = explode_range(unlisted, F.lit(1), F.col("num_pages"), "page_num")
    asked = requests.select("doc_id", F.col("page_num").cast("bigint").alias("page_num"), one)
    return asked.unionByName(whole.select("doc_id", "page_num", one))


def gather_pages(
    requested: DataFrame,
    objects: DataFrame | None = None,
    geometry: DataFrame | None = None,
    results: DataFrame | None = None,
) -> DataFrame:
    """One row per requested page: ``copies`` (how often it was requested),
    object counts, size, and the outcome as far as the inputs are given. Of
    several results for a page one successful row counts, of several sizes one."""
    key = ["doc_id", F.col("page_num").cast("bigint").alias("page_num")]

    def ones(condition: Column) -> Column:
        return F.when(condition, F.lit(1).cast("bigint"))

    stacked = [requested.select(*key, "copies")]
    if objects is not None:
        kind = F.col("object_type")
        counts = ones(kind == "Text").alias("text_objects"), ones(kind == "Image").alias("image_objects")
        stacked.append(objects.where(kind.isin("Text", "Image")).select(*key, *counts))
    if geometry is not None:
        stacked.append(geometry.select(*key, "width_pt", "height_pt"))
    if results is not None:
        stacked.append(results.select(*key, "success", "size_bytes", "render_ms", "encode_ms"))

    everything = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), stacked)
    known = [name for name in _AGGREGATES if name in everything.columns]
    return (
        everything.groupBy("doc_id", "page_num")
        .agg(*[_AGGREGATES[name]().alias(name) for name in known])
        .where(F.col("copies") > 0)
    )


def repeat_copies(
    pages: DataFrame, hot_copies: int = 1 << 20, keys: Sequence[str] = ("doc_id", "page_num")
) -> DataFrame:
    """One row per request again, from rows that count ``copies``.

    Rows with more than ``hot_copies`` are cut into runs of that many and the
    runs are spread over the cluster before they are unfolded, so no task has
    to emit an unbounded number of copies. Their number of partitions is fixed:
    merged by size, the few rows of runs would end up in one.
    """
    copies = F.col("copies")
    few = explode_range(pages.where(copies <= hot_copies), F.lit(1), copies, "_copy")
    runs = explode_range(
        pages.where(copies > hot_copies), F.lit(0), F.floor((copies - 1) / hot_copies), "_part"
    ).repartition(default_partitions(pages), *keys, "_part")
    left = copies - F.col("_part") * hot_copies
    many = explode_range(runs, F.lit(1), F.least(left, F.lit(hot_copies)), "_copy")
    return few.drop("_copy", "copies").unionByName(many.drop("_part", "_copy", "copies"))
