"""Outcomes of the per-page stage and their roll-ups.

Results carry ``doc_id, page_num, success, error, width, height, size_bytes,
render_ms, encode_ms``, one row per converted page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F

from folioscale.constants import ERROR_PREFIXES, RENDER_FAILED
from folioscale.functions._util import floor_div, int_div, null_if_empty
from folioscale.operators.numbering import numbered
from folioscale.session import default_partitions, stored


def page_status_rows(raw: DataFrame) -> DataFrame:
    """Bring raw stage output into the success or failure shape: failures have
    zero size, no payload, an error text and no encode time; missing timings
    are 0."""
    ok = F.coalesce(F.col("success"), F.lit(False))

    def zero_if_failed(name: str) -> Column:
        return F.when(ok, F.col(name)).otherwise(F.lit(0)).alias(name)

    render_ms = F.coalesce(F.col("render_ms"), F.lit(0))
    encode_ms = F.when(ok, F.coalesce(F.col("encode_ms"), F.lit(0))).otherwise(F.lit(0))
    error = F.when(~ok, F.coalesce(null_if_empty(F.col("error")), F.lit(RENDER_FAILED)))
    return raw.select(
        "doc_id",
        "page_num",
        ok.alias("success"),
        error.alias("error"),
        zero_if_failed("width"),
        zero_if_failed("height"),
        F.when(ok, F.col("size_bytes")).alias("size_bytes"),
        render_ms.alias("render_ms"),
        encode_ms.alias("encode_ms"),
    )


def collect_pages(results: DataFrame, payload: str = "image") -> DataFrame:
    """The in-memory result: pages in order, payload only where successful.

    Ranges are found from the keys alone. The results are stored once, so each
    page is rendered once; a sort of the keys, without payload, gives the
    borders of as many ranges as a shuffle has partitions, and each page then
    goes straight to its range. Results of one page are told apart by their
    row, so they can be spread as well.
    """
    shown = results.select(
        "doc_id",
        "page_num",
        "width",
        "height",
        "success",
        F.when(F.col("success"), F.col(payload)).alias(payload),
        "error",
        F.monotonically_increasing_id().alias("_row"),
    )
    pages = stored(shown, "collected")
    key = F.struct("doc_id", "page_num", "_row")
    parts = default_partitions(results)
    ranges = pages.select("doc_id", "page_num", "_row").repartitionByRange(parts, "doc_id", "page_num", "_row")
    # One row per range: a border, whatever the number of pages.
    firsts = ranges.groupBy(F.spark_partition_id().alias("range")).agg(F.min(key).alias("first")).orderBy("range")
    borders = [_literal(row["first"], pages) for row in firsts.collect()[1:]]
    place = _borders_up_to(key, borders) if borders else F.lit(0)
    return pages.repartitionById(parts, place).sortWithinPartitions("doc_id", "page_num", "_row").drop("_row")


def _borders_up_to(key: Column, borders: Sequence[Column]) -> Column:
    """How many of the ascending borders are not above the key, by halving:
    the cost of a row grows with the logarithm of the number of ranges."""
    table = F.array(*borders)
    steps = [1 << power for power in reversed(range(len(borders).bit_length()))]

    def halve(found: Column, step: Column) -> Column:
        return F.when(F.get(table, found + step - 1) <= key, found + step).otherwise(found)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve)


def _literal(row: Row, typed: DataFrame) -> Column:
    values = row.asDict()
    return F.struct(*[F.lit(value).cast(typed.schema[name].dataType).alias(name) for name, value in values.items()])


def doc_rollup(
    results: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    copies: Column | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Per document: pages, successes, output size and time spent, NULL as 0,
    and any ``extra`` aggregates. ``copies`` says how many requested pages a
    row stands for, one by default.

    ``success`` is true whatever happened to the pages, as users of the
    conversion result expect; ``all_pages_ok`` says what it seems to say.
    """
    copies = F.lit(1).cast("bigint") if copies is None else copies

    def total(name: str) -> Column:
        return F.sum(F.coalesce(F.col(name), F.lit(0)) * copies).cast("bigint").alias(name)

    rendered = F.when(F.col("success"), copies).otherwise(0)
    return (
        results.groupBy(*keys)
        .agg(
            F.sum(copies).cast("bigint").alias("pages"),
            F.sum(rendered).cast("bigint").alias("rendered_pages"),
            total("size_bytes").alias("output_bytes"),
            total("render_ms"),
            total("encode_ms"),
            *[value.alias(name) for name, value in (extra or {}).items()],
        )
        .withColumn("success", F.lit(True))
        .withColumn("all_pages_ok", F.col("rendered_pages") == F.col("pages"))
    )


_ENTRY = ("page_num", "success", "error", "width", "height", "size_bytes", "render_ms", "encode_ms")


def _entries(results: DataFrame) -> DataFrame:
    """Identical entries once, counted before the shuffle."""
    return results.groupBy("doc_id", *_ENTRY).agg(F.count(F.lit(1)).alias("copies"))


def page_arrays(results: DataFrame, pages_per_row: int = 512) -> DataFrame:
    """The ordered page list of a document as ARRAY<STRUCT>, ``pages_per_row``
    page numbers to a row. Identical entries are counted (``copies``). Where one
    page has very many different results, see ``result_arrays``.
    """
    return (
        _entries(results)
        .groupBy("doc_id", floor_div(F.col("page_num").cast("bigint") - 1, pages_per_row).alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct(*_ENTRY, "copies"))).alias("pages"))
    )


def result_arrays(results: DataFrame, entries_per_row: int = 512) -> DataFrame:
    """The same cut into equal lengths: ``entries_per_row`` entries to a row,
    fewer in a document's last, whatever the pages they belong to. No row grows
    with its document, nor with the results of one page; entries are numbered
    range by range, not in one task per document.
    """
    placed = numbered(_entries(results), ["doc_id"], _ENTRY)
    return (
        placed.groupBy("doc_id", floor_div(F.col("position"), entries_per_row).alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("position", *_ENTRY, "copies"))).alias("pages"))
        .withColumn("pages", F.transform("pages", lambda page: page.dropFields("position")))
    )


def rounded_ratio(total: Column, count: Column) -> Column:
    """``total / count`` to the nearest integer, halves up; NULL for none."""
    return F.when(count > 0, int_div(total * 2 + count, F.when(count > 0, count * 2)))


def rounded_ratio_of(total: int, count: int) -> int | None:
    """``rounded_ratio`` of two numbers."""
    return (total * 2 + count) // (count * 2) if count > 0 else None


def job_summary(rollup: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals over documents (a ``doc_rollup``), and the average time per
    rendered page in whole milliseconds."""
    total_ms = F.col("render_ms") + F.col("encode_ms")
    return (
        rollup.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.count_if(F.col("all_pages_ok")).alias("complete_documents"),
            F.sum("pages").alias("pages"),
            F.sum("rendered_pages").alias("rendered_pages"),
            F.sum("output_bytes").alias("output_bytes"),
            F.sum(total_ms).alias("total_ms"),
        )
        .withColumn("avg_ms_per_page", rounded_ratio(F.col("total_ms"), F.col("rendered_pages")))
    )


def success_averages(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean render and encode time over successful pages; NULL if there are
    none. A missing time counts as 0, as in the roll-ups."""
    def mean(name: str) -> Column:
        return F.avg(F.when(F.col("success"), F.coalesce(F.col(name), F.lit(0)))).alias(f"avg_{name}")

    return results.groupBy(*keys).agg(
        F.count_if(F.col("success")).alias("rendered_pages"), mean("render_ms"), mean("encode_ms")
    )


def error_class(error: Column) -> Column:
    """Failure class read off the start of an error text; NULL for no error."""
    result = F.when(error.isNull(), F.lit(None).cast("string"))
    for name, prefixes in ERROR_PREFIXES:
        matches = error.startswith(prefixes[0])
        for prefix in prefixes[1:]:
            matches = matches | error.startswith(prefix)
        result = result.when(matches, name)
    return result.otherwise("other")


def error_rollup(results: DataFrame) -> DataFrame:
    """Number of failed pages by failure class."""
    return (
        results.where(~F.col("success"))
        .groupBy(error_class(F.coalesce(F.col("error"), F.lit(""))).alias("error_class"))
        .agg(F.count(F.lit(1)).alias("failures"))
    )


def output_size_rollup(outputs: DataFrame) -> DataFrame:
    """Bytes and files written per document and format."""
    return outputs.groupBy("doc_id", "format").agg(
        F.sum("size_bytes").cast("bigint").alias("output_bytes"), F.count("size_bytes").alias("files")
    )
