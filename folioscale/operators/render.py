"""Stages that call user code: the per-page renderer and the document
inspector. One bad page or document becomes an error row, never a failed job.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscale.constants import LOAD_FAILED, NO_INPUT, NO_RENDERER, UNKNOWN_ERROR
from folioscale.functions._util import floor_div
from folioscale.session import default_partitions, stored

PAGES_PER_GROUP = 256
#: With bytes instead of paths a group's pages are one row.
PAGES_PER_TABLE = 64
#: About 4,096 pages of two megapixels: minutes of rendering, against which a task's start is nothing.
PIXELS_PER_TASK = 1 << 33
_FLUSH_ROWS = 256
_FLUSH_BYTES = 32 << 20


@dataclass(frozen=True)
class RenderedPage:
    """What a renderer returns. Times left out are measured or 0."""

    image: bytes
    width: int
    height: int
    render_ms: int | None = None
    encode_ms: int = 0


class Renderer(Protocol):
    """Plug-in contract. ``open`` reads a document (path or bytes) once per
    group of its pages; ``render`` gets the planned row as a dict."""

    def open(self, source: Any) -> Any: ...

    def render(self, document: Any, page: dict[str, Any]) -> RenderedPage: ...

    def close(self, document: Any) -> None: ...


# Columns a rendered page adds to its keys, as Arrow types and as Spark DDL.
_OUTCOME = [
    ("copies", pa.int64(), "bigint"),
    ("success", pa.bool_(), "boolean"),
    ("error", pa.string(), "string"),
    ("width", pa.int32(), "int"),
    ("height", pa.int32(), "int"),
    ("image", pa.binary(), "binary"),
    ("size_bytes", pa.int64(), "bigint"),
    ("render_ms", pa.int64(), "bigint"),
    ("encode_ms", pa.int64(), "bigint"),
]


def _reason(problem: Exception) -> str:
    """The text of an exception, such that Arrow can hold it."""
    try:
        return str(problem).encode("utf-8", "replace").decode("utf-8")
    except Exception:  # noqa: BLE001 - user exceptions may fail at this, too
        return type(problem).__name__


def _checked(row: dict[str, Any], columns: list[tuple[str, pa.DataType, str]]) -> dict[str, Any]:
    """The row, if its values fit the columns; raises what Arrow raises else."""
    for name, arrow_type, _ in columns:
        if name in row and not isinstance(row[name], bytes) and not _fits(row[name], arrow_type):
            row[name] = pa.scalar(row[name], arrow_type).as_py()
    return row


def _fits(value: Any, arrow_type: pa.DataType) -> bool:
    """Whether a value of the usual kind needs no conversion by Arrow to tell that it fits."""
    kind = type(value)
    if kind is float:
        return pa.types.is_floating(arrow_type)
    if kind is int:
        return pa.types.is_integer(arrow_type) and -(1 << 31) <= value < 1 << 31
    if kind is list:
        return pa.types.is_list(arrow_type) and all(type(entry) is str and entry.isascii() for entry in value)
    return False


def _as_dicts(batch: pa.RecordBatch) -> Iterator[dict[str, Any]]:
    """The rows of ``to_pylist``; texts, and numbers without nulls, are converted as whole columns."""
    whole = (pa.types.is_integer, pa.types.is_float64, pa.types.is_boolean)

    def values(column: pa.Array) -> list[Any]:
        kind = column.type
        if pa.types.is_string(kind) or (column.null_count == 0 and any(is_kind(kind) for is_kind in whole)):
            return column.to_numpy(zero_copy_only=False).tolist()
        return column.to_pylist()

    names = batch.schema.names
    return (dict(zip(names, row)) for row in zip(*map(values, batch.columns)))


def _failed(error: str) -> dict[str, Any]:
    return dict(success=False, error=error, width=0, height=0, render_ms=0, encode_ms=0)


def _render_one(renderer: Renderer, document: Any, page: dict[str, Any]) -> dict[str, Any]:
    started = time.perf_counter()
    try:
        done = renderer.render(document, page)
        elapsed = int((time.perf_counter() - started) * 1000)
        return dict(
            success=True,
            error=None,
            width=done.width,
            height=done.height,
            image=done.image,
            size_bytes=len(done.image),
            render_ms=elapsed if done.render_ms is None else done.render_ms,
            encode_ms=done.encode_ms,
        )
    except Exception as problem:  # noqa: BLE001 - user code may raise or return anything
        return _failed(_reason(problem) or UNKNOWN_ERROR)


class _OpenDocument:
    """The document of the current group, or the reason it would not open."""

    def __init__(self, renderer: Renderer | None, source_column: str) -> None:
        self.renderer, self.source_column = renderer, source_column
        self.group: Any = None
        self.document: Any = None
        self.error: str | None = None

    def enter(self, group: Any, row: dict[str, Any]) -> None:
        if group == self.group:
            return
        self.leave()
        self.group, self.document, self.error = group, None, None
        if self.renderer is None:
            self.error = NO_RENDERER
        elif row[self.source_column] is None:
            self.error = NO_INPUT
        else:
            try:
                self.document = self.renderer.open(row[self.source_column])
            except Exception as problem:  # noqa: BLE001
                self.error = f"{LOAD_FAILED}{_reason(problem)}"

    def leave(self) -> None:
        if self.group is not None and self.error is None:
            try:
                self.renderer.close(self.document)
            except Exception:  # noqa: BLE001 - pages are done by now
                pass
        self.group = None


def _batched(rows: Iterable[dict[str, Any]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Cut a row stream into batches by count and payload size."""
    pending: list[dict[str, Any]] = []
    held = 0
    for row in rows:
        pending.append(row)
        held += len(row.get("image") or b"")
        if len(pending) >= _FLUSH_ROWS or held >= _FLUSH_BYTES:
            yield _record_batch(pending, schema)
            pending, held = [], 0
    if pending:
        yield _record_batch(pending, schema)


def _record_batch(rows: list[dict[str, Any]], schema: pa.Schema) -> pa.RecordBatch:
    """The rows as they are; only if a renderer returned what does not fit are
    they checked value by value, and the odd ones become failures."""
    try:
        return pa.RecordBatch.from_pylist(rows, schema)
    except Exception:  # noqa: BLE001 - Arrow raises several kinds
        return pa.RecordBatch.from_pylist([_fitting(row) for row in rows], schema)


def _fitting(row: dict[str, Any]) -> dict[str, Any]:
    try:
        return _checked(row, _OUTCOME)
    except Exception as problem:  # noqa: BLE001
        names = [name for name, _, _ in _OUTCOME if name != "copies"]
        kept = {name: value for name, value in row.items() if name not in names}
        return {**kept, **_failed(_reason(problem) or UNKNOWN_ERROR)}


class _Stage:
    """What both ways of rendering share: the columns, and the rows of a page table."""

    def __init__(self, planned: DataFrame, make_renderer: Callable[[], Renderer | None], source: str) -> None:
        self.keys = [name for name in ("doc_id", "page_num", "format") if name in planned.columns]
        self.plan_columns = [name for name in planned.columns if name != "copies"]
        self.make_renderer, self.source = make_renderer, source
        ddl = [f"{key} {planned.schema[key].dataType.simpleString()}" for key in self.keys]
        self.ddl = ", ".join(ddl + [f"{name} {spark_type}" for name, _, spark_type in _OUTCOME])

    def schema(self, planned: pa.Schema) -> pa.Schema:
        fields = [(key, planned.field(key).type) for key in self.keys]
        return pa.schema(fields + [(name, arrow_type) for name, arrow_type, _ in _OUTCOME])

    def renderer(self) -> Renderer | None:
        try:
            return self.make_renderer()
        except Exception:  # noqa: BLE001 - as good as no renderer
            return None

    def rows(self, pages: Iterable[dict[str, Any]], opened: _OpenDocument) -> Iterator[dict[str, Any]]:
        for row in pages:
            opened.enter((row["doc_id"], row["_group"]), row)
            if opened.error is not None:
                outcome = _failed(opened.error)
            else:
                outcome = _render_one(opened.renderer, opened.document, {k: row[k] for k in self.plan_columns})
            yield {**{key: row[key] for key in self.keys}, "copies": row["copies"], **outcome}


def _counted(planned: DataFrame) -> DataFrame:
    """Equal planned rows once, with their number."""
    if "copies" in planned.columns:
        return planned
    return planned.groupBy(*planned.columns).agg(F.count(F.lit(1)).alias("copies"))


def _page_group(pages_per_group: int) -> Column:
    return floor_div(F.col("page_num").cast("bigint") - 1, pages_per_group)


def pack_pages(planned: DataFrame, cost: Column, cost_per_task: int, slots: int | None = None) -> tuple[DataFrame, int]:
    """Add ``_slot``, the task that a page goes to, from the page's ``_group``
    and its cost; returns the number of slots as well.

    Groups are laid end to end by their running cost and the line is cut into
    slots of equal cost. Groups are dealt to buckets for that; the totals of
    the buckets, one row per shuffle partition, say where each bucket begins.
    A group that alone costs more than a task should is cut between its pages.
    """
    price = F.greatest(F.coalesce(cost.cast("bigint"), F.lit(1)), F.lit(1)).alias("_cost")
    in_group = Window.partitionBy("doc_id", "_group")
    so_far = F.sum("_cost").over(in_group.orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1))
    rows = planned.withColumn("_cost", price).withColumns(
        {"_within": F.coalesce(so_far, F.lit(0)), "_weight": F.sum("_cost").over(in_group)}
    )
    rows = stored(rows, "planned")
    groups = rows.groupBy("doc_id", "_group").agg(F.max("_weight").alias("_weight"))
    parts = default_partitions(planned)
    bucket = F.pmod(F.xxhash64("doc_id", "_group"), F.lit(parts))
    groups = stored(groups.withColumn("_bucket", bucket), "groups")
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = groups.groupBy("_bucket").agg(F.sum("_weight").alias("_sum"))
    starts = totals.select("_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_begin"))
    total = groups.agg(F.sum("_weight")).first()[0] or 0
    slots = slots or max(parts, -(-total // cost_per_task), 1)
    target = max(total / slots, 1)
    earlier = Window.partitionBy("_bucket").orderBy("doc_id", "_group").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_begin") + F.coalesce(F.sum("_weight").over(earlier), F.lit(0))
    placed = groups.join(starts, "_bucket").select("doc_id", "_group", start.alias("_start"))
    here = F.col("_start") + F.when(F.col("_weight") > cost_per_task, F.col("_within")).otherwise(0)
    left, right = rows.alias("left"), placed.alias("right")
    same = F.col("left.doc_id").eqNullSafe(F.col("right.doc_id")) & F.col("left._group").eqNullSafe(F.col("right._group"))
    slot = F.least(F.floor(here / F.lit(target)), F.lit(slots - 1)).cast("int").alias("_slot")
    kept = [F.col(f"left.{name}") for name in planned.columns]
    return left.join(right, same).select(*kept, slot), slots


def map_pages(
    planned: DataFrame,
    make_renderer: Callable[[], Renderer | None],
    source: str = "input",
    pages_per_group: int = PAGES_PER_GROUP,
    partitions: int | None = None,
    pixels_per_task: int = PIXELS_PER_TASK,
) -> DataFrame:
    """Render every planned page: ``doc_id, page_num``, ``format`` if planned,
    the outcome, the image, and ``copies``.

    Equal planned rows are counted first, unless ``copies`` is planned, and
    rendered once; ``repeat_copies`` gives a row per request again. A document
    opens once per group of ``pages_per_group`` page numbers. Groups are packed
    into tasks by their planned pixels, so that tasks cost alike and their
    number follows from the work; a plan without sizes is dealt out by hash.
    Packing stores the plan in the shared folder when called. ``partitions``
    fixes the number of tasks. ``make_renderer`` is called on the executors.
    Only small planned rows are shuffled; documents given by path are read
    inside the task. For documents given as bytes see ``map_contents``.
    """
    stage = _Stage(planned, make_renderer, source)
    pages = _counted(planned).withColumn("_group", _page_group(pages_per_group))
    if {"width", "height"} <= set(planned.columns):
        pixels = F.col("width").cast("bigint") * F.col("height")
        packed, slots = pack_pages(pages, pixels, pixels_per_task, partitions)
        dealt = packed.repartitionById(slots, "_slot")
    else:
        dealt = pages.repartition(partitions or default_partitions(planned), "doc_id", "_group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _OpenDocument(stage.renderer(), source)
        try:
            for batch in batches:
                yield from _batched(stage.rows(_as_dicts(batch), opened), stage.schema(batch.schema))
        finally:
            opened.leave()

    return dealt.sortWithinPartitions("doc_id", "_group", "page_num").mapInArrow(run, stage.ddl)


def map_contents(
    planned: DataFrame,
    documents: DataFrame,
    make_renderer: Callable[[], Renderer | None],
    content: str = "content",
    pages_per_group: int = PAGES_PER_TABLE,
) -> DataFrame:
    """``map_pages`` for documents held as bytes (``doc_id`` and ``content``).

    The bytes meet the pages per group, not per page: the pages of a group are
    one row (stored in the shared folder when called), which is joined with the
    document's bytes by document and group. So a document crosses the network
    once for each group of its pages, a document of very many pages is rendered
    by many tasks, and a task streams its groups. ``render`` gets the planned
    row; a page whose document is missing or null is a failure. Of documents
    with the same id the least content counts.
    """
    stage = _Stage(planned, make_renderer, content)
    pages = _counted(planned)
    whole = F.struct(*[F.col(f"`{name}`") for name in pages.columns])
    grouped = pages.groupBy("doc_id", _page_group(pages_per_group).alias("_group"))
    groups = stored(grouped.agg(F.collect_list(whole).alias("_pages")), "groups")
    known = documents.select(F.col("doc_id").alias("of_doc"), F.col(content).alias("content"))
    contents = groups.select(F.col("doc_id").alias("for_doc"), F.col("_group").alias("for_group")).join(
        known, F.col("for_doc") == F.col("of_doc")
    )
    contents = contents.select("for_doc", "for_group", "content")
    # A merge join gives a group's rows, one per document of its id, one after the other.
    same = (F.col("doc_id") == F.col("for_doc")) & F.col("_group").eqNullSafe(F.col("for_group"))
    met = groups.join(contents.hint("merge"), same, "left").select("doc_id", "_group", "_pages", "content")

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, Any, bytes | None]]:
        """Each group once: its key, its pages, and the least content."""
        key = pages_of = least = None
        for batch in batches:
            names = zip(batch.column("doc_id").to_pylist(), batch.column("_group").to_pylist())
            for name, group, document in zip(names, batch.column("_pages"), batch.column("content")):
                if name != key:
                    if key is not None:
                        yield key, pages_of.as_py(), least
                    key, pages_of, least = name, group, None
                if document.is_valid:
                    found = document.as_py()
                    least = found if least is None else min(least, found)
        if key is not None:
            yield key, pages_of.as_py(), least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = stage.schema(pa.schema(list(first.schema.field("_pages").type.value_type)))
        opened = _OpenDocument(stage.renderer(), content)
        rows = (
            {**page, "_group": group, content: document}
            for (_, group), pages, document in one_by_one(chain([first], batches))
            for page in sorted(pages, key=lambda page: page["page_num"])
        )
        try:
            yield from _batched(stage.rows(rows, opened), schema)
        finally:
            opened.leave()

    return met.mapInArrow(run, stage.ddl)


@dataclass(frozen=True)
class InspectedPage:
    """Size in points and the kinds of objects on one page."""

    width_pt: float
    height_pt: float
    object_types: tuple[str, ...] = ()


_INSPECTED = [
    ("num_pages", pa.int32(), "int"),
    ("page_num", pa.int32(), "int"),
    ("width_pt", pa.float32(), "float"),
    ("height_pt", pa.float32(), "float"),
    ("object_types", pa.list_(pa.string()), "array<string>"),
    ("error", pa.string(), "string"),
]


def inspect_documents(
    docs: DataFrame,
    inspect: Callable[[Any], Iterable[InspectedPage]],
    source: str = "content",
) -> DataFrame:
    """Let ``inspect`` list the pages of each document: one row per page, or a
    single row with ``error`` if it fails. Documents without pages give one
    row with ``num_pages`` 0. Narrow: documents stay in their partition.
    """

    def page_row(doc_id: Any, number: int, count: int, page: InspectedPage) -> dict[str, Any]:
        sizes = {"width_pt": page.width_pt, "height_pt": page.height_pt, "object_types": list(page.object_types)}
        return {"doc_id": doc_id} | _checked({"num_pages": count, "page_num": number} | sizes, _INSPECTED)

    def rows_of(doc_id: Any, document: Any) -> list[dict[str, Any]]:
        try:
            pages = list(inspect(document))
            rows = [page_row(doc_id, number, len(pages), page) for number, page in enumerate(pages, start=1)]
        except Exception as problem:  # noqa: BLE001 - user code may raise or return anything
            return [{"doc_id": doc_id, "error": f"{LOAD_FAILED}{_reason(problem)}"}]
        return rows or [{"doc_id": doc_id, "num_pages": 0}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [("doc_id", batch.schema.field("doc_id").type)]
            schema = pa.schema(fields + [(name, arrow_type) for name, arrow_type, _ in _INSPECTED])
            documents = zip(batch.column("doc_id").to_pylist(), batch.column(source))
            rows = (row for doc_id, document in documents for row in rows_of(doc_id, document.as_py()))
            yield from _batched(rows, schema)

    ddl = [f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"]
    ddl += [f"{name} {spark_type}" for name, _, spark_type in _INSPECTED]
    return docs.select("doc_id", source).mapInArrow(run, ", ".join(ddl))


def inspected_documents(inspected: DataFrame) -> DataFrame:
    """``doc_id, num_pages, error``, one row per document id: what a plan needs
    of the documents. Combines before the shuffle."""
    return inspected.groupBy("doc_id").agg(F.max("num_pages").alias("num_pages"), F.max("error").alias("error"))


def inspected_pages(inspected: DataFrame) -> DataFrame:
    """``doc_id, page_num, width_pt, height_pt`` of the pages found."""
    return inspected.where(F.col("page_num").isNotNull()).select("doc_id", "page_num", "width_pt", "height_pt")


def inspected_objects(inspected: DataFrame) -> DataFrame:
    """``doc_id, page_num, object_type``, one row per page object."""
    return inspected.select("doc_id", "page_num", F.explode("object_types").alias("object_type"))
