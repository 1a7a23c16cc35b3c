"""From documents and page requests to a render plan and its report."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscale.constants import DEFAULT_PAGE_HEIGHT_PT, DEFAULT_PAGE_WIDTH_PT, SAVE_FAILED, UPLOAD_FAILED
from folioscale.functions.display import format_bytes
from folioscale.functions.formats import classify_input, format_error, normalize_format
from folioscale.functions.names import encode_component, sink_key, sink_path
from folioscale.functions.options import convert_options
from folioscale.operators.geometry import plan_page_size, side_limit
from folioscale.operators.page_table import gather_pages, repeat_copies, requested_pages
from folioscale.operators.pages import attach_options, valid_pages
from folioscale.operators.render import Renderer, map_contents, map_pages
from folioscale.operators.results import doc_rollup, rounded_ratio
from folioscale.sinks.images import pages_to_do, save_manifest
from folioscale.sinks.transaction import check_sink_settings, discard_run, open_runs, publish_run, stage_images
from folioscale.sources.listing import path_exists


def resolve_documents(docs: DataFrame, options: DataFrame) -> DataFrame:
    """Documents in a supported format with the settings of their job, only
    those that a page needs. The document's format wins over the job's."""
    accepted = docs.where(normalize_format("format_raw").isNotNull()).withColumnRenamed("format_raw", "format")
    resolved = attach_options(accepted, options.drop("format")).withColumn("settings", convert_options())
    settings = F.col("settings")
    return resolved.select(
        "doc_id",
        "num_pages",
        "input",
        settings["format"].alias("format"),
        settings["target_width"].alias("target_width"),
        settings["detect_scan"].alias("detect_scan"),
        _quality(settings).alias("quality"),
        settings["webp_method"].alias("webp_method"),
    )


def _quality(settings: Column) -> Column:
    """The one encoder setting that the format in question uses."""
    return (
        F.when(settings["format"] == "webp", settings["webp_quality"])
        .when(settings["format"] == "png", settings["png_compression"])
        .otherwise(settings["jpeg_quality"])
    )


def rejected_documents(docs: DataFrame) -> DataFrame:
    """Documents whose format is not supported, with the error text."""
    return docs.where(normalize_format("format_raw").isNull()).select(
        "doc_id", "format_raw", format_error("format_raw").alias("error")
    )


def _size_pages(docs: DataFrame, options: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages (``gather_pages``) that exist in an accepted document, with the
    document's settings and the size in pixels."""
    looks_scanned = (F.col("text_objects") == 0) & (F.col("image_objects") > 0)
    joined = valid_pages(pages.join(resolve_documents(docs, options), "doc_id"))
    prepared = joined.withColumns(
        {
            "page_num": F.col("page_num").cast("int"),
            "as_scan": F.col("detect_scan") & looks_scanned,
            "width_pt": F.coalesce(F.col("width_pt"), F.lit(DEFAULT_PAGE_WIDTH_PT).cast("float")),
            "height_pt": F.coalesce(F.col("height_pt"), F.lit(DEFAULT_PAGE_HEIGHT_PT).cast("float")),
        }
    )
    return plan_page_size(
        prepared,
        limit=side_limit(F.col("format")),
        target_width=F.col("target_width"),
        is_scan="as_scan",
    )


def page_plan(
    docs: DataFrame, requests: DataFrame, objects: DataFrame, geometry: DataFrame, options: DataFrame
) -> DataFrame:
    """One row per page to render: size in pixels, encoder settings, target
    key, and ``copies``, the number of requests for it.

    What is known about pages is gathered by (document, page) first, so that
    only slim, distinct rows meet the documents; that join AQE can split for a
    document with very many pages. Documents in unsupported formats are left
    out (see ``rejected_documents``), pages without a recorded size get the
    default one.
    """
    pages = gather_pages(requested_pages(docs, requests), objects, geometry)
    key_prefix = F.concat(F.lit("pages/"), F.col("doc_id").cast("string"))
    return _size_pages(docs, options, pages).select(
        "doc_id",
        "page_num",
        "copies",
        "input",
        classify_input("input").alias("input_type"),
        "format",
        "as_scan",
        "width",
        "height",
        "quality",
        "webp_method",
        sink_key(key_prefix, "page_num", "format").alias("sink_key"),
    )


def conversion_plan(
    docs: DataFrame, requests: DataFrame, objects: DataFrame, geometry: DataFrame, options: DataFrame
) -> DataFrame:
    """``page_plan`` with one row per request: a page requested twice is there
    twice."""
    return repeat_copies(page_plan(docs, requests, objects, geometry, options))


def conversion_report(
    docs: DataFrame,
    requests: DataFrame,
    objects: DataFrame,
    geometry: DataFrame,
    options: DataFrame,
    results: DataFrame,
) -> DataFrame:
    """Per document: what was planned, what came out of it, and what it cost.
    Planned pages without a result count as not rendered."""
    pages = gather_pages(requested_pages(docs, requests), objects, geometry, results)
    sized = _size_pages(docs, options, pages).withColumn("success", F.coalesce(F.col("success"), F.lit(False)))
    pixels = F.col("width").cast("bigint") * F.col("height") * F.col("copies")
    totals = doc_rollup(
        sized, copies=F.col("copies"), extra={"planned_pixels": F.sum(pixels).cast("bigint")}
    )
    total_ms = F.col("render_ms") + F.col("encode_ms")
    return totals.select(
        "doc_id",
        F.col("pages").alias("planned_pages"),
        "planned_pixels",
        "rendered_pages",
        "all_pages_ok",
        "output_bytes",
        format_bytes("output_bytes").alias("output_size"),
        total_ms.alias("total_ms"),
        rounded_ratio(total_ms, F.col("rendered_pages")).alias("avg_ms_per_page"),
    )


@dataclass(frozen=True)
class Conversion:
    """The saved manifest (all generations) and the totals of this run's pages."""

    manifest: DataFrame
    summary: dict[str, int | None]


def _folder() -> Column:
    return F.concat_ws("/", encode_component(F.col("doc_id").cast("string")), F.col("format"))


def _rendered(plan: DataFrame, make_renderer: Callable[[], Renderer | None], contents: DataFrame | None, how: dict[str, Any]) -> DataFrame:
    if contents is None:
        return map_pages(plan, make_renderer, **how)
    return map_contents(plan, contents, make_renderer, **how)


def _convert(
    rendered: DataFrame,
    root: str,
    manifest_path: str,
    target: Column,
    target_name: str,
    error: str,
    generation: int,
    settings: Mapping[str, str | None] | None = None,
) -> Conversion:
    """Stage, commit, publish, and add the outcomes to the manifest."""
    spark = rendered.sparkSession
    marked = rendered.withColumn("generation", F.lit(generation))
    run = stage_images(marked, root, target, error, settings)
    return _finish(spark, root, run, manifest_path, target_name, error, marked)


def _finish(
    spark: SparkSession, root: str, run: str, manifest_path: str, target_name: str, error: str, empty: DataFrame | None = None
) -> Conversion:
    outcome = publish_run(spark, root, run, target_name, error)
    if outcome is None:  # nothing was planned
        columns = [F.lit(None).cast("string").alias(target_name), F.lit(None).cast("bigint").alias("size_bytes")]
        outcome = empty.drop("image", "size_bytes").where("false").select("*", *columns)
    manifest, summary = save_manifest(outcome.withColumn("run", F.lit(run)), manifest_path, "append")
    discard_run(root, run)
    return Conversion(manifest, summary)


def _is_saved(spark: SparkSession, manifest_path: str, run: str) -> bool:
    """Whether a run's outcomes are in the manifest: its images are in place then."""
    return path_exists(spark, manifest_path) and not spark.read.parquet(manifest_path).where(F.col("run") == run).isEmpty()


def _must_be_new(spark: SparkSession, manifest_path: str) -> None:
    """A conversion that begins must not find a manifest; checked before any page is rendered."""
    if path_exists(spark, manifest_path):
        raise FileExistsError(f"PATH_ALREADY_EXISTS: {manifest_path}; go on with resume_conversion")


def convert_to_files(
    plan: DataFrame,
    make_renderer: Callable[[], Renderer | None],
    directory: str,
    manifest_path: str,
    prefix: str = "page",
    contents: DataFrame | None = None,
    **how: Any,
) -> DataFrame:
    """Render and write every planned page (``page_plan``) of documents given by
    path, or as bytes in ``contents`` (``doc_id, content``); returns the saved
    manifest. Images go straight from the renderer to storage in the same task,
    they are never shuffled. A job that fails leaves no files, one that ends
    leaves all (``sinks.transaction``); a page that fails is a row. ``how`` goes
    to ``map_pages``: ``partitions``, ``pages_per_group``, ``pixels_per_task``."""
    _must_be_new(plan.sparkSession, manifest_path)
    rendered = _rendered(plan, make_renderer, contents, how)
    target = sink_path(_folder(), F.lit(prefix), "page_num", "format")
    return _convert(rendered, directory, manifest_path, target, "output_path", SAVE_FAILED, 1).manifest


def convert_to_objects(
    plan: DataFrame,
    make_renderer: Callable[[], Renderer | None],
    uri: str,
    manifest_path: str,
    settings: Mapping[str, str | None] | None = None,
    fallback: Mapping[str, str | None] | None = None,
    key_prefix: str = "pages",
    contents: DataFrame | None = None,
    **how: Any,
) -> DataFrame:
    """The same to an object store: keys are ``key_prefix/<doc>/<format>/page_N.ext``.
    ``settings``, where the store needs them, and the prefix are checked before
    any page is rendered, and again when the writer is made."""
    if not key_prefix:
        raise ValueError("key_prefix must not be empty")
    if settings is not None:
        check_sink_settings(settings, fallback)
        settings = {**(fallback or {}), **{name: value for name, value in settings.items() if value}}
    _must_be_new(plan.sparkSession, manifest_path)
    rendered = _rendered(plan, make_renderer, contents, how)
    target = sink_key(F.concat_ws("/", F.lit(key_prefix), _folder()), "page_num", "format")
    return _convert(rendered, uri, manifest_path, target, "object_key", UPLOAD_FAILED, 1, settings).manifest


def resume_conversion(
    plan: DataFrame,
    make_renderer: Callable[[], Renderer | None],
    root: str,
    manifest_path: str,
    prefix: str = "page",
    key_prefix: str | None = None,
    contents: DataFrame | None = None,
    **how: Any,
) -> Conversion:
    """Go on with a conversion: finish or discard what an interrupted run left,
    then render only the planned pages whose latest outcome is no success, as a
    new generation of the manifest. With ``key_prefix`` to objects, else to files."""
    spark = plan.sparkSession
    to_objects = key_prefix is not None
    name, error = ("object_key", UPLOAD_FAILED) if to_objects else ("output_path", SAVE_FAILED)
    for run, committed in open_runs(root).items():
        if committed and not _is_saved(spark, manifest_path, run):
            _finish(spark, root, run, manifest_path, name, error)
        else:
            discard_run(root, run)
    generation, left = 1, plan
    if path_exists(spark, manifest_path):
        manifest = spark.read.parquet(manifest_path)
        generation = (manifest.agg(F.max("generation")).first()[0] or 0) + 1
        left = pages_to_do(plan, manifest)
    rendered = _rendered(left, make_renderer, contents, how)
    if to_objects:
        target = sink_key(F.concat_ws("/", F.lit(key_prefix), _folder()), "page_num", "format")
    else:
        target = sink_path(_folder(), F.lit(prefix), "page_num", "format")
    return _convert(rendered, root, manifest_path, target, name, error, generation)
