"""Writing page images and reading back what was written."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from folioscale.constants import SAVE_FAILED, UPLOAD_FAILED
from folioscale.functions.formats import format_mime
from folioscale.functions.names import encode_component, sink_key, sink_path
from folioscale.operators.results import rounded_ratio_of
from folioscale.sinks.files import inside, put_file
from folioscale.sinks.transaction import check_sink_settings
from folioscale.sources.listing import list_files
from folioscale.sources.store import open_store

_KEPT = ("doc_id", "page_num", "format", "copies", "width", "height", "render_ms", "encode_ms")


def _write(results: DataFrame, root: str, target: Column, target_name: str, error_prefix: str) -> DataFrame:
    kept = [name for name in _KEPT if name in results.columns]
    added = [
        ("success", pa.bool_(), "boolean"),
        ("error", pa.string(), "string"),
        (target_name, pa.string(), "string"),
        ("size_bytes", pa.int64(), "bigint"),
    ]

    def store_page(store: fs.FileSystem, base: str, row: dict[str, Any], made: set[str]) -> dict[str, Any]:
        if not row["success"] or row["image"] is None:
            return {"success": row["success"], "error": row["error"]}
        try:
            put_file(store, inside(base, row["target"]), row["image"], row["mime"], made)
            return {"success": True, target_name: row["target"], "size_bytes": len(row["image"])}
        except Exception as problem:  # noqa: BLE001 - one page fails, not the job
            return {"success": False, "error": f"{error_prefix}{problem}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        made: set[str] = set()
        for batch in batches:
            schema = pa.schema(
                [(name, batch.schema.field(name).type) for name in kept] + [(name, kind) for name, kind, _ in added]
            )
            rows = [{**{name: row[name] for name in kept}, **store_page(store, base, row, made)} for row in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = [f"{name} {results.schema[name].dataType.simpleString()}" for name in kept]
    ddl += [f"{name} {spark_type}" for name, _, spark_type in added]
    ready = results.select(
        *kept, "success", "error", "image", target.alias("target"), format_mime("format").alias("mime")
    )
    return ready.mapInArrow(run, ", ".join(ddl))


def _folder(results: DataFrame) -> Column:
    return F.concat_ws("/", encode_component(F.col("doc_id").cast("string")), F.col("format"))


def write_page_files(
    results: DataFrame, directory: str, prefix: str = "page", folder: Column | None = None
) -> DataFrame:
    """Write each successful image to ``directory/<doc>/<format>/prefix_N.ext``
    on the executors; returns a manifest with ``output_path`` relative to
    ``directory`` instead of the image. A page that cannot be written becomes a
    failed row. ``directory`` is a URI or an absolute path.

    Lazy: nothing is written until the manifest is, and each action writes
    again. Save it once (``write_manifest``) and go on from the saved one.
    """
    folder = _folder(results) if folder is None else folder
    target = sink_path(folder, F.lit(prefix), "page_num", "format")
    return _write(results, directory, target, "output_path", SAVE_FAILED)


def write_page_objects(results: DataFrame, uri: str, key_prefix: Column | None = None) -> DataFrame:
    """The same to an object store: keys are ``key_prefix/page_N.ext``, the
    content type is set. An empty prefix would give keys that begin with a
    slash, so there it fails at once."""
    key_prefix = _folder(results) if key_prefix is None else key_prefix
    checked = F.when(F.length(key_prefix) > 0, key_prefix).otherwise(
        F.raise_error(F.lit("key_prefix must not be empty"))
    )
    return _write(results, uri, sink_key(checked, "page_num", "format"), "object_key", UPLOAD_FAILED)


def write_manifest(results: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Save page outcomes by format, without images; returns the saved table."""
    return save_manifest(results, path, mode)[0]


def save_manifest(results: DataFrame, path: str, mode: str = "errorifexists") -> tuple[DataFrame, dict[str, int | None]]:
    """The same, with the totals of the pages written (those of ``job_summary``
    that are sums over pages), observed by the job that writes. Totals of a
    stage that Spark ran again after a loss may count its rows twice; those of
    the saved table are exact."""
    pages = results.drop("image")
    copies = F.col("copies") if "copies" in pages.columns else F.lit(1)
    copies = copies.cast("bigint")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(F.coalesce(value, F.lit(0)) * copies), F.lit(0)).cast("bigint")

    seen = Observation("pages written")
    observed = pages.observe(
        seen,
        total(F.lit(1)).alias("pages"),
        total(F.when(F.col("success"), 1)).alias("rendered_pages"),
        total(F.col("size_bytes")).alias("output_bytes"),
        total(F.coalesce("render_ms", F.lit(0)) + F.coalesce("encode_ms", F.lit(0))).alias("total_ms"),
    )
    observed.write.partitionBy("format").mode(mode).parquet(path)
    summary = dict(seen.get)
    summary["avg_ms_per_page"] = rounded_ratio_of(summary["total_ms"], summary["rendered_pages"])
    return results.sparkSession.read.schema(pages.schema).parquet(path), summary


def latest_outcomes(manifest: DataFrame, keys: Sequence[str] = ("doc_id", "page_num", "format")) -> DataFrame:
    """Per page its outcome of the last generation that has one; of several in
    one generation a success, then by their values."""
    rest = [name for name in manifest.columns if name not in (*keys, "generation", "success")]
    latest = F.max(F.struct("generation", "success", *rest)).alias("latest")
    return manifest.groupBy(*keys).agg(latest).select(*keys, "latest.*")


def pages_to_do(plan: DataFrame, manifest: DataFrame) -> DataFrame:
    """The planned pages whose latest outcome is no success."""
    keys = ["doc_id", "page_num", "format"]
    done = latest_outcomes(manifest).where("success").select(*keys)
    return plan.join(done, keys, "left_anti")


def list_outputs(spark: SparkSession, directory: str) -> DataFrame:
    """``doc_id`` (text), ``format``, ``size_bytes`` of every file found under
    ``directory/<doc>/<format>/``, whoever put it there."""
    files = list_files(spark, directory, recursive=True)
    parts = F.split("path", "/")
    return files.select(
        F.element_at(parts, -3).alias("doc_id"),
        F.element_at(parts, -2).alias("format"),
        F.col("length").alias("size_bytes"),
    )
