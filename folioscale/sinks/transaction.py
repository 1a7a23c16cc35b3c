"""Writing images so that a run leaves all of its files or none.

Each task writes its images, with their part of the manifest, into one file in
a folder of the run, ``_run-<id>`` in the target folder, which listings pass
over. If the job ends, the driver commits: one file names the parts of the
tasks that count. If it fails, the driver deletes the folder. A committed run is
then published by a second job, which puts each image in its place; repeating
it does no harm, so a run that was interrupted there is finished later
(``resume_conversion``). A run's folder holds a file per task, however many
images there are, so the driver's deletion does not grow with them.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from folioscale.functions.formats import format_mime
from folioscale.functions.options import SINK_FIELDS
from folioscale.sinks.files import inside, put_file
from folioscale.sources.store import open_store

_RUN = "_run-"
_PARTS = "_parts.json"
#: A row group of a part is read at once when its images are put in their places.
_GROUP_BYTES = 32 << 20
_STAGED = ("success", "error", "image", "target", "mime")
_ADDED = [("success", pa.bool_()), ("error", pa.string()), ("target", pa.string()), ("size_bytes", pa.int64())]


def check_sink_settings(settings: Mapping[str, str | None], fallback: Mapping[str, str | None] | None = None) -> None:
    """Raise if a required setting of an object store is missing or empty, also after the fallback."""
    fallback = fallback or {}
    missing = [name for name in SINK_FIELDS if not (settings.get(name) or fallback.get(name))]
    if missing:
        raise ValueError(f"Sink settings are incomplete: {', '.join(missing)}")


class PageImages(DataSource):
    """The sink. Options: ``root``, a URI; ``run``, the run's id; ``settings``, as
    JSON, if the store needs all of the required ones."""

    @classmethod
    def name(cls) -> str:
        return "page_images"

    def writer(self, schema, overwrite: bool) -> "PageWriter":
        return PageWriter(dict(self.options))


@dataclass
class PartWritten(WriterCommitMessage):
    part: str


class PageWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        options = {key.lower(): value for key, value in options.items()}
        self.root, self.run = options["root"], options["run"]
        if "settings" in options:
            check_sink_settings(json.loads(options["settings"]))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = open_store(self.root)
        run = posixpath.join(base, _RUN + self.run)
        part = f"part-{uuid.uuid4().hex}.parquet"
        writer = None
        with store.open_output_stream(f"{run}/{part}") as file:
            for batch in iterator:
                writer = writer or pq.ParquetWriter(file, batch.schema, compression={"image": "none"}, use_dictionary=False)
                for rows in _row_groups(batch):
                    writer.write_batch(rows)
            if writer:
                writer.close()
        return PartWritten(part if writer else "")

    def commit(self, messages: Sequence[WriterCommitMessage | None]) -> None:
        store, base = open_store(self.root)
        parts = sorted(message.part for message in messages if message is not None and message.part)
        put_file(store, posixpath.join(base, _RUN + self.run, _PARTS), json.dumps(parts).encode(), "application/json", set())

    def abort(self, messages: Sequence[WriterCommitMessage | None]) -> None:
        discard_run(self.root, self.run)


def _row_groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded size, at least a row each."""
    start, held = 0, 0
    for at, size in enumerate(pc.binary_length(batch.column("image")).to_pylist()):
        if at > start and held + (size or 0) > _GROUP_BYTES:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def discard_run(root: str, run: str) -> None:
    """Delete what a run has not published; again if a task of it that is
    being ended began a file meanwhile."""
    store, base = open_store(root)
    for attempt in range(10):
        try:
            store.delete_dir(posixpath.join(base, _RUN + run))
        except FileNotFoundError:
            return
        except OSError:
            if attempt == 9:
                raise
            time.sleep(0.1)
        else:
            return


def stage_images(
    results: DataFrame, root: str, target: Column, error: str = "", settings: Mapping[str, str | None] | None = None
) -> str:
    """Write the images of a rendered table (or of any with ``success, error,
    image, format``) into a run's folder, all or none; returns the run's id.
    ``target`` is a page's place under ``root``."""
    spark = results.sparkSession
    spark.dataSource.register(PageImages)
    run = uuid.uuid4().hex
    # Here and not in the tasks: one that still runs when its job is aborted must not make it anew.
    store, base = open_store(root)
    store.create_dir(posixpath.join(base, _RUN + run), recursive=True)
    kept = [name for name in results.columns if name not in ("success", "error", "image", "size_bytes", "target", "mime")]
    ready = results.select(*kept, "success", "error", "image", target.alias("target"), format_mime("format").alias("mime"))
    options = {"root": root, "run": run}
    if settings is not None:
        options["settings"] = json.dumps(dict(settings))
    ready.write.format(PageImages.name()).options(**options).mode("append").save()
    return run


def _parts(root: str, run: str) -> list[str] | None:
    """The parts that count, one per task; None if the run is not committed."""
    store, base = open_store(root)
    try:
        with store.open_input_stream(posixpath.join(base, _RUN + run, _PARTS)) as file:
            return json.loads(file.read())
    except FileNotFoundError:
        return None


def publish_run(spark: SparkSession, root: str, run: str, target_name: str, error: str) -> DataFrame | None:
    """The outcome of each page of a committed run, with its image put in its
    place, a task per part. Lazy: save it, then ``discard_run``. Repeating it
    puts the same images there again."""
    parts = _parts(root, run)
    if not parts:
        return None
    folder = f"{_RUN}{run}"
    staged = spark.read.parquet(f"{root.rstrip('/')}/{folder}/{parts[0]}").schema
    kept = [name for name in staged.names if name not in _STAGED]

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        made: set[str] = set()
        for number in (number for batch in batches for number in batch.column("id").to_pylist()):
            with store.open_input_file(posixpath.join(base, folder, parts[number])) as file:
                images = pq.ParquetFile(file)
                for group in range(images.num_row_groups):
                    for batch in images.read_row_group(group).to_batches():
                        done = [_put(store, base, row, made, error) for row in _rows(batch)]
                        columns = [batch.column(name) for name in kept]
                        columns += [pa.array([row.get(name) for row in done], kind) for name, kind in _ADDED]
                        yield pa.RecordBatch.from_arrays(columns, kept + [name for name, _ in _ADDED])

    ddl = [f"{name} {staged[name].dataType.simpleString()}" for name in kept]
    ddl += ["success boolean", "error string", "target string", "size_bytes bigint"]
    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(run_batches, ", ".join(ddl)).withColumnRenamed("target", target_name)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The staged columns of each row; one image at a time is copied."""
    values = [batch.column(name) for name in _STAGED]
    return ({name: value.as_py() for name, value in zip(_STAGED, row)} for row in zip(*values))


def _put(store: fs.FileSystem, base: str, row: dict, made: set[str], error: str) -> dict:
    if not row["success"] or row["image"] is None:
        return {"success": row["success"], "error": row["error"]}
    try:
        put_file(store, inside(base, row["target"]), row["image"], row["mime"], made)
        return {"success": True, "target": row["target"], "size_bytes": len(row["image"])}
    except Exception as problem:  # noqa: BLE001 - one page fails, not the job
        return {"success": False, "error": f"{error}{problem}"}


def open_runs(root: str) -> dict[str, bool]:
    """Runs that were left under ``root``, and whether they are committed."""
    store, base = open_store(root)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    runs = [info.base_name.removeprefix(_RUN) for info in found if info.base_name.startswith(_RUN)]
    return {run: _parts(root, run) is not None for run in runs}
