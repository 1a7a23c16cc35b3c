"""Listing storage level by level, as a table.

The folders of a level are rows of a stored table, the frontier; a Python data
source lists them, a partition per part file of the frontier, and streams what
it finds in bounded batches. The folders found are the next frontier. So the
driver knows the number of levels and of part files, never a list of files or
folders. A pattern is expanded in the same way, one path component a level.

Names that begin with ``_`` or ``.`` are passed over, as Spark's file scans do;
links to folders are not followed below the path itself, so a listing ends.
"""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioscale.session import default_partitions, work_folder
from folioscale.sources.store import open_store

ROWS_PER_BATCH = 4096
_DDL = "path string, length bigint, is_folder boolean"
_SCHEMA = pa.schema([("path", pa.string()), ("length", pa.int64()), ("is_folder", pa.bool_())])
_WILD = re.compile(r"[*?\[{\\]")


class FolderListing(DataSource):
    """``path, length, is_folder`` of all entries of the folders in a stored
    table. Options: ``frontier``, the table's URI; ``suffix`` of the names of
    files, in any case, and their ``min_bytes``; ``pattern``, a regular
    expression for whole names."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return _DDL

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(dict(self.options))


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        options = {key.lower(): value for key, value in options.items()}
        self.frontier = options["frontier"]
        self.suffix = options.get("suffix", "").lower()
        self.pattern = options.get("pattern")
        self.min_bytes = int(options.get("min_bytes", "0"))

    def partitions(self) -> Sequence[InputPartition]:
        store, folder = open_store(self.frontier)
        names = (info.base_name for info in store.get_file_info(fs.FileSelector(folder)))
        parts = [InputPartition(f"{self.frontier}/{name}") for name in names if name.startswith("part-")]
        return parts or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        wanted = re.compile(self.pattern, re.DOTALL).fullmatch if self.pattern else None
        rows: list[tuple[str, int, bool]] = []
        for folder in _frontier_rows(partition.value):
            for name, length, is_folder in _entries(folder):
                if name.startswith(("_", ".")) or (wanted and not wanted(name)):
                    continue
                if is_folder or (length >= self.min_bytes and name.lower().endswith(self.suffix)):
                    rows.append((posixpath.join(folder, name), length, is_folder))
                if len(rows) >= ROWS_PER_BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, int, bool]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values) for values in zip(*rows)], schema=_SCHEMA)


def _frontier_rows(part: str | None) -> Iterator[str]:
    if part is None:
        return
    store, path = open_store(part)
    with store.open_input_file(path) as file:
        for batch in pq.ParquetFile(file).iter_batches(1024, columns=["path"]):
            yield from batch.column("path").to_pylist()


def _entries(uri: str) -> Iterator[tuple[str, int, bool]]:
    """Name, length and whether it is a folder, of each entry. A folder that
    has gone meanwhile has none."""
    store, folder = open_store(uri)
    if store.type_name == "local":
        try:
            with os.scandir(folder) as found:
                yield from filter(None, map(_local_entry, found))
        except FileNotFoundError:
            return
        return
    for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        is_folder = info.type == fs.FileType.Directory
        yield info.base_name, 0 if is_folder else info.size or 0, is_folder


def _local_entry(entry: os.DirEntry) -> tuple[str, int, bool] | None:
    try:
        if entry.is_dir():
            return None if entry.is_symlink() else (entry.name, 0, True)
        return entry.name, entry.stat().st_size, False
    except OSError:  # gone, or a link to nowhere
        return None


def name_pattern(component: str) -> str:
    """A path component with ``* ? [a-z] [^a] {one,two}`` and ``\\`` as a regular expression."""
    out, depth, signs = [], 0, iter(component)
    for sign in signs:
        if sign == "*":
            out.append(".*")
        elif sign == "?":
            out.append(".")
        elif sign == "\\":
            out.append(re.escape(next(signs, "\\")))
        elif sign == "[":
            inside = "".join(iter(lambda: next(signs, "]"), "]"))
            out.append(f"[{'^' if inside[:1] in ('^', '!') else ''}{inside.lstrip('^!')}]")
        elif sign == "{":
            depth += 1
            out.append("(?:")
        elif sign == "}" and depth:
            depth -= 1
            out.append(")")
        else:
            out.append("|" if sign == "," and depth else re.escape(sign))
    return "".join(out)


def _split_pattern(uri: str) -> tuple[str, list[str]]:
    """The part without wild cards, and the components from the first one with any.
    A slash within braces belongs to its component's alternatives and is not understood."""
    parts = uri.split("/")
    first = next((n for n, part in enumerate(parts) if n > 2 and _WILD.search(part)), len(parts))
    return "/".join(parts[:first]) or "/", parts[first:]


def _storage(spark: SparkSession, path: str):
    """The path and its storage as Hadoop sees them: without a scheme the
    cluster's default one applies."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def _qualified(spark: SparkSession, path: str) -> str:
    place, store = _storage(spark, path)
    return re.sub("^file:/(?!//)", "file:///", store.makeQualified(place).toString())


def _status(spark: SparkSession, uri: str) -> tuple[int, bool]:
    """Length of the one thing at ``uri``, and whether it is a folder; raises if there is none."""
    place, store = _storage(spark, uri)
    status = store.getFileStatus(place)
    return (0, True) if status.isDirectory() else (status.getLen(), False)


def path_exists(spark: SparkSession, path: str) -> bool:
    place, store = _storage(spark, path)
    return store.exists(place)


def _level(folders: DataFrame, **options: str) -> DataFrame:
    """What lies in the folders, stored: each folder is listed once."""
    spark = folders.sparkSession
    spark.dataSource.register(FolderListing)
    place = work_folder(spark, "listing")
    folders.select("path").repartition(default_partitions(folders), "path").write.parquet(f"{place}/frontier")
    found = spark.read.format(FolderListing.name()).options(frontier=f"{place}/frontier", **options).load()
    found.write.parquet(f"{place}/found")
    return spark.read.schema(found.schema).parquet(f"{place}/found")


def list_files(spark: SparkSession, path: str, suffix: str = "", recursive: bool = False, min_bytes: int = 0) -> DataFrame:
    """``path, length`` of the files in a folder (or that a pattern stands for),
    whose names end with ``suffix`` in any case. Lists when called, one job a
    level, into the shared folder; the result reads that."""
    base, components = _split_pattern(_qualified(spark, path))
    roots = spark.createDataFrame([(base, *_status(spark, base))], _DDL)
    for component in components:
        roots = _level(roots.where("is_folder"), pattern=name_pattern(component))
    if components and roots.isEmpty():
        raise FileNotFoundError(f"nothing matches {path}")
    levels = [roots.where(F.lower("path").endswith(suffix.lower()))]
    folders = roots.where("is_folder")
    while not folders.isEmpty():
        found = _level(folders, suffix=suffix, min_bytes=str(min_bytes))
        levels.append(found)
        folders = found.where("is_folder")
        if not recursive:
            break
    files = [level.where(~F.col("is_folder") & (F.col("length") >= min_bytes)) for level in levels]
    return reduce(DataFrame.unionAll, files).select("path", "length")
