"""Documents on storage or in memory."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscale.functions.display import size_in_mb
from folioscale.functions.names import base_name
from folioscale.session import default_partitions
from folioscale.sources.listing import list_files
from folioscale.sources.store import open_store

PDF = ".pdf"
_BATCH_BYTES = 32 << 20


def scan_corpus(spark: SparkSession, path: str, min_bytes: int = 0, recursive: bool = False) -> DataFrame:
    """PDF files under ``path`` (any storage URI, folder or pattern), smallest
    first: ``input, file_name, size_bytes``. Only folders are read, no files."""
    return _named(list_files(spark, path, PDF, recursive, min_bytes)).orderBy("size_bytes", "input")


def read_corpus(spark: SparkSession, path: str, min_bytes: int = 0, recursive: bool = False) -> DataFrame:
    """The same files, in no order, with their bytes in ``content``, for an
    inspector. A file that cannot be read (any more) has none."""
    files = list_files(spark, path, PDF, recursive, min_bytes)
    return read_contents(_named(files))


def _named(files: DataFrame) -> DataFrame:
    return files.select(
        F.col("path").alias("input"), base_name("path").alias("file_name"), F.col("length").alias("size_bytes")
    )


def read_contents(files: DataFrame, source: str = "input") -> DataFrame:
    """Add ``content``, the bytes of the file at ``source``, read in the task
    that holds the row and passed on in batches of bounded size. Paths are
    dealt out by hash, so a folder's files go to many tasks."""

    def load(uri: str | None) -> bytes | None:
        try:
            store, path = open_store(uri)
            with store.open_input_stream(path) as file:
                return file.read()
        except Exception:  # noqa: BLE001 - one unreadable file is one row without content
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, start = [], 0, 0
            for at, uri in enumerate(batch.column(source).to_pylist()):
                held.append(load(uri))
                size += len(held[-1] or b"")
                if size >= _BATCH_BYTES or at == batch.num_rows - 1:
                    rows = batch.slice(start, len(held))
                    columns = [*rows.columns, pa.array(held, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "content"])
                    held, size, start = [], 0, at + 1

    ddl = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in files.schema.fields)
    return files.repartition(default_partitions(files), source).mapInArrow(run, f"{ddl}, content binary")


def scan_buffers(df: DataFrame, doc_id: str, content: Column) -> DataFrame:
    """Documents already held as bytes: ``doc_id, input_type, size_bytes,
    content``."""
    return df.select(
        F.col(doc_id).alias("doc_id"),
        F.lit("buffer").alias("input_type"),
        F.octet_length(content).cast("bigint").alias("size_bytes"),
        content.alias("content"),
    )


def corpus_listing(docs: DataFrame) -> DataFrame:
    """Documents by ascending size; the id breaks ties."""
    return docs.orderBy("size_bytes", "doc_id")


def doc_info(docs: DataFrame) -> DataFrame:
    """Base name, size in MB with two decimals, and page count."""
    return docs.select(
        "doc_id",
        base_name("input").alias("base_name"),
        F.concat(size_in_mb("size_bytes"), F.lit(" MB")).alias("size"),
        "num_pages",
    )
