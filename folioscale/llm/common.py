"""Column expressions, identities and intermediate storage shared by the text operators.

Rows of ``documents`` are identified by ``(doc_id, text_hash)``: ids may be null
or repeated, and rows equal in both are the same document.
"""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character unchanged."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split_words(text: Column, separator: str = WHITE_SPACE) -> Column:
    """The non-empty parts between separators; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def materialised(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions refer to without computing them again.

    Inside lambda functions a referenced column would otherwise be replaced by
    its whole expression and evaluated per element. A generator with one
    element is a border that no projection is merged across.
    """
    names = list(columns)
    struct = F.struct(*[columns[name].alias(name) for name in names])
    kept = [F.col(f"`{name}`") for name in df.columns if name not in columns]
    return df.select(*kept, F.inline(F.array(struct)))


def folded(docs: DataFrame, **added: Column) -> DataFrame:
    """All columns of ``docs`` as one, ``row``, beside the ``added`` ones: whatever
    names a table has, they clash with none of an operator's own."""
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row")
    return docs.select(row, *[value.alias(name) for name, value in added.items()])


def unfolded(rows: DataFrame, docs: DataFrame, **replaced: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them replaced."""
    return rows.select(*[replaced.get(name, F.col("row").getField(name)).alias(name) for name in docs.columns])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a single-machine session may leave it unset; it gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="folioscale-"))
    return context.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
