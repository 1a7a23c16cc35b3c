"""From raw documents to encoded training text, in five stages.

Each stage reads what the one before kept, is written as Parquet and read again.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import folioscale
from folioscale.llm.common import shared_folder
from folioscale.llm.decontam import drop_contaminated
from folioscale.llm.line_dedup import drop_repeated_lines
from folioscale.llm.neardup import drop_near_duplicates
from folioscale.llm.pieces import PieceModel, encoded_digest
from folioscale.llm.quality import clean_documents
from folioscale.session import apply_adaptive_conf

# Functions that run in Python workers travel with the job.
cloudpickle.register_pickle_by_value(folioscale)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and the documents that fail or lose too much."""
    apply_adaptive_conf(spark)
    return clean_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that nearly repeat an earlier one go; all documents stay."""
    apply_adaptive_conf(spark)
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; sets are of five words."""
    apply_adaptive_conf(spark)
    return drop_near_duplicates(docs, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    apply_adaptive_conf(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and checks of the encoded texts, a row per document."""
    apply_adaptive_conf(spark)
    return encoded_digest(docs, PieceModel())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentence pieces", sentence_pieces),
]

#: Minhashes and the latent search are not said in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES, 1):
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{folder}/{number}")
        docs = spark.read.schema(result.schema).parquet(f"{folder}/{number}")
    return docs
