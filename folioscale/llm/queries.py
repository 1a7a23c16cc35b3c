"""Registered queries of the text operators, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscale.llm.alignment import Tokenizers, alignment_digest
from folioscale.llm.classifier import classify
from folioscale.llm.decontam import contamination_digest, decontaminate
from folioscale.llm.licenses import license_digest, scan_licenses
from folioscale.llm.line_dedup import line_digest
from folioscale.llm.manifest import verified_digest
from folioscale.llm.neardup import near_duplicates
from folioscale.llm.oracles import MANIFEST
from folioscale.llm.pieces import PieceModel, encoded_digest
from folioscale.llm.pii import find_personal_data, personal_data_digest
from folioscale.llm.quality import quality_digest, quality_facts
from folioscale.llm.sharding import assign_shards
from folioscale.llm.substrings import remove_repeats, repeats_digest
from folioscale.llm.warc import archive_digest, archive_pages
from folioscale.session import apply_adaptive_conf
from pyspark.sql import functions as F

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return apply_adaptive_conf(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data_digest(find_personal_data(_table(spark, folder, "documents").select("doc_id", "text")))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_digest(scan_licenses(_table(spark, folder, "documents")))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_digest(_table(spark, folder, "documents").select("doc_id", "text"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_digest(quality_facts(_table(spark, folder, "documents").select("doc_id", "text")))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    return contamination_digest(decontaminate(docs, benchmark))


def op6_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return encoded_digest(_table(spark, folder, "documents").select("doc_id", "text"), PieceModel())


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(_table(spark, folder, "documents").select("doc_id", "text"), width=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = assign_shards(_table(spark, folder, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_web_archive(spark: SparkSession, folder: str) -> DataFrame:
    return archive_digest(archive_pages(_table(spark, folder, "pages").select("page_id", "url", "html")))


def op10_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeats_digest(remove_repeats(_table(spark, folder, "documents")))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return verified_digest(_table(spark, folder, "documents"))


def op12_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment_digest(_table(spark, folder, "documents"), Tokenizers(BYTE_BPE, PIECE_BPE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_personal_data,
        op2_license_scan,
        op3_line_dedup,
        op4_quality_rules,
        op5_decontamination,
        op6_sentence_pieces,
        op7_near_duplicates,
        op8_sharding,
        op9_web_archive,
        op10_repeated_passages,
        op11_merkle_manifest,
        op12_quality_classifier,
        op13_token_alignment,
    )
}

ORACLES: dict[str, str] = {"op11_merkle_manifest": MANIFEST}
