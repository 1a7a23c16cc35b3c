"""Registered queries: a DataFrame and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from folioscale.session import apply_adaptive_conf
from workloads.fixtures import FIXTURES

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Driver tables and derived fixtures of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder.rstrip("/")
        self._read: dict[str, DataFrame] = {}
        self.spark = spark

    def _base(self, table: str) -> DataFrame:
        if table not in self._read:
            self._read[table] = self._spark.read.parquet(f"{self._folder}/{table}.parquet")
        return self._read[table]

    def __getattr__(self, name: str) -> DataFrame:
        if name in FIXTURES:
            text = FIXTURES[name]
            used = [table for table in BASE_TABLES if f"{{{table}}}" in text]
            return self._spark.sql(text, **{table: self._base(table) for table in used})
        if name in BASE_TABLES:
            return self._base(name)
        raise AttributeError(name)


@dataclass(frozen=True)
class Workload:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    uses: tuple[str, ...]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(apply_adaptive_conf(spark), folder))


WORKLOADS: dict[str, Workload] = {}

# Named parts of oracle texts: what they use, and their SELECT.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def workload(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        WORKLOADS[name] = Workload(name, build, sql, uses)
        return build

    return register


def part(name: str, sql: str, uses: tuple[str, ...] = ()) -> None:
    PARTS[name] = (uses, sql)


def oracle_text(item: Workload) -> str:
    """The oracle SELECT behind a WITH clause of all it depends on."""
    ctes: dict[str, str] = {}

    def add(name: str) -> None:
        if name in ctes:
            return
        if name in FIXTURES:
            ctes[name] = FIXTURES[name].format(**{table: table for table in BASE_TABLES})
            return
        uses, sql = PARTS[name]
        for used in uses:
            add(used)
        ctes[name] = sql

    for used in item.uses:
        add(used)
    if not ctes:
        return item.sql
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items()) + "\n" + item.sql
