"""Every registered query against its SQL on another engine."""

import os

import pytest

import __spark_entry__ as entry_module
from tests.compare import mismatch, oracle_connection
from workloads.registry import WORKLOADS

FOLDER = f"/root/testdata/sf{os.environ.get('TEST_SF', '0.001')}"


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(name for name, item in WORKLOADS.items() if item.sql))
def test_matches_oracle(spark, connection, name):
    assert mismatch(spark, WORKLOADS[name], FOLDER, connection) is None


def test_entry_and_registry(spark):
    frame = entry_module.entry(spark)
    assert {"doc_id", "page_num", "width", "height", "sink_key"} <= set(frame.columns)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
