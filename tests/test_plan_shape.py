"""Physical plans: what is read, how often it is shuffled, how skew is met."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from folioscale.operators.pages import expand_pages
from folioscale.operators.results import doc_rollup
from folioscale.plans.conversion import page_plan
from workloads.registry import WORKLOADS, Tables

FOLDER = "/root/testdata/sf0.001"


def executed(frame):
    """The plan after adaptive execution."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def initial(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    return len(re.findall(r"Exchange hashpartitioning", plan))


@pytest.fixture
def no_broadcast(conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")


def test_only_needed_columns_are_read(spark):
    plan = initial(entry_module.queries()["expand_pages"](spark, FOLDER))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_rollup_shuffles_once_after_partial_aggregation(spark):
    results = spark.range(100).repartition(3).select(
        F.col("id").alias("doc_id"), F.lit(1).alias("page_num"), F.lit(True).alias("success"),
        *[F.lit(1).alias(name) for name in ("size_bytes", "render_ms", "encode_ms")],
    )
    plan = initial(doc_rollup(results))
    assert exchanges(plan) == 1 and "partial_sum" in plan


@pytest.mark.parametrize(
    "name, most",
    [
        ("scan_detection", 1),
        ("bench_pivot", 2),  # one is the fixture's own
        ("bench_rollup", 2),
        ("error_rollup", 2),
        ("success_averages", 2),
    ],
)
def test_shuffles(spark, no_broadcast, name, most):
    assert exchanges(initial(entry_module.queries()[name](spark, FOLDER))) <= most


def test_pages_meet_in_one_shuffle(spark, no_broadcast):
    """Requests, objects and sizes share one exchange by (document, page); the
    others are the fixture's own aggregation, the documents without requests
    (2), the options (2), and the join with the documents (2)."""
    t = Tables(spark, FOLDER)
    geometry = t.fx_page_geometry
    own = exchanges(initial(geometry))
    plan = initial(entry_module.queries()["page_plan"](spark, FOLDER))
    assert exchanges(plan) - own == 1 + 2 + 2 + 2
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.fixture(scope="module")
def plans(spark):
    return {name: initial(item.run(spark, FOLDER)) for name, item in WORKLOADS.items()}


def test_no_query_pairs_rows_without_a_key(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


@pytest.fixture
def small_skew_limits(conf, no_broadcast):
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20000")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    # Small data would otherwise be merged into one map task, whose output
    # cannot be split.
    conf("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1000")


def test_hot_document_is_split(spark, small_skew_limits):
    """One document with two thirds of all requests: the join reads its
    partition in several parts."""
    requests = spark.range(0, 200_000, 1, 8).select(
        F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id") % 500).cast("bigint").alias("doc_id"),
        (F.xxhash64("id") % 9).cast("int").alias("page_num"),
    )
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(5).alias("num_pages"))
    assert "SortMergeJoin(skew=true)" in executed(expand_pages(docs, requests))


def test_hot_document_of_a_plan_is_split(spark, small_skew_limits):
    """The same for the render plan, where the pages of the document are
    distinct."""
    t = Tables(spark, FOLDER)
    requests = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id") % 500).cast("bigint").alias("doc_id"),
        F.col("id").cast("int").alias("page_num"),
    )
    docs = spark.range(500).select(
        F.col("id").alias("doc_id"), F.lit("/a.pdf").alias("input"), F.lit(60_000).alias("num_pages"),
        F.lit("png").alias("format_raw"), F.col("id").alias("job_id"),
    )
    plan = page_plan(docs, requests, t.fx_page_objects, t.fx_page_geometry, t.fx_job_options)
    assert "SortMergeJoin(skew=true)" in executed(plan.select("doc_id", "page_num", "width", "height"))


def test_options_are_broadcast_only_when_small(spark, conf):
    query = entry_module.queries()["attach_options"]
    assert "BroadcastHashJoin" in initial(query(spark, FOLDER))
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert "SortMergeJoin" in initial(query(spark, FOLDER))


def test_python_runs_only_where_it_must(plans):
    python = {"map_pages", "inspect_documents", "inspected_documents", "inspected_scan_sizes", "inspected_scans", "cache_attribution", "stream_stats", "trace_report"}
    python |= {"read_corpus", "map_contents", "content_conversion", "write_page_files", "write_page_objects"}
    for name, plan in plans.items():
        assert ("MapInArrow" in plan or "FlatMapCoGroupsInArrow" in plan) == (name in python), name
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
