"""Input tables hold all of the rows that they are derived from."""

from pyspark.sql import functions as F

from tests.test_oracles import FOLDER
from workloads.registry import Tables


def test_bench_runs_hold_every_order(spark):
    tables = Tables(spark, FOLDER)
    runs, orders = tables.fx_bench_runs, tables.orders
    pages, output = runs.agg(F.sum("pages"), F.sum("output_bytes")).first()
    assert pages == orders.count()
    assert output == 3 * orders.agg(F.sum(F.round("o_totalprice").cast("long"))).first()[0]
    # A pivot still has holes.
    formats = runs.groupBy("file").agg(F.countDistinct("format").alias("n")).where("n < 3")
    assert formats.count() > 0
