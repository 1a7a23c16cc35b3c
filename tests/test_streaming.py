"""The streaming match against the batch one on the same logs."""

import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscale.operators.correlate import correlate_requests
from folioscale.session import checkpoint_location
from folioscale.streaming.correlate import correlate_requests_stream, step
from workloads.registry import Tables

FAR = 10**12


def write_in_order(frame, time_column, folder, files):
    """Parquet files in time order, so that the watermark moves from one to
    the next; the last one carries a row far in the future."""
    edge = frame.agg(F.max(time_column)).first()[0] // files + 1
    for part in range(files):
        rows = frame.where((F.col(time_column) / edge).cast("int") == part)
        rows.coalesce(1).write.mode("append").parquet(str(folder))
    sentinel = frame.limit(1).withColumns({"request_id": F.lit(-1).cast("bigint"), time_column: F.lit(FAR).cast("bigint")})
    sentinel.coalesce(1).write.mode("append").parquet(str(folder))


def logs(spark, case):
    if case == "tables":
        tables = Tables(spark, "/root/testdata/sf0.001")
        return tables.fx_requests, tables.fx_responses
    requests = spark.range(50_000).selectExpr("5L as request_id", "id * 37 as sent_ms")
    responses = spark.range(50_000).selectExpr(
        "5L as request_id", "id * 41 % 800000 as recv_ms", "if(id % 7 = 0, null, id % 3 > 0) as ok", "if(id % 5 = 0, null, id) as bytes"
    )
    return requests, responses


@pytest.mark.parametrize("case", ["tables", "one hot id"])
def test_stream_equals_batch(spark, conf, tmp_path, case):
    conf("spark.sql.shuffle.partitions", "4")
    requests, responses = logs(spark, case)
    write_in_order(requests, "sent_ms", tmp_path / "req", 3)
    write_in_order(responses, "recv_ms", tmp_path / "resp", 3)

    def stream(frame, name):
        reader = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1)
        return reader.parquet(str(tmp_path / name))

    matched = correlate_requests_stream(stream(requests, "req"), stream(responses, "resp"))
    query = (
        matched.writeStream.format("memory")
        .queryName("matched")
        .outputMode("append")
        .option("checkpointLocation", checkpoint_location(spark, f"matched-{uuid.uuid4().hex}"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    columns = ["request_id", "sent_ms", "recv_ms", "bytes", "status"]
    streamed = spark.table("matched").where("request_id >= 0").select(*columns)
    batch = correlate_requests(requests, responses).select(*columns)
    assert Counter(map(tuple, streamed.collect())) == Counter(map(tuple, batch.collect()))
    assert {row["status"] for row in batch.select("status").distinct().collect()} == {"ok", "error", "timeout"}
    assert batch.count() == requests.distinct().count()
    # What is left is the sentinel that waits for an answer: one request, one timer.
    left = [progress["stateOperators"][0]["numRowsTotal"] for progress in query.recentProgress if progress["stateOperators"]]
    assert left[-1] <= 4, left


def test_step_equals_a_plain_match():
    draw = random.Random(4)
    for _ in range(400):
        moments = [(draw.randrange(30), draw.randrange(3), draw.randrange(-1, 3)) for _ in range(draw.randrange(12))]
        moments = [(at, kind, -1 if kind == 0 else size) for at, kind, size in moments]
        cuts = sorted(draw.randrange(60) for _ in range(3)) + [100]
        found, waiting, ahead = [], None, set()
        before = -1
        for cut in cuts:  # what arrives before each cut of the watermark, in any order
            arriving = {m for m in moments if before < m[0] and (m[0] <= cut or draw.random() < 0.5)}
            settled, ahead, waiting = step(set(ahead) | arriving, waiting, cut, 7)
            found += settled
            before = cut
        sent = sorted({at for at, kind, _ in moments if kind == 0})
        expected = []
        for n, at in enumerate(sent):
            limit = min(at + 7, sent[n + 1] - 1 if n + 1 < len(sent) else 100)
            answers = [(t, -kind, -size) for t, kind, size in moments if kind and at <= t <= limit]
            if answers:
                recv, kind, size = min(answers)
                expected.append((at, recv, None if size == 1 else -size, "ok" if kind == -2 else "error"))
            else:
                expected.append((at, None, None, "timeout"))
        assert sorted(found) == expected and not ahead and waiting is None


def test_answers_come_once_the_watermark_has_passed(spark, conf, tmp_path):
    """A response settles its request in the next batch, long before the time limit."""
    conf("spark.sql.shuffle.partitions", "2")
    requests, responses = tmp_path / "req", tmp_path / "resp"
    req, resp = "request_id bigint, sent_ms bigint", "request_id bigint, recv_ms bigint, ok boolean, bytes bigint"
    spark.createDataFrame([], req).coalesce(1).write.parquet(str(requests))
    spark.createDataFrame([], resp).coalesce(1).write.parquet(str(responses))
    matched = correlate_requests_stream(
        spark.readStream.schema(req).parquet(str(requests)), spark.readStream.schema(resp).parquet(str(responses))
    )
    writer = matched.writeStream.format("memory").queryName("prompt").outputMode("append")
    query = writer.option("checkpointLocation", checkpoint_location(spark, f"prompt-{uuid.uuid4().hex}")).start()
    try:
        def push(sent, received):
            spark.createDataFrame(received, resp).coalesce(1).write.mode("append").parquet(str(responses))
            spark.createDataFrame(sent, req).coalesce(1).write.mode("append").parquet(str(requests))
            query.processAllAvailable()
            return sorted(map(tuple, spark.table("prompt").collect()))

        # The response to 1 arrives before its request does.
        assert push([(2, 1000)], [(1, 1500, True, 7)]) == []
        first = push([(1, 1200), (3, 3000)], [(9, 3000, True, 1)])
        assert first == [(1, 1200, 1500, 7, "ok")]
        assert push([(4, 31_001)], [(9, 31_001, True, 1)]) == [*first, (2, 1000, None, None, "timeout")]
    finally:
        query.stop()
