"""Matching responses to requests by id within a time limit.

Requests carry ``request_id, sent_ms``; responses carry ``request_id,
recv_ms, ok, bytes``. A request is one (id, time): ids repeat over time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscale.constants import RESPONSE_TIMEOUT_MS
from folioscale.functions._util import floor_div
from folioscale.functions.blocks import request_task
from folioscale.operators.page_table import repeat_copies

_SPAN_TIMEOUTS = 8
# Stands for a response without a size while rows are matched.
_NO_SIZE = -1


def request_status(ok: Column) -> Column:
    return F.when(ok.isNull(), "timeout").when(ok, "ok").otherwise("error")


def correlate_requests(
    requests: DataFrame, responses: DataFrame, timeout_ms: int = RESPONSE_TIMEOUT_MS
) -> DataFrame:
    """Each request with its first response in ``sent_ms .. sent_ms + timeout``
    and the status ok / error / timeout.

    A response answers one request: the latest of its id. A request that is
    repeated before it is answered is superseded, and counts as a timeout.
    ``ok`` that is not known counts as false; a null id matches nothing.

    An as-of match rather than a join on the id: no pair of rows is formed,
    however often an id occurs. Both logs are stacked and reduced to one row
    per id and millisecond (before the shuffle), laid out in time spans per id,
    a row also in the span before when requests there may still wait for it. A
    span so holds a bounded number of rows, and one backward pass over it gives
    every request the next response and the next request.
    """
    span = timeout_ms * _SPAN_TIMEOUTS

    sent = F.col("sent_ms")
    asked = requests.select(
        "request_id",
        sent.alias("at"),
        F.explode(F.sequence(floor_div(sent - timeout_ms, span), floor_div(sent, span))).alias("span"),
        F.lit(True).alias("is_request"),
    )
    received = F.col("recv_ms")
    accepted = F.coalesce(F.col("ok"), F.lit(False))
    size = F.coalesce(F.col("bytes"), F.lit(_NO_SIZE))
    # A response without an id answers nothing.
    answered = responses.where(F.col("request_id").isNotNull()).select(
        "request_id",
        received.alias("at"),
        F.explode(F.sequence(floor_div(received - timeout_ms, span), floor_div(received, span))).alias("span"),
        accepted.alias("ok"),
        size.alias("bytes"),
        F.when(accepted, size).alias("ok_bytes"),
    )
    # Of responses in the same millisecond an accepted one comes first, then
    # the larger one.
    moments = (
        asked.unionByName(answered, allowMissingColumns=True)
        .groupBy("request_id", "span", "at")
        .agg(*[F.max(name).alias(name) for name in ("is_request", "ok", "bytes", "ok_bytes")])
        .withColumn("bytes", F.when(F.col("ok"), F.col("ok_bytes")).otherwise(F.col("bytes")))
        .withColumn("answer_at", F.when(F.col("ok").isNotNull(), F.col("at")))
        .withColumn("asked_at", F.when(F.col("is_request"), F.col("at")))
    )

    backward = (
        Window.partitionBy("request_id", "span")
        .orderBy(F.desc("at"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # The columns are NULL together, so the last values come from one row.
    following = {name: F.last(name, ignorenulls=True).over(backward) for name in ("answer_at", "ok", "bytes")}
    before = backward.rowsBetween(Window.unboundedPreceding, -1)
    following["next_asked"] = F.last("asked_at", ignorenulls=True).over(before)
    own = F.col("is_request") & (floor_div(F.col("at"), span) == F.col("span"))
    matched = moments.withColumns(following).where(own)
    superseded = F.coalesce(F.col("next_asked") <= F.col("answer_at"), F.lit(False))
    in_time = (F.col("answer_at") <= F.col("at") + timeout_ms) & ~superseded
    return matched.select(
        "request_id",
        F.col("at").alias("sent_ms"),
        F.when(in_time, F.col("answer_at")).alias("recv_ms"),
        F.nullif(F.when(in_time, F.col("bytes")), F.lit(_NO_SIZE)).alias("bytes"),
        request_status(F.when(in_time, F.col("ok"))).alias("status"),
    )


def unmatched_responses(
    requests: DataFrame, responses: DataFrame, timeout_ms: int = RESPONSE_TIMEOUT_MS
) -> DataFrame:
    """Responses nobody was waiting for: unknown id, too late, or after the
    request was already answered. When one of several equal rows was the
    answer, the others remain. ``ok`` that is not known counts, and is shown,
    as false.

    A pass over the same time spans, forward: a response was the answer if the
    latest request of its id is in time and no response came in between. Equal
    rows are counted before the shuffle and stay one row until the end, where
    the answer is taken off the count.
    """
    span = timeout_ms * _SPAN_TIMEOUTS
    one = F.lit(1).cast("bigint")

    def spans(at: Column) -> Column:
        # Its own, and the next if responses there may look back to it.
        return F.explode(F.sequence(floor_div(at, span), floor_div(at + timeout_ms, span)))

    sent, received = F.col("sent_ms"), F.col("recv_ms")
    asked = requests.select(
        "request_id", sent.alias("at"), spans(sent).alias("span"), F.lit(True).alias("is_request"), one.alias("copies")
    )
    known = received.isNotNull() & F.col("request_id").isNotNull()
    answered = responses.where(known).select(
        "request_id",
        received.alias("at"),
        spans(received).alias("span"),
        F.lit(False).alias("is_request"),
        F.coalesce(F.col("ok"), F.lit(False)).alias("ok"),
        "bytes",
        one.alias("copies"),
    )
    moments = (
        asked.unionByName(answered, allowMissingColumns=True)
        .groupBy("request_id", "span", "at", "is_request", "ok", "bytes")
        .agg(F.sum("copies").alias("copies"))
    )
    by_time = Window.partitionBy("request_id", "span").orderBy("at")
    so_far = by_time.rangeBetween(Window.unboundedPreceding, 0)
    earlier = by_time.rangeBetween(Window.unboundedPreceding, -1)
    # Of responses in the same millisecond an accepted one comes first, then the larger one.
    rank = F.row_number().over(
        Window.partitionBy("request_id", "span", "at", "is_request").orderBy(F.desc("ok"), F.desc_nulls_last("bytes"))
    )
    marked = moments.withColumns(
        {
            "asked_at": F.max(F.when(F.col("is_request"), F.col("at"))).over(so_far),
            "answered_at": F.max(F.when(~F.col("is_request"), F.col("at"))).over(earlier),
            "rank": rank,
        }
    )
    in_time = F.col("asked_at") >= F.col("at") - timeout_ms
    open_still = F.col("answered_at").isNull() | (F.col("answered_at") < F.col("asked_at"))
    used = F.coalesce(in_time & open_still & (F.col("rank") == 1), F.lit(False))
    own = ~F.col("is_request") & (floor_div(F.col("at"), span) == F.col("span"))
    left = marked.where(own).select(
        "request_id", F.col("at").alias("recv_ms"), "ok", "bytes", (F.col("copies") - used.cast("bigint")).alias("copies")
    )
    # Rows without an id or a time answer nothing; they are not spread over spans.
    odd = responses.where(~known).select(
        "request_id", "recv_ms", F.coalesce(F.col("ok"), F.lit(False)).alias("ok"), "bytes", one.alias("copies")
    )
    odd = odd.groupBy("request_id", "recv_ms", "ok", "bytes").agg(F.sum("copies").alias("copies"))
    return repeat_copies(left.unionByName(odd).where("copies > 0"), keys=("request_id", "recv_ms"))


def request_stats(matched: DataFrame) -> DataFrame:
    """Per task what became of its requests: counts by status, and the bytes of
    the accepted answers. Combines before the shuffle."""

    def count(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return matched.groupBy(request_task("request_id").alias("task_id")).agg(
        F.count(F.lit(1)).alias("requests"),
        count("ok").alias("ok"),
        count("error").alias("errors"),
        count("timeout").alias("timeouts"),
        F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("bytes"))), F.lit(0)).alias("bytes"),
    )
