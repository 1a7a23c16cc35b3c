"""Request/response matching on unbounded logs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioscale.constants import RESPONSE_TIMEOUT_MS

_NO_SIZE = -1
_REQUEST, _REFUSED, _ACCEPTED = 0, 1, 2
#: Event times are a millisecond later than moments: the watermark begins at 0,
#: and a moment at 0 must not be late.
_SHIFT = 1
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: A moment: time, kind, size of the response or -1.
Moment = tuple[int, int, int]


def step(
    moments: Iterable[Moment], waiting: int | None, passed: int, timeout_ms: int
) -> tuple[list[tuple], list[Moment], int | None]:
    """Take the moments up to ``passed`` in order of time. Returns the requests
    settled by them as (sent_ms, recv_ms, bytes, status), the moments still
    ahead, and the request that is waiting then.

    In one millisecond requests come before responses, and of the responses an
    accepted one first, then the larger one.
    """
    settled, ahead = [], []
    for moment in sorted(moments, key=lambda m: (m[0], m[1] != _REQUEST, -m[1], -m[2])):
        at, kind, size = moment
        if at > passed:
            ahead.append(moment)
        elif kind == _REQUEST:
            if waiting is not None and waiting != at:
                settled.append((waiting, None, None, "timeout"))
            waiting = at
        elif waiting is not None and at <= waiting + timeout_ms:
            status = "ok" if kind == _ACCEPTED else "error"
            settled.append((waiting, at, None if size == _NO_SIZE else size, status))
            waiting = None
    if waiting is not None and waiting + timeout_ms <= passed:
        settled.append((waiting, None, None, "timeout"))
        waiting = None
    return settled, ahead, waiting


class Matching(StatefulProcessor):
    """Per id: the request that waits for an answer, a timer for it, and the
    moments that the watermark has not passed yet."""

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "sent_ms bigint")
        self.timer = handle.getValueState("timer", "at bigint")
        self.ahead = handle.getListState("ahead", "at bigint, kind int, bytes bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = {moment for batch in rows for moment in zip(batch["at"], batch["kind"], batch["bytes"])}
        yield from self._advance(key, fresh, timerValues.getCurrentWatermarkInMs() - _SHIFT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield from self._advance(key, set(), timerValues.getCurrentWatermarkInMs() - _SHIFT)

    def _advance(self, key: tuple, fresh: set[Moment], passed: int) -> Iterator[pd.DataFrame]:
        held = {tuple(row) for row in self.ahead.get()} if self.ahead.exists() else set()
        before = self.waiting.get()[0] if self.waiting.exists() else None
        moments = {tuple(map(int, moment)) for moment in held | fresh}
        settled, ahead, waiting = step(moments, before, passed, self.timeout_ms)
        if ahead:
            if len(ahead) != len(held) or fresh:
                self.ahead.put(ahead)
        elif held:
            self.ahead.clear()
        if waiting != before:
            self.waiting.clear() if waiting is None else self.waiting.update((waiting,))
        self._wake([at for at, _, _ in ahead[:1]] + ([] if waiting is None else [waiting + self.timeout_ms]))
        if settled:
            out = pd.DataFrame(settled, columns=["sent_ms", "recv_ms", "bytes", "status"], dtype=object)
            out.insert(0, "request_id", pd.Series([key[0]] * len(out), dtype=object))
            yield out.astype({"sent_ms": "Int64", "recv_ms": "Int64", "bytes": "Int64"})

    def _wake(self, times: list[int]) -> None:
        """One timer per id: at the first time at which anything can change."""
        due = min(times, default=None)
        was = self.timer.get()[0] if self.timer.exists() else None
        if due == was:
            return
        if was is not None:
            self.handle.deleteTimer(was + _SHIFT)
        if due is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(due + _SHIFT)
            self.timer.update((due,))


def _use_rocks(spark: SparkSession) -> None:
    """Keyed state with timers needs this store; a query keeps the one it began with."""
    spark.conf.set(_PROVIDER, _ROCKS)


def correlate_requests_stream(
    requests: DataFrame,
    responses: DataFrame,
    timeout_ms: int = RESPONSE_TIMEOUT_MS,
    lateness: str = "0 seconds",
) -> DataFrame:
    """``correlate_requests`` over two streams, in append mode.

    The state of an id is its one waiting request. Moments come from two logs
    and in any order, so those that the watermark has not passed are held, too;
    once it has, a response settles its request at once, and a timer settles a
    request that got none. A row behind the watermark is late and ignored.
    """
    _use_rocks(requests.sparkSession)
    asked = requests.select(
        "request_id", F.col("sent_ms").alias("at"), F.lit(_REQUEST).alias("kind"), F.lit(_NO_SIZE).cast("bigint").alias("bytes")
    )
    kind = F.when(F.col("ok"), _ACCEPTED).otherwise(_REFUSED).alias("kind")
    size = F.coalesce(F.col("bytes").cast("bigint"), F.lit(_NO_SIZE).cast("bigint")).alias("bytes")
    # A response without an id answers nothing.
    answered = responses.where(F.col("request_id").isNotNull()).select("request_id", F.col("recv_ms").alias("at"), kind, size)

    def timed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("event_at", F.timestamp_millis(F.col("at") + _SHIFT)).withWatermark("event_at", lateness)

    id_type = requests.schema["request_id"].dataType.simpleString()
    return (
        timed(asked)
        .unionByName(timed(answered))
        .groupBy("request_id")
        .transformWithStateInPandas(
            Matching(timeout_ms),
            f"request_id {id_type}, sent_ms bigint, recv_ms bigint, bytes bigint, status string",
            "Append",
            "EventTime",
        )
    )
