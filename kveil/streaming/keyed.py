"""The arrival gate as keyed state with timers, for buckets whose rows fit one task.

``jobs.gate_stream`` is the form for hot buckets: it spreads a bucket over chunks. This
one holds per bucket the first time, at most k - 1 visitors and the ids that wait, in the
state store; an event-time timer at the run's deadline drops what waits too long, also
when no further event of the bucket arrives.
"""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kveil.operators import kanon
from kveil.operators.kanon import DROPPED, RELEASED, Gate
from kveil.session import STATE_STORE


@contextlib.contextmanager
def _by_value():
    """Pickle the processor with its code: the worker that Spark starts beside the driver gets no shipped packages."""
    mine = [m for m in (sys.modules[__name__], kanon) if m.__name__ not in cloudpickle.list_registry_pickle_by_value()]
    for module in mine:
        cloudpickle.register_pickle_by_value(module)
    try:
        yield
    finally:
        for module in mine:
            cloudpickle.unregister_pickle_by_value(module)


class GateProcessor(StatefulProcessor):
    """One bucket: rows (us, id, visitor) in, (id, status) out once the status is final."""

    def __init__(self, k: int, ttl_us: int, sweep_us: int, id_type: str):
        self.gate, self.id_type = Gate(k, ttl_us, sweep_us, None), id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first_us BIGINT, visitors ARRAY<STRING>")
        self.waiting = handle.getListState("waiting", f"id {self.id_type}")

    def _timer(self, first_us: int) -> int:
        return self.gate.deadline(first_us) * self.gate.sweep // 1000

    def _end(self, first_us: int, status: str) -> Iterator[Row]:
        for (i,) in self.waiting.get():
            yield Row(id=i, status=status)
        self.waiting.clear()
        self.open.clear()
        self.handle.deleteTimer(self._timer(first_us))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.open.get()
        first_us, visitors = (held[0], set(held[1])) if held is not None else (None, set())
        new: list = []
        for us, i, visitor in sorted((r["us"], r["id"], r["visitor"]) for r in rows):
            if first_us is not None and us // self.gate.sweep >= self.gate.deadline(first_us):
                yield from self._end(first_us, DROPPED)
                yield from (Row(id=x, status=DROPPED) for x in new)
                first_us, visitors, new = None, set(), []
            if first_us is None:
                first_us = us
            new.append(i)
            if visitor is not None:
                visitors.add(visitor)
            if len(visitors) >= self.gate.k:
                yield from self._end(first_us, RELEASED)
                yield from (Row(id=x, status=RELEASED) for x in new)
                first_us, visitors, new = None, set(), []
        if first_us is not None:
            if held is None or held[0] != first_us:
                self.handle.registerTimer(self._timer(first_us))
            self.open.update((first_us, sorted(visitors)))
            if new:
                self.waiting.appendList([(x,) for x in new])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.open.get()
        # A timer of a run that has ended since does nothing.
        if held is not None and self._timer(held[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            yield from self._end(held[0], DROPPED)

    def close(self) -> None:
        pass


def keyed_gate(
    events: DataFrame, qi: list[str], k: int = kanon.K, ttl_seconds: int = kanon.TTL_SECONDS, sweep_seconds: int | None = None,
    delay: str = "0 seconds", ts: str = "ts", tie: str = "event_id", visitor: str = "visitor",
) -> DataFrame:
    """``tie`` and final ``status`` (released or dropped) of the events of a stream.

    Events that are behind the watermark (``delay`` behind the newest event) are left out
    by the state store; ``jobs.on_time`` sets them aside and counts them before. The
    session gets the state store that keyed state needs, whatever it had.
    """
    kanon._check_k(k)
    sweep_seconds = sweep_seconds or max(1, min(ttl_seconds, kanon.SWEEP_SECONDS))
    id_type = events.schema[tie].dataType.simpleString()
    rows = events.withWatermark(ts, delay).select(
        kanon._bucket(qi).alias("bucket"), F.col(ts), F.unix_micros(F.col(ts)).alias("us"), F.col(tie).alias("id"), F.col(visitor).alias("visitor")
    )
    processor = GateProcessor(k, ttl_seconds * 1_000_000, sweep_seconds * 1_000_000, id_type)
    rows.sparkSession.conf.set(*STATE_STORE)
    with _by_value():
        out = rows.groupBy("bucket").transformWithState(processor, f"id {id_type}, status STRING", "Append", "EventTime")
    return out.withColumnRenamed("id", tie)
