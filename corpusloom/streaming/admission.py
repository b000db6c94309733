"""Admission of requests in the order of their times, on a stream whose batches come in any order.

Each client's requests wait in its state until the watermark has passed them, then a timer takes those that are due, in order of
time, through the rule of the batch replay (`experiments.admitted_requests`), with the same answers. Rules: a request without
a time isn't accepted, and neither is one that comes after the watermark has passed its time (Spark drops those older than
the watermark before this sees them; `numRowsDroppedByWatermark` counts them). What a client is remembered by goes when a later
timer finds that it can't matter any more, a day and a minute after its last request.

The state is typed and kept by the RocksDB store, row by row: a client's batch is never one frame. Waiting requests are listed
by minute, so a timer reads its own minutes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ratelimit import DAY, MINUTE, Admitted, admit

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedAdmission(StatefulProcessor):
    """Rows in: key, __id, __us. Rows out: key, __id, __us, accepted."""

    def __init__(self, per_minute: int, daily: int):
        self.per_minute, self.daily = per_minute, daily

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getValueState("past", "recent array<long>, opened long, used long, last long")
        self.waiting = handle.getMapState("waiting", "minute long", "us array<long>, ids array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1_000
        fresh: dict[int, tuple[list, list]] = {}
        for r in rows:
            if r["__us"] is None or r["__us"] <= passed:
                yield self._row(key, r["__id"], r["__us"], False)
                continue
            us, ids = fresh.setdefault(r["__us"] // MINUTE, ([], []))
            us.append(r["__us"])
            ids.append(r["__id"])
        for minute, (us, ids) in fresh.items():
            if self.waiting.containsKey((minute,)):
                held = self.waiting.getValue((minute,))
                us, ids = [*held[0], *us], [*held[1], *ids]
            else:
                self.handle.registerTimer((minute + 1) * MINUTE // 1_000)  # when all of the minute is due
            self.waiting.updateValue((minute,), (us, ids))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs() * 1_000
        minute = at // MINUTE - 1
        state, last = Admitted(), None
        if self.past.exists():
            recent, opened, used, last = self.past.get()
            state = Admitted(tuple(recent), opened, used)
        if self.waiting.containsKey((minute,)):
            us, ids = self.waiting.getValue((minute,))
            self.waiting.removeKey((minute,))
            for now, name in sorted(zip(us, ids)):
                state, ok = admit(state, now, self.per_minute, self.daily)
                yield self._row(key, name, now, ok)
                last = now
            self.past.update((list(state.recent), state.opened, state.used, last))
            self.handle.registerTimer((last // MINUTE + 1) * MINUTE // 1_000 + (DAY + 2 * MINUTE) // 1_000)
        elif last is not None and at > last + DAY + MINUTE:
            self.past.clear()

    def _row(self, key, name, us, ok) -> Row:
        return Row(key=key[0], __id=name, __us=us, accepted=ok)

    def close(self) -> None:
        pass


def ordered_admission(stream: DataFrame, client: str, ts: str, per_minute: int, daily: int, delay: str = "10 minutes") -> DataFrame:
    """client, event_id, ts, accepted of a stream of requests, each once the watermark (`delay` behind the latest time) has passed the
    minute it lies in. Set spark.sql.streaming.stateStore.providerClass to ROCKSDB."""
    kind = stream.schema[client].dataType.simpleString()
    rows = stream.select(F.col(client).alias("key"), F.col("event_id").cast("long").alias("__id"), F.col(ts).cast("timestamp").alias("__ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("__us"))
    decided = rows.withWatermark("__ts", delay).groupBy("key").transformWithState(OrderedAdmission(per_minute, daily), f"key {kind}, __id long, __us long, accepted boolean", "append", "EventTime")
    return decided.select(F.col("key").alias(client), F.col("__id").alias("event_id"), F.timestamp_micros("__us").alias(ts), "accepted")
