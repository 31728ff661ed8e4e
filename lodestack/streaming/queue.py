"""The work queue as a stream: idempotent enqueue, a state per item, a log of failures."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What an event may do to an item in a state; anything else changes nothing.
MOVES = {("", "enqueue"): "queued", ("queued", "park"): "parked", ("queued", "finish"): "done", ("parked", "requeue"): "queued", ("parked", "finish"): "done"}
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def enqueue(events: DataFrame) -> DataFrame:
    """The first event of each (run_id, work_key)."""
    return events.dropDuplicates(["run_id", "work_key"])


class Items(StatefulProcessor):
    """An item's state, how often it moved, and the last event that it knows: events up to that one are
    replays and change nothing. With `overdue_ms` an item that stays parked for so long is told of by a timer."""

    def __init__(self, overdue_ms: int | None = None):
        self.overdue_ms = overdue_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "state string, moves long, last long, parked_until long")

    def _row(self, key: tuple, state: str, moves: int, overdue: bool) -> Row:
        own = {"run_id": key[0], "work_key": key[1], "state": state, "moves": moves}
        return Row(**own) if self.overdue_ms is None else Row(**own, overdue=overdue)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, moves, last, until = self.item.get() if self.item.exists() else ("", 0, None, None)
        before = until
        for row in sorted(rows, key=lambda r: r["seq"]):
            if last is not None and row["seq"] <= last:
                continue
            last = row["seq"]
            new = MOVES.get((now, row["event"]))
            if new is not None:
                now, moves = new, moves + 1
                until = timerValues.getCurrentProcessingTimeInMs() + self.overdue_ms if self.overdue_ms is not None and now == "parked" else None
        if until != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if until is not None:
                self.handle.registerTimer(until)
        self.item.update((now, moves, last, until))
        yield self._row(key, now, moves, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, moves, last, until = self.item.get()
        if now == "parked" and until == expiredTimerInfo.getExpiryTimeInMs():
            self.item.update((now, moves, last, None))
            yield self._row(key, now, moves, True)

    def close(self) -> None:
        pass


def states(events: DataFrame, overdue_ms: int | None = None) -> DataFrame:
    """events: run_id, work_key, seq, event. After each micro-batch the state of every item that the batch
    touched, and how many events moved it so far; with `overdue_ms` also, once, of items parked for so long."""
    conf = events.sparkSession.conf
    if conf.get(PROVIDER, None) != ROCKS:
        conf.set(PROVIDER, ROCKS)  # the only provider that has typed states and timers
    kind = "run_id long, work_key string, state string, moves long"
    items = events.groupBy("run_id", "work_key")
    if overdue_ms is None:
        return items.transformWithState(Items(), kind, "Update", "None")
    return items.transformWithState(Items(overdue_ms), kind + ", overdue boolean", "Update", "ProcessingTime")


def failure_log(failures: DataFrame, folder: str, checkpoint: str):
    """A stream's failures appended to the table in `folder`, in one partition for each micro-batch: a batch
    that is run again replaces what it wrote, so no row is there twice. A writer to be started."""

    def append(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return failures.writeStream.outputMode("append").foreachBatch(append).option("checkpointLocation", checkpoint)
