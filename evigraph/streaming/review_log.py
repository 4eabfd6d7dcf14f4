"""Change log of candidate reviews: batch form, and a stream that orders rows by event time before it compares them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from evigraph import vocab
from evigraph.operators.prefix import with_previous

OUTPUT = (
    "candidate_id string, version string, previous_status string, status string, reason_code string, note string, "
    "origin string, happened_at_us bigint"
)
EVENT = Row(*[part.split()[0] for part in OUTPUT.split(", ")])
TRIPLE = "status string, reason_code string, note string"
PER_CALL = 1000  # rows in a message to the state
NEVER = (None,) * 5


def batch_events(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Events of a change table: first rows that are final, and rows whose status, reason or note changed.

    `order` names columns without nulls that end in a unique one.
    """
    watched = [F.col("status"), F.col("review_reason_code").alias("reason_code"), F.col("note")]
    marked = with_previous(rows, [key], [(name, True) for name in order], watched, "_previous")
    marked = marked.withColumn("_current", F.struct(*watched))
    first_final = F.col("_previous").isNull() & F.col("status").isin(*vocab.FINAL_STATUSES)
    changed = F.col("_previous").isNotNull() & ~F.col("_previous").eqNullSafe(F.col("_current"))
    events = marked.where(first_final | changed)
    return events.withColumn("previous_status", F.col("_previous.status")).drop("_previous", "_current")


def backfill_events(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """A backfill event for each final candidate that has none."""
    known = events.select(F.col("candidate_id").alias("_known")).distinct()
    final = candidates.where(F.col("status").isin(*vocab.FINAL_STATUSES))
    return final.join(known, F.col("id") == F.col("_known"), "left_anti").select(
        F.col("id").alias("candidate_id"), F.lit(None).cast("string").alias("previous_status"), "status",
        F.col("review_reason_code").alias("reason_code"), F.lit("backfill").alias("origin"),
        F.col("updated_at").alias("happened_at"),
    )


class ReviewLog(StatefulProcessor):
    """Waiting rows of a candidate, its last triple, and one timer at the earliest moment of work.

    A row waits until the watermark has passed its time, when no earlier row can come any more; then rows are compared in
    the order of (time, version), whatever batches brought them. Of repeated deliveries of a (time, version) the latest counts. Rows go
    into the state and out of it as one list, since each call to the state is a message to the executor. The last triple is
    forgotten when the watermark is `keep_ms` past it, so state ends; a candidate that comes back later starts anew.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", f"{TRIPLE}, at_us bigint, timer_ms bigint")  # the last triple with its time, and the timer
        self.waiting = handle.getListState("waiting", f"at_us bigint, version string, {TRIPLE}")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:
            return iter(())
        rows, earliest = iter(rows), None
        while some := [(r.happened_at_us, r.version, r.status, r.reason_code, r.note) for r in islice(rows, PER_CALL)]:
            self.waiting.appendList(some)
            first = min(r[0] for r in some)
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            *last, timer = self.seen.get() or NEVER
            if timer is None or earliest // 1000 + 1 < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self._wake(last, earliest // 1000 + 1)
        return iter(())

    def _wake(self, last: Sequence, at_ms: int) -> None:
        self.handle.registerTimer(at_ms)
        self.seen.update((*last, at_ms))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = {(at_us, version): tuple(triple) for at_us, version, *triple in self.waiting.get()}
        due = [(*at, triple) for at, triple in rows.items() if at[0] // 1000 < mark]
        rest = [(*at, *triple) for at, triple in rows.items() if at[0] // 1000 >= mark]
        later = min((r[0] for r in rest), default=None)
        *last, _ = self.seen.get() or NEVER
        last = None if last[3] is None else tuple(last)
        for at_us, version, triple in sorted(due, key=lambda r: (r[0], r[1] is not None, r[1] or "")):
            first_final = last is None and triple[0] in vocab.FINAL_STATUSES
            if first_final or (last is not None and triple != last[:3]):
                yield EVENT(key[0], version, last[0] if last else None, *triple, "review_change", at_us)
            last = (*triple, at_us)
        if due:
            self.waiting.clear()
            for at in range(0, len(rest), PER_CALL):
                self.waiting.appendList(rest[at : at + PER_CALL])
        ends = None if last is None else last[3] // 1000 + self.keep_ms
        if later is not None:
            self._wake(last or NEVER[:-1], later // 1000 + 1)
        elif ends is not None and ends > mark:
            self._wake(last, ends)
        else:
            self.seen.clear()

    def close(self) -> None:
        pass


def stream_events(changes: DataFrame, delay: str = "1 day", keep_days: int = 365) -> DataFrame:
    """Events of a change stream (candidate_id, version, status, reason_code, note, happened_at), as `batch_events` gives them.

    Rows may come late by `delay` and in any order; an event leaves once the watermark has passed its time, and rows behind the
    watermark of the batch before are dropped and counted by Spark: whatever is let in is later than all that has left. A row without a candidate is a mark of the writer's clock: it moves the watermark and nothing
    else. Rows without a time have no place in the order and are left out. The state store must be RocksDB (`run_available` sees to it).
    """
    timed = changes.where(F.col("happened_at").isNotNull()).withWatermark("happened_at", delay)
    rows = timed.select(
        "candidate_id", F.col("version").cast("string").alias("version"), "status", "reason_code", "note", "happened_at",
        F.unix_micros("happened_at").alias("happened_at_us"),
    )
    events = rows.groupBy("candidate_id").transformWithState(ReviewLog(keep_days * 86_400_000), OUTPUT, "append", "eventTime")
    return events.withColumn("happened_at", F.timestamp_micros("happened_at_us")).drop("happened_at_us")


def review_counts(events: DataFrame, delay: str = "1 day", width: str = "7 days") -> DataFrame:
    """Decisions per week and status; works on a batch and on a stream."""
    timed = events.withWatermark("happened_at", delay)
    return timed.groupBy(F.window("happened_at", width), "status").agg(F.count(F.lit(1)).alias("decisions")).select(
        F.col("window.start").alias("week"), "status", "decisions"
    )


def append_batch(path: str):
    """Sink for `foreachBatch`: each batch replaces its own partition, so a repeated batch changes nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
