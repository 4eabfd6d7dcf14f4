"""Request leases and run outcomes, as tables and as streams, and the driver of an available-now stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from evigraph.session import shared_folder
from evigraph.streaming.review_log import append_batch

RECOVERED = "Recovered after an interrupted run."
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def recover_stale(requests: DataFrame, now: Column, hours: int = 12) -> DataFrame:
    """Requests in processing that nothing touched for `hours` go back to the queue with a message."""
    stale = (F.col("status") == "processing") & (F.col("updated_at") < now - F.make_dt_interval(F.lit(0), F.lit(hours)))
    hit = F.coalesce(stale, F.lit(False))
    return requests.withColumn("error", F.when(hit, F.lit(RECOVERED)).otherwise(F.col("error"))).withColumn(
        "status", F.when(hit, F.lit("queued")).otherwise(F.col("status"))
    )


class Lease(StatefulProcessor):
    """One processing-time timer for a request in processing; each touch moves it, any other status removes it."""

    def __init__(self, seconds: float) -> None:
        self.wait_ms = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at_ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        latest = None
        for row in rows:
            if latest is None or (row.updated_at, row.status) >= (latest.updated_at, latest.status):
                latest = row
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if latest.status == "processing":
            at = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
            self.handle.registerTimer(at)
            self.timer.update((at,))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.timer.clear()
        yield Row(id=key[0], status="queued", error=RECOVERED)

    def close(self) -> None:
        pass


def lease_stream(touches: DataFrame, seconds: float = 12 * 3600) -> DataFrame:
    """(id, status, error) of each request whose last touch left it in processing and which nothing touched for `seconds` since.

    `touches` is a stream of (id, status, updated_at). The wait runs by the cluster's clock from the batch that brought the touch. A request
    has state only while it is in processing, so state ends with the lease.
    """
    rows = touches.select("id", "status", "updated_at")
    kind = dict(touches.dtypes)["id"]
    return rows.groupBy("id").transformWithState(Lease(seconds), f"id {kind}, status string, error string", "append", "processingTime")


def recently_checked(attempts: DataFrame, now: Column, days: int = 14) -> DataFrame:
    return attempts.where(F.col("attempted_at") > now - F.make_dt_interval(F.lit(days))).select(F.col("entity_id").alias("id")).distinct()


def close_requests(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Status of requests after their run: processed, or on failure queued unless candidates were written.

    Runs are (request_id, outcome, candidates_written, error), one per request.
    """
    r = runs.select(F.col("request_id").alias("_r"), "outcome", "candidates_written", F.col("error").alias("_error"))
    joined = requests.join(r, F.col("id") == F.col("_r"), "left")
    done = (F.col("outcome") == "completed") | F.col("candidates_written")
    status = F.when(F.col("_r").isNull(), F.col("status")).when(done, "processed").otherwise("queued")
    error = F.when(F.col("_r").isNull(), F.col("error")).when(F.col("outcome") == "failed", F.col("_error"))
    return joined.withColumn("status", status).withColumn("error", error).drop("_r", "outcome", "candidates_written", "_error")


def close_request_stream(requests: DataFrame, runs: DataFrame, hours: int = 12, delay: str = "1 hour") -> DataFrame:
    """(id, status, error, finished_at) of each request in processing: by its run, or back in the queue if none ends within `hours`.

    `requests` is a stream of (id, started_at), `runs` one of (request_id, run_id, outcome, candidates_written, error, finished_at). Deliveries of
    the same run are one. A run that ends after the lease leaves the request in the queue; of two runs within it each gives
    a row, so the later one decides by `finished_at`. Both sides leave the state when the watermark is past the lease, so state is what `hours` and `delay` bring.
    Rows without an id are marks of the writer's clock and move the watermark only.
    """
    lease = F.expr(f"interval {int(hours)} hours")  # a literal, from which Spark derives how long rows stay in the state
    asked = requests.select("id", "started_at").where(F.col("started_at").isNotNull()).withWatermark("started_at", delay)
    ended = runs.select(F.col("request_id").alias("_r"), "run_id", "outcome", "candidates_written", "error", "finished_at").withWatermark("finished_at", delay)
    ended = ended.dropDuplicatesWithinWatermark(["_r", "run_id"])
    within = (F.col("finished_at") >= F.col("started_at")) & (F.col("finished_at") <= F.col("started_at") + lease)
    joined = asked.join(ended, (F.col("id") == F.col("_r")) & within, "left")
    # The condition names the time as well, or it would be pushed below the watermark and take the marks away before they count.
    joined = joined.where(F.col("id").isNotNull() | F.col("started_at").isNull())
    done = (F.col("outcome") == "completed") | F.col("candidates_written")
    status = F.when(F.col("_r").isNotNull() & done, "processed").otherwise("queued")
    error = F.when(F.col("_r").isNull(), RECOVERED).when(F.col("outcome") == "failed", F.col("error"))
    return joined.select("id", status.alias("status"), error.alias("error"), "finished_at")


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared place the cluster names."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clock_mark(stream: DataFrame, column: str, at: Column) -> DataFrame:
    """A stream of one row that is null but for `column`: the promise that no row before `at` (a foldable column) will come.

    United with a stream it closes what waits there; for a table that is complete, played as a stream in one batch.
    """
    spark = stream.sparkSession
    folder = work_folder(spark, "clock")
    row = [(at if f.name == column else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema]
    spark.range(1).select(*row).write.parquet(folder)
    return spark.readStream.schema(stream.schema).parquet(folder)


def start(stream: DataFrame, folder: str, **trigger):
    """Run a stream into files, batch by batch, with state in RocksDB, which spills and keeps versions; a repeated batch replaces itself."""
    conf = stream.sparkSession.conf
    key = "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, ROCKS)
    try:
        writer = stream.writeStream.foreachBatch(append_batch(f"{folder}/out")).option("checkpointLocation", f"{folder}/state")
        return writer.outputMode("append").trigger(**trigger).start()
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available once and read the result back."""
    folder = work_folder(stream.sparkSession, name)
    start(stream, folder, availableNow=True).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
