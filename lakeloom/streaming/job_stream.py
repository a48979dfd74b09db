"""A job's items as a stream: attempts within a rate, each item once, with state that survives a restart.

Items come in as rows, and so do the outcomes of attempts.  The state of every item
(pending, running or settled) is keyed by its job and lane; a lane is a hash of the
item, so that the items of one large job are not one key.  A lane lets ``batches``
batches go, then waits for a timer.  Attempts go out as rows of the batch that they
are in; whoever looks the items up sends outcomes back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What the stream takes: an item to be attempted (no status), or the outcome of its attempt.
EVENTS = "job_id bigint, item_id string, status string, error string"
#: What it gives: an attempt (``running``) with the number of its batch, or the outcome of one.
OUTPUT = "job_id bigint, lane int, batch bigint, item_id string, status string, error string"

PENDING, RUNNING = "pending", "running"


@dataclass(frozen=True)
class Rate:
    """``batches`` of ``size`` items in a window, and ``wait_ms`` between windows."""

    batches: int = 4
    size: int = 25
    wait_ms: int = 5000


class Attempts(StatefulProcessor):
    """The state of one lane of a job.

    ``items`` holds the status of each item by its id, ``waiting`` the ids that are
    pending in the order they came, by numbers from ``head`` to ``tail``.
    """

    def __init__(self, rate: Rate):
        self.rate = rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "item_id string", "status string")
        self.waiting = handle.getMapState("waiting", "number bigint", "item_id string")
        self.places = handle.getValueState("places", "head bigint, tail bigint, batch bigint, resting boolean")

    def _places(self) -> tuple[int, int, int, bool]:
        return tuple(self.places.get()) if self.places.exists() else (0, 0, 0, False)

    def _window(self, key, now_ms: int) -> Iterator[Row]:
        """Let a window's batches go, and rest if any did; a lane that rests, or has nothing to do, lets none go."""
        head, tail, batch, resting = self._places()
        if resting or head == tail:
            return
        for _ in range(self.rate.batches):
            if head == tail:
                break
            for number in range(head, min(tail, head + self.rate.size)):
                (item,) = self.waiting.getValue((number,))
                self.waiting.removeKey((number,))
                self.items.updateValue((item,), (RUNNING,))
                yield Row(job_id=key[0], lane=key[1], batch=batch, item_id=item, status=RUNNING, error=None)
            head, batch = min(tail, head + self.rate.size), batch + 1
        self.places.update((head, tail, batch, True))
        self.handle.registerTimer(now_ms + self.rate.wait_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        head, tail, batch, resting = self._places()
        for row in rows:
            known = self.items.getValue((row.item_id,)) if self.items.containsKey((row.item_id,)) else None
            if row.status is None:
                # An item that comes again is not attempted again.
                if known is None:
                    self.items.updateValue((row.item_id,), (PENDING,))
                    self.waiting.updateValue((tail,), (row.item_id,))
                    tail += 1
            elif known is not None and known[0] == RUNNING:
                # Outcomes of what does not run, or was settled before, are passed over.
                self.items.updateValue((row.item_id,), (row.status,))
                yield Row(job_id=key[0], lane=key[1], batch=None, item_id=row.item_id, status=row.status, error=row.error)
        self.places.update((head, tail, batch, resting))
        yield from self._window(key, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        head, tail, batch, _ = self._places()
        self.places.update((head, tail, batch, False))
        yield from self._window(key, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def attempts(events: DataFrame, *, lanes: int = 1, rate: Rate = Rate()) -> DataFrame:
    """The stream of attempts and outcomes (``OUTPUT``) of a stream of ``EVENTS``.

    With one lane a job keeps to the rate as a whole; with more each lane does.  Rows
    without a job or an item are left out.  The state needs the RocksDB store, which
    ``start`` sets.
    """
    lane = F.pmod(F.xxhash64("item_id"), F.lit(lanes)).cast("int")
    rows = events.filter("job_id IS NOT NULL AND item_id IS NOT NULL").withColumn("lane", lane)
    return rows.groupBy("job_id", "lane").transformWithState(statefulProcessor=Attempts(rate), outputStructType=OUTPUT, outputMode="append", timeMode="ProcessingTime")


def start(spark: SparkSession, events: str, out: str, checkpoint: str, *, lanes: int = 1, rate: Rate = Rate(), every: str = "1 second"):
    """Run over a folder of event files; attempts and outcomes go to Parquet at ``out``, each exactly once, however often the query is stopped and started."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(EVENTS).parquet(events)
    return attempts(source, lanes=lanes, rate=rate).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()


def job_states(log: DataFrame) -> DataFrame:
    """How each job stands, from what the stream has given: items attempted, still running, settled, and failed."""
    last = log.groupBy("job_id", "item_id").agg(F.max_by("status", F.when(F.col("status") == RUNNING, 0).otherwise(1)).alias("status"))
    n = lambda c: F.count_if(c)
    return last.groupBy("job_id").agg(F.count("*").alias("attempted"), n(F.col("status") == RUNNING).alias("running"), n(F.col("status") != RUNNING).alias("settled"), n(F.col("status") == "failed").alias("failed"))
