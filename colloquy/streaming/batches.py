"""Batches of a stream that close by size or by time, whether or not another item comes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import shared_path

#: transformWithState keeps its state there.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Batches(StatefulProcessor):
    """A batch opens with its first item and closes with its last at ``most``, or by a timer once ``gap_ms`` have passed.

    State of a key: the open batch with its items, and the number of the next batch. The first goes when it closes; the
    number goes ``idle_ms`` after the last batch has closed, so a key that falls silent leaves nothing, and starts from
    0 again. Times are those of the items with an event-time clock, and those of their arrival with the machine's.
    """

    def __init__(self, gap_ms: int, most: int, idle_ms: int, event_time: bool):
        self.gap, self.most, self.idle, self.event_time = gap_ms, most, idle_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start long, items array<long>")
        self.next = handle.getValueState("next", "number long, closed long")

    def _row(self, key, number: int, start: int, items: list[int], why: str) -> Row:
        return Row(key=key[0], batch=number, start=start, size=len(items), items=items, closed=why)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = None if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        start, items = self.open.get() if self.open.exists() else (None, [])
        items, opened = list(items), start
        number, first = (self.next.get()[0] if self.next.exists() else 0), True
        for time, item in sorted((r["time_ms"], r["item"]) for r in rows):
            at = time if self.event_time else now
            if items and at - start > self.gap:
                yield self._row(key, number, start, items, "time")
                items, number, first = [], number + 1, False
            start = start if items else at
            items.append(item)
            if len(items) >= self.most:
                yield self._row(key, number, start, items, "size")
                items, number, first = [], number + 1, False
        if not first:
            self.next.update((number, at))
            self.handle.registerTimer(at + self.idle)
        if items:
            self.open.update((start, items))
            if start != opened:
                self.handle.registerTimer(start + self.gap + 1)
        elif opened is not None:
            self.open.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.open.exists():
            start, items = self.open.get()
            if at - start > self.gap:
                number = self.next.get()[0] if self.next.exists() else 0
                yield self._row(key, number, start, list(items), "time")
                self.open.clear()
                self.next.update((number + 1, at))
                self.handle.registerTimer(at + self.idle)
        elif self.next.exists() and at - self.next.get()[1] >= self.idle:
            self.next.clear()


def timed_batches(items: DataFrame, key: str, time: str, item: str, gap_ms: int = 15, most: int = 64, idle_ms: int = 60_000, event_time: bool = False, late: str = "0 seconds") -> DataFrame:
    """key, batch, start, size, items and closed (size or time) of each batch of a stream.

    ``key`` is a string or whole number and ``item`` a whole number; rows without key or time are left out. With
    ``event_time``, batches close as the watermark passes, ``late`` behind the latest item, and items that come in later
    than that are dropped; else by the machine's clock. The items of a key in one trigger are taken in order of time.
    """
    spark = items.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = "string" if dict(items.dtypes)[key] == "string" else "long"
    rows = items.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    rows = rows.withWatermark(time, late) if event_time else rows
    rows = rows.select(F.col(key).cast(kind).alias("key"), F.col(time), F.unix_millis(F.col(time).cast("timestamp")).alias("time_ms"), F.col(item).cast("long").alias("item"))
    processor = Batches(gap_ms, most, idle_ms, event_time)
    return rows.groupBy("key").transformWithState(processor, f"key {kind}, batch long, start long, size int, items array<long>, closed string", "append", "eventTime" if event_time else "processingTime")


def replay(items: DataFrame, key: str, time: str, item: str, gap_ms: int, most: int, idle_ms: int) -> DataFrame:
    """A table of items as a stream that ends: its batches by event time, written to the shared folder and read back.

    A last item without meaning, far behind all others, lets the watermark pass every batch.
    """
    spark = items.sparkSession
    source, out, state = (shared_path(spark, f"replay-{x}") for x in ("in", "out", "state"))
    rows = items.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("t"), F.col(item).cast("long").alias("item"))
    end = spark.range(1).select(F.lit("end of stream").alias("key"), F.lit("9000-01-01").cast("timestamp").alias("t"), F.lit(-1).cast("long").alias("item"))
    rows.unionByName(end).write.parquet(source)
    stream = timed_batches(spark.readStream.schema(rows.schema).parquet(source), "key", "t", "item", gap_ms, most, idle_ms, event_time=True)
    running = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).where("key <> 'end of stream'")
