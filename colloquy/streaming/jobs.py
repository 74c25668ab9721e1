"""Streams: windowed dashboards, appended outputs, and micro-batches anchored at their first arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def dashboard(events: DataFrame, time: str, kind: str, value: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by window and kind, with a watermark for late rows. Works on streams and tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")


def micro_batches(items: DataFrame, key: str, time: str, gap_ms: int = 15, most: int = 64) -> DataFrame:
    """Batches of a stream of items: a batch opens with its first item and closes at ``most`` or after ``gap_ms``.

    State holds the open batch of each key only. Items of a trigger are taken in order of time.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, size, batch = state.get if state.exists else (None, 0, -1)
        times = sorted(int(x.timestamp() * 1000) for f in frames for x in f[time])
        out = []
        for t in times:
            if start is None or t - start > gap_ms or size >= most:
                start, size, batch = t, 0, batch + 1
            size += 1
            out.append((k[0], batch, t))
        state.update((start, size, batch))
        yield pd.DataFrame(out, columns=["key", "batch", "time_ms"])

    return items.groupBy(key).applyInPandasWithState(run, "key string, batch long, time_ms long", "start long, size long, batch long", "append", "NoTimeout")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a folder of Parquet files, each row once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
