"""Streams of batches: a replay equals the fold over the table, timers close batches without input, state goes."""

import json
import time

import pytest
from pyspark.sql import functions as F

from colloquy import queries
from colloquy.operators import tokens
from colloquy.streaming.batches import ROCKS, replay, timed_batches

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def own_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def folded(rows, gap, most):
    """Batches of (time, item) by plain Python."""
    out = []
    for t, item in sorted(rows):
        if not out or t - out[-1][0] > gap or len(out[-1][1]) >= most:
            out.append((t, []))
        out[-1][1].append(item)
    return out


def test_replay_equals_the_fold(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    got = {}
    for r in replay(events, "user_id", "ts", "event_id", 3_600_000, 4, 86_400_000).collect():
        assert r.size == len(r["items"]) <= 4 and (r.closed == "size") == (r.size == 4)
        got.setdefault(int(r.key), {})[r.batch, r.start] = r["items"]
    rows = events.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).collect()
    users = {}
    for r in rows:
        users.setdefault(r.user_id, []).append((r.ms, r.event_id))
    assert got == {u: {(i, t): items for i, (t, items) in enumerate(folded(x, 3_600_000, 4))} for u, x in users.items()}
    batch = {}
    for r in tokens.anchored_batches(events.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))), "user_id", "ms", "event_id", 3_600_000, 4).collect():
        batch.setdefault((r.user_id, r.batch), set()).add(r.event_id)
    assert batch == {(u, i): set(items) for u, x in got.items() for (i, _), items in x.items()}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == ROCKS
    assert queries.QUERIES["anchored_microbatch"]


def test_timers_close_batches_and_state_goes(spark, tmp_path):
    """By the machine's clock: no input comes after the first files, yet all batches close and nothing is kept."""
    rows = [(k, i, f"2024-01-01 00:00:0{i}") for k in ("a", "b") for i in range(5)] + [(None, 9, "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "k string, i long, t string").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, i long, t timestamp").parquet(str(tmp_path / "in"))
    q = timed_batches(stream, "k", "t", "i", gap_ms=300, most=3, idle_ms=1500).writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        until, seen = time.time() + 120, []
        while time.time() < until:
            seen = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if json.loads(p.json)["stateOperators"]]
            if len(seen) > 2 and max(seen) > 0 and seen[-1] == 0:
                break
            time.sleep(0.3)
        assert max(seen) > 0 and seen[-1] == 0
    finally:
        q.stop()
    got = sorted((r.key, r.batch, r["items"], r.closed) for r in spark.table("timed").collect())
    assert got == [(k, *x) for k in ("a", "b") for x in ((0, [0, 1, 2], "size"), (1, [3, 4], "time"))]


def test_late_rows_and_watermark(spark, tmp_path):
    """Two triggers: an open batch goes on in the second, one that the watermark has passed doesn't."""
    schema = "k long, i long, t timestamp"
    for n, rows in enumerate([[(1, 1, "00:00:00"), (2, 2, "00:00:30")], [(2, 3, "00:00:31"), (1, 4, "00:00:40"), (1, 5, "00:00:01")]]):
        df = spark.createDataFrame([(k, i, f"2024-01-01 {t}") for k, i, t in rows], "k long, i long, t string").withColumn("t", F.col("t").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = timed_batches(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", "t", "i", 10_000, 9, 3_600_000, event_time=True)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None, n
    got = sorted((r.key, r.batch, tuple(r["items"])) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0, (1,))]  # 5 came too late; the batches of 2, 3 and of 4 are still open
