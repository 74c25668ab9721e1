"""Token files: commits, places, pruning, and windows that read only their ranges."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.sources import readers, token_files
from colloquy.sources.token_files import TokenFile, TokenReader, TokenWriter


def batches(*ids):
    return iter([pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.int32()))], ["ids"]) for x in ids])


def held(path):
    return np.concatenate([np.fromfile(f.path.removeprefix("file://"), "<u2") for f in token_files.token_files(path, 2)] or [np.zeros(0)]).tolist()


def test_writes_commit_once(spark, tmp_path):
    rows = [(i, list(range(i * 3, i * 3 + i % 4))) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, ids array<int>").repartition(5)
    path, want = f"file://{tmp_path}/bins", [t for _, ids in rows for t in ids]
    token_files.write(df, path, ["k"], "ids", parts=6)
    assert held(path) == want and len(token_files.token_files(path, 2)) > 1
    token_files.write(df.where("k < 30"), path, ["k"], "ids", parts=2)  # fewer files than before: none is left over
    assert held(path) == [t for k, ids in rows[:30] for t in ids]
    assert {p.name for p in (tmp_path / "bins").glob("tokens-*")} == {f["file"] for f in json.loads((tmp_path / "bins/_manifest.json").read_text())["files"]}
    token_files.write(df.where("k >= 30"), path, ["k"], "ids", parts=3, append=True)
    assert held(path) == want
    with pytest.raises(Exception, match="doesn't fit"):
        token_files.write(spark.createDataFrame([(0, [1]), (1, [70000])], "k long, ids array<int>"), path, ["k"], "ids", parts=2)
    assert held(path) == want and len(list((tmp_path / "bins").glob("tokens-*"))) == len(token_files.token_files(path, 2))
    got = readers.token_file(spark, path, split=50)
    assert [r.token for r in got.orderBy("position").collect()] == want


def test_failed_and_repeated_tasks_leave_nothing(tmp_path):
    path = f"file://{tmp_path}/t"
    first = TokenWriter({"path": path}, True)
    first.commit([first.write(batches([1, 2], [3]))])
    job = TokenWriter({"path": path}, True)
    with pytest.raises(ValueError):
        job.write(batches([4, 5], [1 << 16]))  # a task that fails after it has written
    again = job.write(batches([4, 5]))
    job.write(batches([4, 5]))  # the same by a speculative task, whose message isn't taken
    assert held(path) == [1, 2, 3]  # nothing counts before the commit
    job.commit([again, None])
    assert held(path) == [4, 5] and len(list((tmp_path / "t").glob("tokens-*"))) == 1
    stopped = TokenWriter({"path": path}, True)
    message = stopped.write(batches([9]))
    stopped.abort([message, None])
    assert held(path) == [4, 5] and len(list((tmp_path / "t").glob("tokens-*"))) == 1


def test_only_asked_ranges_are_read(spark, tmp_path):
    np.arange(100_000, dtype="<u4").tofile(tmp_path / "t.bin")
    path = str(tmp_path / "t.bin")
    df = readers.token_file(spark, path, width=4, split=1000)
    assert df.count() == 100_000 and df.where("token <> position").count() == 0
    some = df.where("position >= 5500 AND position < 7001")
    assert some.rdd.getNumPartitions() == 3 and [r.token for r in some.orderBy("position").collect()] == list(range(5500, 7001))
    few = df.where(F.col("position").isin(3, 99_999, 50_000))
    assert few.rdd.getNumPartitions() == 3 and {r.token for r in few.collect()} == {3, 50_000, 99_999}
    reader = TokenReader({"path": path, "width": "4", "split": "1000"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert len(list(reader.pushFilters([GreaterThan(("position",), 98_999), EqualTo(("position",), 99_500)]))) == 2
    (part,) = reader.partitions()
    assert (part.start, part.end) == (99_500, 99_501)
    assert df.where("position > 200000").count() == 0


@pytest.mark.parametrize("sizes", [[1000], [3, 500, 1, 496], [0, 999, 1]])
def test_windows_read_their_ranges(spark, tmp_path, sizes):
    path, at = f"file://{tmp_path}/w", 0
    ids = np.arange(1000) * 7 % 60000
    for n in sizes:
        job = TokenWriter({"path": path}, False)
        job.commit([job.write(batches(ids[at : at + n].tolist()))])
        at += n
    places = spark.createDataFrame([(i, i * 37 % 989) for i in range(200)] + [(200, 989), (201, 989)], "k long, at long")
    got = token_files.windows(places, path, 10, parts=3).collect()
    assert len(got) == 202 and all(r.x == ids[r.at : r.at + 10].tolist() and r.y == ids[r.at + 1 : r.at + 11].tolist() for r in got)
    with pytest.raises(Exception, match="doesn't lie"):
        token_files.windows(spark.createDataFrame([(990,)], "at long"), path, 10).collect()


def test_reads_near_windows_together():
    at = np.array([0, 5, 100_000, 100_001, 900_000])
    found = list(token_files.near_ranges(at, 11))
    assert [(a, b, x.tolist()) for a, b, x in found] == [(0, 16, [0, 1]), (100_000, 100_012, [2, 3]), (900_000, 900_011, [4])]

    class Counting:
        read = 0

        def read_at(self, n, start):
            Counting.read += n
            return bytes(n)

    files = [TokenFile("a", 0, 500_000), TokenFile("b", 500_000, 500_000)]
    for a, b, _ in found:
        token_files.read_ranges(files, {0: Counting(), 1: Counting()}, a, b, 2)
    assert Counting.read == 2 * (16 + 12 + 11)  # of 2,000,000 bytes


def test_empty_writes(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    token_files.write(spark.createDataFrame([], "k long, ids array<int>"), path, ["k"], "ids")
    assert token_files.token_files(path, 2) == [] and readers.token_file(spark, path).count() == 0
