"""What the operators of this subpackage share: the shared folder, partition counts, batches."""

from __future__ import annotations

import math
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_SHARED = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own if that is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or LOCAL_SHARED).rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_SCRATCH: list[list[DataFrame]] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    for made in _SCRATCH[-1:]:
        made.append(out)
    return out


@contextmanager
def scratch():
    """A list of the tables that are written inside the block, for ``discard`` once they are consumed."""
    made: list[DataFrame] = []
    _SCRATCH.append(made)
    try:
        yield made
    finally:
        _SCRATCH.remove(made)


def discard(*written: DataFrame) -> None:
    """Removes what ``materialize`` wrote, once nothing that is still to run reads it."""
    for df in written:
        path = _PATHS.pop(df, None)
        if path:
            spark = df.sparkSession
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def pack_arrays(arrays: list[np.ndarray]) -> bytes:
    """Arrays in one compressed blob, whole numbers in as few bytes as they need."""
    import zstandard

    head, body = [len(arrays)], []
    for a in arrays:
        if a.dtype.kind == "i":
            most = int(a.max()) if len(a) else 0
            a = a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)
        head += [ord(a.dtype.char), a.nbytes]
        body.append(a.tobytes())
    return zstandard.compress(np.array(head, dtype=np.int64).tobytes() + b"".join(body), 1)


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8).tolist(), 8 + 16 * n, []
    for kind, size in zip(head[::2], head[1::2]):
        kind = np.dtype(chr(kind))
        out.append(np.frombuffer(raw, kind, size // kind.itemsize, at))
        at += size
    return out


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; for a scan, the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, per_bucket: int, least: int = 8) -> int:
    """A number of buckets in proportion to the input, so that each holds about ``per_bucket`` bytes of it."""
    return max(least, math.ceil(input_bytes(df) / per_bucket))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deals rows out by ``key`` if the scan has fewer partitions than the cluster has cores (one small file); else as it is."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want, key)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = column.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices batches so that each has about ``most`` bytes of ``column`` (one longer text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = texts(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end


class TwoGenerations(dict):
    """A bounded cache: when the young generation is full it becomes the old one, and what is used again moves back."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
