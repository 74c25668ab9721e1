"""Token files: little-endian ids of fixed width, written with a commit, read by place.

A committed folder holds files of any names and a manifest that lists those that count, in order, with their numbers of
tokens. Tasks write files under names of their own; what a task writes counts once the driver has put its message into
the manifest, which replaces the one before in one step. So files of failed, repeated or speculative tasks and of
earlier writes never count, and the commit removes them. One writer at a time may write to a folder.

Reading knows each token's place: a task reads a range of records, and ranges outside the places that are asked for
aren't read at all. A plain file without a manifest is a table of its own.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .ranges import files_of

MANIFEST = "_manifest.json"
#: Tokens of a task's range and of a batch; tokens between two windows that are read rather than skipped.
SPLIT, BATCH, NEAR = 32 << 20, 1 << 16, 1 << 14


@dataclass(frozen=True)
class TokenFile:
    """A file, the place of its first token among all, and how many it has."""

    path: str
    offset: int
    tokens: int


def _manifest(path: str) -> list[dict] | None:
    system, inner = pafs.FileSystem.from_uri(path.rstrip("/"))
    name = f"{inner}/{MANIFEST}"
    if system.get_file_info(name).type != pafs.FileType.File:
        return None
    with system.open_input_stream(name) as f:
        return json.loads(f.read())["files"]


def token_files(path: str, width: int) -> list[TokenFile]:
    """A committed folder's files, with places that run on; else each file by itself, from place 0."""
    found = _manifest(path)
    if found is None:
        return [TokenFile(p, 0, n // width) for p, n in files_of(path)]
    out, at = [], 0
    for f in found:
        out.append(TokenFile(f"{path.rstrip('/')}/{f['file']}", at, f["tokens"]))
        at += f["tokens"]
    return out


def total(path: str, width: int = 2) -> int:
    return sum(f.tokens for f in token_files(path, width))


@dataclass
class Records(InputPartition):
    """Tokens ``start`` to ``end`` of a file, by their places in it."""

    file: TokenFile
    start: int
    end: int


class TokenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.width, self.split = options["path"], int(options.get("width", 2)), int(options.get("split", SPLIT))
        self.low, self.high, self.some = 0, None, None

    def pushFilters(self, filters):
        """Bounds and lists of places decide what is read; Spark still applies all filters to the rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("position",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    end = f.value + isinstance(f, LessThanOrEqual)
                    self.high = end if self.high is None else min(self.high, end)
                elif isinstance(f, (EqualTo, In)):
                    here = {f.value} if isinstance(f, EqualTo) else set(f.value)
                    self.some = sorted(here if self.some is None else here & set(self.some))
            yield f

    def partitions(self):
        out = []
        for file in token_files(self.path, self.width):
            low = max(0, self.low - file.offset)
            high = file.tokens if self.high is None else min(file.tokens, self.high - file.offset)
            for at in range(low // self.split * self.split, max(high, 0), self.split):
                start, end = max(at, low), min(at + self.split, high)
                if self.some is not None:
                    asked = [p - file.offset for p in self.some if start <= p - file.offset < end]
                    if not asked:
                        continue
                    start, end = asked[0], asked[-1] + 1
                if start < end:
                    out.append(Records(file, start, end))
        return out or [Records(TokenFile("", 0, 0), 0, 0)]

    def read(self, partition):
        file, at, end = partition.file, partition.start, partition.end
        if at == end:
            return
        system, inner = pafs.FileSystem.from_uri(file.path)
        with system.open_input_file(inner) as f:
            while at < end:
                n = min(BATCH, end - at)
                ids = np.frombuffer(f.read_at(n * self.width, at * self.width), f"<u{self.width}").astype(np.int64)
                places = np.arange(file.offset + at, file.offset + at + n)
                yield pa.RecordBatch.from_arrays([pa.array([file.path] * n), pa.array(places), pa.array(ids)], ["path", "position", "token"])
                at += n


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    tokens: int


class TokenWriter(DataSourceArrowWriter):
    """Writes the rows' ids one after the other; the partitions' order is the files'."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.width, self.overwrite, self.job = options["path"].rstrip("/"), int(options.get("width", 2)), overwrite, uuid.uuid4().hex[:12]
        system, inner = pafs.FileSystem.from_uri(self.path)
        system.create_dir(inner, recursive=True)

    def write(self, iterator):
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId() if TaskContext.get() else 0
        name, n = f"tokens-{self.job}-{partition:06d}-{uuid.uuid4().hex[:8]}.bin", 0
        system, inner = pafs.FileSystem.from_uri(self.path)
        with system.open_output_stream(f"{inner}/{name}") as out:
            for batch in iterator:
                ids = batch.column(0).flatten()
                if ids.null_count:
                    raise ValueError("a token is null")
                ids = ids.to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= 1 << (8 * self.width)):
                    raise ValueError(f"a token doesn't fit into {self.width} bytes")
                out.write(ids.astype(f"<u{self.width}").tobytes())
                n += len(ids)
        return Written(partition, name, n)

    def commit(self, messages):
        """Replaces the manifest, then removes the files that it doesn't list."""
        system, inner = pafs.FileSystem.from_uri(self.path)
        before = [] if self.overwrite else _manifest(self.path) or []
        files = before + [{"file": m.file, "tokens": m.tokens} for m in sorted((m for m in messages if m), key=lambda m: m.partition) if m.tokens]
        fresh = f"{inner}/.{MANIFEST}.{self.job}"
        with system.open_output_stream(fresh) as out:
            out.write(json.dumps({"width": self.width, "files": files}, indent=0).encode())
        system.move(fresh, f"{inner}/{MANIFEST}")
        listed = {f["file"] for f in files}
        for x in system.get_file_info(pafs.FileSelector(inner)):
            if x.base_name.startswith("tokens-") and x.base_name not in listed:
                system.delete_file(x.path)

    def abort(self, messages):
        """The manifest stays as it was; what this job wrote goes."""
        system, inner = pafs.FileSystem.from_uri(self.path)
        for x in system.get_file_info(pafs.FileSelector(inner)):
            if x.base_name.startswith(f"tokens-{self.job}-"):
                system.delete_file(x.path)


class TokenSource(DataSource):
    """format("colloquy_tokens") with options path, width (bytes of a token) and split (tokens of a range)."""

    @classmethod
    def name(cls):
        return "colloquy_tokens"

    def schema(self):
        return "path string, position long, token long"

    def reader(self, schema):
        return TokenReader(self.options)

    def writer(self, schema, overwrite):
        return TokenWriter(self.options, overwrite)


def read(spark: SparkSession, path: str, width: int = 2, split: int = SPLIT) -> DataFrame:
    """path, position and token. Bounds on position prune ranges: the session has to allow filters to be pushed to Python."""
    spark.dataSource.register(TokenSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("colloquy_tokens").options(path=path, width=width, split=split).load()


def write(df: DataFrame, path: str, order: list[str], ids: str, width: int = 2, parts: int = 8, append: bool = False) -> None:
    """Writes ``ids`` in the order of ``order`` as ``parts`` files, by ranges of the order, with one commit."""
    df.sparkSession.dataSource.register(TokenSource)
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(ids)
    rows.write.format("colloquy_tokens").options(path=path, width=width).mode("append" if append else "overwrite").save()


def near_ranges(at: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges to read for windows at sorted places, and the windows of each; those near one another share a range."""
    breaks = np.flatnonzero(np.diff(at) > length + NEAR) + 1
    for some in np.split(np.arange(len(at)), breaks):
        for few in np.split(some, range(4096, len(some), 4096)):
            if len(few):
                yield int(at[few[0]]), int(at[few[-1]]) + length, few


def read_ranges(files: list[TokenFile], opened: dict, start: int, end: int, width: int) -> np.ndarray:
    """Tokens ``start`` to ``end`` of all files, read from the files that hold them."""
    offsets, out = [f.offset for f in files], []
    k = bisect_right(offsets, start) - 1
    while start < end:
        file = files[k]
        stop = min(end, file.offset + file.tokens)
        if k not in opened:
            system, inner = pafs.FileSystem.from_uri(file.path)
            opened[k] = system.open_input_file(inner)
        out.append(np.frombuffer(opened[k].read_at((stop - start) * width, (start - file.offset) * width), f"<u{width}"))
        start, k = stop, k + 1
    return np.concatenate(out) if out else np.zeros(0, f"<u{width}")


def windows(positions: DataFrame, path: str, length: int, at: str = "at", width: int = 2, parts: int | None = None) -> DataFrame:
    """The columns of ``positions``, and the tokens at each place: x, and y one further on, ``length`` of each.

    Places go to tasks by ranges, and a task reads only the ranges of its windows. A place too near the end is an error.
    """
    files = [f for f in token_files(path, width) if f.tokens]
    most = sum(f.tokens for f in files)
    names = positions.columns

    def run(batches):
        opened: dict = {}
        for batch in batches:
            places = batch.column(at).to_numpy()
            if len(places) and (places.min() < 0 or places.max() + length + 1 > most):
                raise ValueError(f"a window of {length} tokens doesn't lie in {most} tokens")
            order = np.argsort(places, kind="stable")
            sorted_, x, y = places[order], [None] * len(places), [None] * len(places)
            for start, end, few in near_ranges(sorted_, length + 1):
                ids = read_ranges(files, opened, start, end, width).astype(np.int32)
                for i in few:
                    a = sorted_[i] - start
                    x[order[i]], y[order[i]] = ids[a : a + length], ids[a + 1 : a + 1 + length]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, kind), pa.array(y, kind)], [*names, "x", "y"])

    dealt = positions.repartitionByRange(*([parts] if parts else []), at)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in positions.schema) + ", x array<int>, y array<int>"
    return dealt.mapInArrow(run, schema)
