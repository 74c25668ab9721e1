"""Readers that split one large file among tasks: blocks between blank lines, articles, texts between separators.

A task has a range of bytes. It owns what starts in it, and reads on past its end until that is complete, so any
place of a split gives the same rows. Line ends may be LF, CRLF or CR; bytes that aren't UTF-8 are left out.

Blocks are what splitting a text at two line ends gives. Seen by lines: a paragraph (lines that aren't empty) is a
block, and empty lines between two paragraphs end the first, stand for empty blocks, and may leave one line end before
the second, depending on their number alone. The end of a file's last line isn't part of its last block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

#: Bytes of a task's range, and of one read.
SPLIT, READ = 128 << 20, 1 << 20
#: Bytes of small ranges that one task reads, at least; larger inputs are dealt out to about ``TASKS`` tasks.
PACK, TASKS = 1 << 20, 256
#: Rows of an Arrow batch, and the bytes of text after which one is closed.
ROWS, TEXT = 10_000, 8 << 20
_LINE_END = re.compile(rb"\r\n|\r|\n")


def files_of(path: str) -> list[tuple[str, int]]:
    """Files and their sizes, by name; names that start with a dot or an underscore don't count."""
    system, inner = pafs.FileSystem.from_uri(path)
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(pafs.FileSelector(inner, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in p[len(inner) :].strip("/").split("/"))
    return sorted((head + x.path, x.size) for x in found if x.type == pafs.FileType.File and not hidden(x.path))


class Range(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        self.path, self.size, self.start, self.end = path, size, start, end


def ranges(path: str, split: int) -> list[Range]:
    return [Range(p, n, a, min(a + split, n)) for p, n in files_of(path) for a in range(0, n, split)]


class Pack(InputPartition):
    """Ranges that one task reads, one after another."""

    def __init__(self, parts: list[Range]):
        self.parts = parts


def packs(parts: list[Range]) -> list[Pack]:
    """Runs of ranges for a task each: the number of tasks is bounded until ranges fill one by themselves."""
    most = max(PACK, sum(p.end - p.start for p in parts) // TASKS)
    out, kept, size = [], [], 0
    for p in parts:
        if kept and size + p.end - p.start > most:
            out.append(Pack(kept))
            kept, size = [], 0
        kept.append(p)
        size += p.end - p.start
    return out + [Pack(kept)] if kept else out


class Bytes:
    """A file that is read at places, ``read`` bytes at once."""

    def __init__(self, path: str, size: int, read: int = READ):
        system, inner = pafs.FileSystem.from_uri(path)
        self.file, self.size, self.read = system.open_input_file(inner), size, min(READ, max(4096, read))

    def at(self, start: int, n: int) -> bytes:
        return self.file.read_at(min(n, self.size - start), start) if start < self.size else b""

    def lines(self, at: int) -> Iterator[tuple[int, bytes, int]]:
        """Start, bytes and end (after the line end) of each line from ``at`` on."""
        pieces, start, base = [], at, at
        while base < self.size:
            chunk = self.at(base, self.read)
            while chunk.endswith(b"\r") and base + len(chunk) < self.size:
                chunk += self.at(base + len(chunk), 1)  # whether a line end goes on
            i = 0
            for m in _LINE_END.finditer(chunk):
                pieces.append(chunk[i : m.start()])
                i = m.end()
                yield start, b"".join(pieces), base + i
                pieces, start = [], base + i
            pieces.append(chunk[i:])
            base += len(chunk)
        if rest := b"".join(pieces):
            yield start, rest, base

    def line_start(self, at: int) -> int:
        """The first start of a line from ``at`` on; the size if there is none."""
        if at == 0:
            return 0
        before = self.at(at - 1, 1)
        if before == b"\n" or before == b"\r" and self.at(at, 1) != b"\n":
            return at
        return next((end for _, _, end in self.lines(at)), self.size)

    def line_ends_before(self, at: int) -> tuple[int, int]:
        """How many line ends lie directly before ``at``, and where they begin."""
        run, start = b"", at
        while start:
            some = self.at(max(0, start - 4096), min(4096, start))
            kept = some[len(some.rstrip(b"\r\n")) :]
            run, start = kept + run, start - len(kept)
            if len(kept) < len(some):
                break
        return len(_LINE_END.findall(run)), start


def paragraphs(data: Bytes, at: int) -> Iterator[tuple[int, int, bool, bytes | None]]:
    """Paragraphs that start at ``at`` or later: start, empty lines before, whether it is the file's first, text.

    After the last one, the file's end, with the empty lines before it and no text.
    """
    at = data.line_start(at)
    ends, begin = data.line_ends_before(at)
    first = begin == 0  # only empty lines before
    gap, parts, start, before = ends if first else ends - 1, [], at, 0
    inside = not first and gap == 0  # of a paragraph that starts before
    for where, line, _ in data.lines(at):
        if line:
            if not parts:
                start, before = where, gap
            parts.append(line)
            gap = 0
            continue
        if parts and not inside:
            yield start, before, first, b"\n".join(parts)
            first = False
        parts, inside = [], False
        gap += 1
    if parts and not inside:
        yield start, before, first, b"\n".join(parts)
        first = False
    yield data.size, gap, first, None


def owned(part: Range) -> Iterator[tuple[int, int, bool, bytes | None]]:
    """The paragraphs that start in a range, and the one after them, or the file's end."""
    for p in paragraphs(Bytes(part.path, part.size, part.end - part.start), part.start):
        yield p
        if p[0] >= part.end:
            return


def fillers(gap: int, first: bool, last: bool) -> int:
    """How many empty blocks ``gap`` empty lines stand for."""
    if first:
        return gap // 2 + last
    return max(0, -(-gap // 2) - 1) + (last and gap > 0)


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "ignore")


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows, closed by number or by size of their texts."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(kept) >= ROWS or size >= TEXT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: pa.Schema, rows):
        self.path, self.split, self.options = options["path"], int(options.get("split", SPLIT)), dict(options)
        self.arrow, self.rows = schema, rows

    def partitions(self):
        return packs(ranges(self.path, self.split)) or [Pack([])]

    def read(self, partition):
        yield from _batched((row for part in partition.parts for row in self.rows(part, self.options)), self.arrow)


def _block_rows(part: Range, options: dict):
    seen = False
    for start, gap, first, raw in owned(part):
        if raw is not None and start < part.end:
            seen = True
            yield part.path, start, fillers(gap, first, False), ("\n" if gap and (gap % 2 == 0) != first else "") + _text(raw)
        elif raw is None and (seen or first and part.start == 0):
            # The file's end: what empty lines stand for there, by the task that owns the last paragraph.
            if n := fillers(gap, first, True):
                yield part.path, part.size, n - 1, ""


def _delimited_rows(part: Range, options: dict):
    """Texts whose first byte (or, if empty, whose separator) is in the range, and that end with a separator."""
    mark, data = options["separator"].encode(), Bytes(part.path, part.size, part.end - part.start)
    # The first text of a range starts after a separator that ends in it or just before.
    at = 0 if part.start == 0 else max(0, part.start - len(mark))
    skipped, pieces, start, tail = part.start == 0, [], 0, b""
    while at < part.size:
        chunk = tail + data.at(at, data.read)
        base, at, i = at - len(tail), min(at + data.read, part.size), 0
        while (j := chunk.find(mark, i)) >= 0:
            if skipped:
                pieces.append(chunk[i:j])
                yield part.path, start, _text(b"".join(pieces))
            pieces, i, skipped = [], j + len(mark), True
            start = base + i
            if start >= part.end:
                return
        keep = max(i, len(chunk) - len(mark) + 1)  # a separator may go on in the next read
        if skipped:
            pieces.append(chunk[i:keep])
        elif base + keep >= part.end:
            return
        tail = chunk[keep:]


def title_like(text: str) -> bool:
    return bool(text) and len(text.split()) <= 8 and not text[0].islower()


def _machine(found: Iterator[tuple[int, int, bool, bytes | None]], end: int, known: bool = False):
    """Pairs of a title and the block after it, for each state that the range may start in.

    State 0: the first paragraph is free; 1: it is the body of a title before the range. Gives (place, title, body,
    whether from 0, whether from 1), and at last (None, state after 0, state after 1). A title needs a body right after
    it; a body is never a title itself. ``known``: the range starts free in any case, as a file's first does.
    """
    free = [True, known]
    previous = None
    for start, gap, first, raw in found:
        text = _text(raw).strip() if raw is not None else ""
        if previous is not None:
            fits = bool(text) and title_like(previous[1]) and not fillers(gap, first, False)
            takes = [f and fits for f in free]
            if any(takes):
                yield previous[0], previous[1], text, *takes
            free = [not t for t in takes]
        if raw is None or start >= end:
            break
        previous = start, text
    yield None, int(not free[0]), int(not free[1])


def _article_rows(part: Range, options: dict):
    """what=sure: pairs that both states give. what=open: pairs of one state, read only until both agree."""
    sure = options["what"] == "sure"
    for row in _machine(owned(part), part.end, part.start == 0):
        if row[0] is None:
            return
        place, title, body, a, b = row
        if a and b:
            if not sure:
                return  # both are in the same state from here on
            yield part.path, part.start, place, title, body, -1
        elif not sure:
            yield part.path, part.start, place, title, body, int(b)


def _step_rows(part: Range, options: dict):
    """The state after the range for each state before it, found from as near the range's end as both agree."""
    back = 1 << 16
    while True:
        at = max(part.start, part.end - back)
        *_, (_, a, b) = _machine(owned(Range(part.path, part.size, at, part.end)), part.end, at == 0)
        if a == b or at == part.start:
            yield part.path, part.start, a, b
            return
        back *= 4


_PATH = pa.field("file", pa.string())
_FORMATS = {
    "blocks": (pa.schema([_PATH, ("start", pa.int64()), ("empty", pa.int64()), ("block", pa.string())]), _block_rows),
    "delimited": (pa.schema([_PATH, ("start", pa.int64()), ("text", pa.string())]), _delimited_rows),
    "articles": (pa.schema([_PATH, ("range", pa.int64()), ("start", pa.int64()), ("title", pa.string()), ("body", pa.string()), ("state", pa.int32())]), _article_rows),
    "steps": (pa.schema([_PATH, ("range", pa.int64()), ("after_free", pa.int32()), ("after_body", pa.int32())]), _step_rows),
}


class SplitText(DataSource):
    """format("colloquy_text") with options path, split (bytes of a range), kind and, for delimited texts, separator."""

    @classmethod
    def name(cls):
        return "colloquy_text"

    def schema(self):
        kinds = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int"}
        return ", ".join(f"{f.name} {kinds[f.type]}" for f in _FORMATS[self.options["kind"]][0])

    def reader(self, schema):
        return _Reader(self.options, *_FORMATS[self.options["kind"]])


def _scan(spark: SparkSession, path: str, kind: str, split: int, **options) -> DataFrame:
    spark.dataSource.register(SplitText)
    return spark.read.format("colloquy_text").options(path=path, kind=kind, split=split, **options).load()


def blocks(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """file, start, place and block: all blocks between blank lines; (file, start, place) is their order.

    Empty blocks stand before the paragraph at whose start they are counted.
    """
    rows = _scan(spark, path, "blocks", split)
    each = F.concat(F.array_repeat(F.lit(""), F.col("empty").cast("int")), F.array("block"))
    return rows.select("file", "start", F.posexplode(each).alias("place", "block"))


def delimited(spark: SparkSession, path: str, separator: str, split: int = SPLIT) -> DataFrame:
    """file, start and text between separators (a literal); what no separator closes is dropped.

    A separator that can overlap itself has no certain place in a range, so it is refused.
    """
    if not separator or any(separator.startswith(separator[-k:]) for k in range(1, len(separator))):
        raise ValueError("a separator must not be empty or overlap itself")
    return _scan(spark, path, "delimited", split, separator=separator)


def articles(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """file, start, title and body: a short block that doesn't start in lower case, and the block after it.

    Whether a block is still free or a body depends on the run of possible titles before it. So each range gives the
    state after it for each state before it; a prefix scan over the ranges of a file (a row each) says which holds. Only
    pairs before the first block at which both states agree wait for that, and those of the state that holds are kept.
    """
    steps = _scan(spark, path, "steps", split)
    w = Window.partitionBy("file").orderBy("range")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    flips = F.coalesce(F.sum(F.when((F.col("after_free") == 1) & (F.col("after_body") == 0), 1).otherwise(0)).over(before), F.lit(0))
    steps = steps.withColumn("flips_", flips)
    # The last range that ends in one state whatever came before, and how many turned the state around since.
    fixed = F.last(F.when(F.col("after_free") == F.col("after_body"), F.struct(F.col("after_free").alias("s"), F.col("flips_").alias("f"))), ignorenulls=True).over(before)
    state = (F.coalesce(fixed["s"], F.lit(0)) + F.col("flips_") - F.coalesce(fixed["f"], F.lit(0))) % 2
    holds = steps.select("file", "range", state.cast("int").alias("state"))
    columns = ["file", "start", "title", "body"]
    late = _scan(spark, path, "articles", split, what="open").join(holds, ["file", "range", "state"])
    return _scan(spark, path, "articles", split, what="sure").select(columns).unionByName(late.select(columns))
