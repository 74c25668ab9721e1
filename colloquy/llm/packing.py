"""Best-fit packing by minimum bin slack.

Texts are encoded and closed with an end id; only what is longer than a sequence is cut. How sequences are filled is
planned on the counts of lengths alone: at most one count for each length up to the capacity, however many texts
there are. For each kind of sequence, a subset sum over a bitset finds the fullest combination of available lengths
that holds the longest one left; it is used as often as the counts allow, and removed. Pieces then find their place
by their rank among the pieces of the same length; ranks are taken in salted groups, so that a length that a third
of all pieces share is still dealt out, rows without id among them.

Null text is the empty text, whose only id is the end id. Pieces of equal length are interchangeable; ties go by id
and piece. Repeated rows are packed as often as they occur. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, materialize, spread, texts
from .fragments import byte_bpe

#: About so many pieces stand in one salted group of a length.
GROUP = 50_000


def first_short(total: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``total`` tokens: full ones, but for the first."""
    first = (total - 1) % capacity + 1
    return [first] + [capacity] * ((total - first) // capacity)


def pieces(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text", with_ids: bool = False, encoder: Callable = byte_bpe, cut: Callable[[int, int], list[int]] = first_short) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32, doc_tokens, ids if asked for, and place.

    place numbers the pieces of a task; once they are written it stays, and tells apart rows that are alike in all
    else. ``encoder`` gives, for a tokenizer's path, what encodes texts; ``cut`` the lengths of a text's pieces.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids + ", place long"

    def run(batches):
        bpe, tail, place = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes(), 0
        for batch in chunks(batches, text):
            rows, number, start, length, crc, whole, ids = [], [], [], [], [], [], []
            for row, packed in enumerate(bpe.encode(*texts(batch.column(text)))):
                packed += tail
                total, at = len(packed) // 4, 0
                for k, n in enumerate(cut(total, capacity)):
                    body = packed[4 * at : 4 * (at + n)]
                    rows.append(row)
                    number.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(body))
                    whole.append(total)
                    if with_ids:
                        ids.append(np.frombuffer(body, dtype="<i4"))
                    at += n
            columns = [batch.column(key).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, whole))]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            columns.append(pa.array(range(place, place + len(rows)), pa.int64()))
            place += len(rows)
            yield pa.RecordBatch.from_arrays(columns, [key, "piece", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids, "place"])

    return spread(df.select(key, text), key).mapInArrow(run, schema)


def ranks(parts: DataFrame, total: int, key: str = "doc_id") -> DataFrame:
    """Adds rank_ (long, from 0) of each piece among those of its length, in place of place.

    Pieces of a length are numbered in salted groups, with the sizes of the groups before added, so a length that most
    pieces share is dealt out. Rows that tie in all of the order are alike in all columns but place, so any of them may
    take either rank.
    """
    salts = max(8, math.ceil(total / GROUP))
    salted = parts.withColumn("salt_", F.pmod(F.xxhash64(key, "piece", "place", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt_").agg(F.count("*").alias("n_"))
    before = sizes.select("length", "salt_", (F.sum("n_").over(Window.partitionBy("length").orderBy("salt_")) - F.col("n_")).alias("before_"))
    ranked = salted.withColumn("rank_", F.row_number().over(Window.partitionBy("length", "salt_").orderBy(key, "piece", "place", "ids_crc32", "start", "doc_tokens")) - 1)
    ranked = ranked.join(before, ["length", "salt_"]).withColumn("rank_", F.col("rank_") + F.col("before_"))
    return ranked.select(*(c for c in parts.columns if c != "place"), F.col("rank_").cast("long").alias("rank_"))


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum of at most ``room``: length to copies."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x, n in counts.items() if n > 0 and x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left > 0:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= (reach << (length * copies)) & mask
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + copies
            at -= length * copies
    return taken


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Intervals (length, first rank, end rank, first sequence, copies in a sequence, offset in the sequence).

    Each kind of sequence uses up at least one length or leaves fewer of it than one sequence takes, so there are
    some thousands of kinds at most, each of at most as many lengths as distinct numbers sum to the capacity.
    """
    left = {x: n for x, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    out, sequence = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        kind = fullest(left, capacity - longest)
        left[longest] += 1
        kind[longest] = kind.get(longest, 0) + 1
        times = min(left[x] // n for x, n in kind.items())
        offset = 0
        for x, n in sorted(kind.items(), reverse=True):
            out.append((x, used[x], used[x] + times * n, sequence, n, offset))
            used[x] += times * n
            left[x] -= times * n
            offset += x * n
            if not left[x]:
                del left[x]
        sequence += times
    return out


def pack(parts: DataFrame, capacity: int = 1024, key: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to a table of ``pieces``. They are read several times: pass a written table."""
    by_length = parts.groupBy("length").count().collect()  # at most ``capacity`` rows
    total = sum(r["count"] for r in by_length)
    table = np.array(plan({r["length"]: r["count"] for r in by_length}, capacity), dtype=np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    ranked = ranks(parts, total, key)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema if f.name != "place") + ", sequence_id long, offset long"
    big = np.int64(1) << 40  # ranks and lengths in one sorted key

    def place(batches):
        starts = table[:, 0] * big + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank_").to_numpy()
            row = table[np.searchsorted(starts, length * big + rank, side="right") - 1] if len(length) else np.zeros((0, 6), np.int64)
            nth = rank - row[:, 1]
            copies = np.maximum(row[:, 4], 1)
            columns = [batch.column(c) for c in batch.schema.names if c != "rank_"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 3] + nth // copies), pa.array(row[:, 5] + nth % copies * length)], [c for c in batch.schema.names if c != "rank_"] + ["sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def best_fit(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes, cuts and packs ``df``; the pieces are written once into the shared folder."""
    return pack(materialize(pieces(df, tokenizer, capacity, end_id, key, text, with_ids), "pieces"), capacity, key)
