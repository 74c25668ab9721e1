"""Token counts of whole texts by a map-side lookup in two tiers.

The first tier is a table of the corpus' most frequent fragments and their lengths, found by mergeable summaries
over all texts (each partition's summary is bounded, and summaries are merged in a tree), and broadcast: at most
``table_size`` entries, none longer than ``LONGEST`` bytes. What the table lacks is encoded through a bounded cache in
each worker. No pre-token ever goes through a shuffle, and the table decides speed only, never a count.

Null text is the empty text: 0 bytes, 0 tokens. Very long texts are counted whole. Rows keep their number; an empty
table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, spread, texts
from .fragments import piece_counter

#: Entries that a partition keeps while it counts, and that a summary carries; bytes of a fragment in them at most.
KEEP, SUMMARY, LONGEST = 300_000, 16_384, 256


def frequent_fragments(df: DataFrame, model: str, table_size: int = 16_384, text: str = "text") -> dict[bytes, int]:
    """The most frequent fragments of ``df`` with their token counts, at most ``table_size``."""

    def summarize(batches):
        counter, seen = piece_counter(model), Counter()
        for batch in chunks(batches, text):
            if not counter.by_fragment:
                continue
            seen.update(counter.fragments(*counter.prepare(*texts(batch.column(text))))[0])
            for f in [f for f in seen if len(f) > LONGEST]:
                del seen[f]
            if len(seen) > KEEP:
                seen = Counter(dict(seen.most_common(KEEP // 2)))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(dict(seen.most_common(SUMMARY))), 1)], pa.binary())], ["summary"])

    def merge(a: bytes, b: bytes) -> bytes:
        if not a or not b:
            return a or b
        both = Counter(pickle.loads(zlib.decompress(a)))
        both.update(pickle.loads(zlib.decompress(b)))
        return zlib.compress(pickle.dumps(dict(both.most_common(SUMMARY))), 1)

    packed = df.mapInArrow(summarize, "summary binary").rdd.map(lambda r: bytes(r[0])).treeAggregate(b"", merge, merge)
    found = Counter(pickle.loads(zlib.decompress(packed))) if packed else Counter()
    counter = piece_counter(model)
    return {f: counter._one(f) for f, _ in found.most_common(table_size)}


def token_counts(df: DataFrame, model: str, limit: int = 4096, table_size: int = 16_384, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""
    spark = df.sparkSession
    rows = spread(df.select(key, text), key)
    table = frequent_fragments(rows.select(text), model, table_size, text)
    blob, sizes = b"".join(table), np.array([(len(f), n) for f, n in table.items()], dtype=np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((blob, sizes.tobytes()))

    def run(batches):
        counter = piece_counter(model)
        body, pairs = shared.value
        pairs = np.frombuffer(pairs, dtype=np.int64).reshape(-1, 2)
        ends = np.cumsum(pairs[:, 0])
        known = {body[e - w : e]: n for e, w, n in zip(ends.tolist(), pairs[:, 0].tolist(), pairs[:, 1].tolist())}
        for batch in chunks(batches, text):
            data, offsets = texts(batch.column(text))
            n = counter.counts(data, offsets, known)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
