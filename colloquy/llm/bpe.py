"""Byte-pair encoding and decoding of whole texts, by forced-boundary splitting.

Null text is the empty text: no ids, empty decoded text. Very long texts are cut into fragments like any other and
never truncated. Rows keep their order and number; repeated rows give repeated results. An empty table gives an
empty table. Extra columns of the input, whatever their names, are neither read nor passed on.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, spread, texts
from .fragments import byte_bpe


def encode(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (ARRAY<INT>), as the tokenizers library encodes without added special tokens."""

    def run(batches):
        bpe = byte_bpe(tokenizer)
        for batch in chunks(batches, text):
            packed = bpe.encode(*texts(batch.column(text)))
            sizes = [len(p) // 4 for p in packed]
            ends = pa.array([0, *_running(sizes)], pa.int32())
            ids = pa.Array.from_buffers(pa.int32(), sum(sizes), [None, pa.py_buffer(b"".join(packed))])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(ends, ids)], [key, "ids"])

    return spread(df.select(key, text), key).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text``: what ids stand for, special tokens kept. Null ids decode to the empty text."""

    def run(batches):
        bpe = byte_bpe(tokenizer)
        import numpy as np

        for batch in batches:
            lists = batch.column(ids).to_pylist()
            out = [bpe.decode(np.array(x or [], dtype="<u4").tobytes()) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes, decodes the ids again, and gives digests of both beside the number of ids, without moving ids between processes."""

    def run(batches):
        bpe = byte_bpe(tokenizer)
        for batch in chunks(batches, text):
            counts, of_ids, of_text = [], [], []
            for packed in bpe.encode(*texts(batch.column(text))):
                counts.append(len(packed) // 4)
                of_ids.append(hashlib.sha256(bpe.decimals(packed)).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(packed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return spread(df.select(key, text), key).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _running(sizes: list[int]) -> list[int]:
    total, out = 0, []
    for s in sizes:
        total += s
        out.append(total)
    return out
