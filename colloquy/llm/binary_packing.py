"""Packing without padding: documents decomposed into pieces whose lengths are powers of two.

A document's number of tokens, written in binary, says how it is cut: as many full sequences as fit, then one piece
for each bit that is set in the rest, long pieces first. Pieces of equal length form a bucket, and each piece is a
sequence of its own, so no sequence crosses documents and none needs padding. Sequences of a bucket are numbered
without gaps, one bucket after the other from the shortest on: batches of a bucket hold sequences of one length.

Null text is the empty text, whose only id is the end id: one piece of one token. Very long texts are cut like any
other, never truncated. Rows are packed as often as they occur, rows without id among them; rows that are alike in all
columns may take either's number. An empty table gives an empty table. Columns beside key and text, whatever their
names, are neither read nor passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .packing import pieces, ranks
from .word_bpe import word_bpe


def powers(total: int, capacity: int) -> list[int]:
    """``total`` as a sum of powers of two of at most ``capacity`` (itself one), falling."""
    full, rest = divmod(total, capacity)
    return [capacity] * full + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def bucketed(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds bucket (the exponent of the length), sequence_id and offset to a written table of pieces."""
    sizes = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # a row for each exponent
    first, at = {}, 0
    for length in sorted(sizes):
        first[length] = at
        at += sizes[length]
    start = F.coalesce(*(F.when(F.col("length") == length, F.lit(n)) for length, n in first.items()), F.lit(0))
    numbered = ranks(parts, at, key).withColumn("sequence_id", start.cast("long") + F.col("rank_")).drop("rank_")
    return numbered.withColumn("offset", F.lit(0).cast("long")).withColumn("bucket", F.log2("length").cast("int"))


def pack(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes, decomposes and numbers ``df``; the pieces are written once into the shared folder."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    return bucketed(materialize(pieces(df, tokenizer, capacity, end_id, key, text, with_ids, encoder=word_bpe, cut=powers), "binary-pieces"), key)
