"""Fill-in-the-middle: texts cut at two ranks of their tokens, and put together in another order.

Tokens are runs of ASCII letters and single other characters, so whether one starts at a character depends on that
character and the one before. Texts are decomposed into chunks that overlap by one character; the starts of all
chunks are counted at once, prefix sums over a text's chunks say which chunk owns each cut, and only those chunks are
scanned again for the place. Work and memory beyond the text itself go by blocks of chunks, however long a text is.

Cuts and form depend on the id alone, by a digest, so a document is always cut alike and lost tasks give the same rows.
A null text is the empty text; it and texts that hold a marker stay plain. A null id counts as the empty string in the
digest. Repeated rows give repeated results, an empty table an empty one; other columns are neither read nor passed on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, spread, texts

#: The marks before prefix, suffix and middle; the shares of plain texts, and of texts with the suffix first.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
#: Bytes of a chunk, and of the block of chunks that is looked at in one go.
CHUNK, BLOCK = 1 << 12, 1 << 22

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_CHARACTER = np.ones(256, dtype=bool)  # bytes that begin a character
_CHARACTER[0x80:0xC0] = False


def token_starts(data: np.ndarray, start: int, end: int) -> np.ndarray:
    """Whether a token starts at each byte of data[start:end], by that byte and the one before; the byte at 0 starts one."""
    here = data[start:end]
    letter = _LETTER[data[max(start - 1, 0) : end]]
    joined = letter[1:] & letter[:-1] if start else np.concatenate([[False], letter[1:] & letter[:-1]])[: len(here)]
    return _CHARACTER[here] & ~joined


def chunk_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where chunks of the texts start, the token starts in each, and where each text's chunks begin.

    A text's first byte always starts a token, whatever text stands before it in ``data``.
    """
    n = -(-np.diff(offsets) // CHUNK)
    first = np.concatenate([[0], np.cumsum(n)])
    places = np.repeat(offsets[:-1] - first[:-1] * CHUNK, n) + np.arange(first[-1]) * CHUNK
    counts, ends = np.zeros(len(places), np.int64), np.concatenate([places[1:], offsets[-1:]])
    heads = np.zeros(len(places), bool)
    heads[first[:-1][n > 0]] = True
    step = max(1, BLOCK // CHUNK)
    for a in range(0, len(places), step):
        some = places[a : a + step]
        lo, hi = int(some[0]), int(ends[min(a + step, len(places)) - 1])
        starts = token_starts(data, lo, hi)
        starts[some[heads[a : a + step]] - lo] = True
        counts[a : a + step] = np.add.reduceat(starts, some - lo, dtype=np.int64)
    return places, counts, first


def cut_place(data: np.ndarray, end: int, rank: int, places: np.ndarray, before: np.ndarray) -> int:
    """The byte of a text at which its token number ``rank`` (from 0) starts, or ``end`` if it has no more.

    ``before`` is the prefix sum over the text's chunks, one longer than ``places``: the last entry holds all tokens.
    Only the chunk that owns the rank is scanned again.
    """
    if rank >= before[-1]:
        return end
    owner = int(np.searchsorted(before, rank, side="right")) - 1
    lo = int(places[owner])
    starts = token_starts(data, lo, min(lo + CHUNK, end))
    if owner == 0:
        starts[0] = True
    return lo + int(np.flatnonzero(starts)[rank - before[owner]])


def characters(data: np.ndarray, start: int, end: int) -> int:
    return sum(int(np.count_nonzero(_CHARACTER[data[a : min(a + BLOCK, end)]])) for a in range(start, end, BLOCK))


def arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "spm":
        return b"".join([SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle])
    return b"".join([PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle]) if form == "psm" else prefix + middle + suffix


def restored(form: str, output: bytes) -> bytes:
    """The text that an output was made of. Its parts hold no marker, and a marker can't begin in one and end in the next."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = head.removeprefix(PREFIX).split(SUFFIX, 1)
    else:
        suffix, prefix = head.removeprefix(SUFFIX).split(PREFIX, 1)
    return b"".join([prefix, middle, suffix])


def draws(key) -> tuple[int, int, int, int]:
    """Four numbers that a document's id stands for."""
    digest = hashlib.sha256(b"1:" + (b"" if key is None else str(key).encode())).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in range(0, 32, 8))


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", with_output: bool = False) -> DataFrame:
    """key, n (tokens), form, prefix_chars and middle_chars (null if plain), digests of output and restored text.

    ``with_output`` adds the output itself.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * with_output

    def run(batches):
        for batch in chunks(batches, text):
            data, offsets = texts(batch.column(text))
            places, counts, first = chunk_counts(data, offsets)
            found = []
            for row, name in enumerate(batch.column(key).to_pylist()):
                start, end = int(offsets[row]), int(offsets[row + 1])
                own = slice(first[row], first[row + 1])
                before = np.concatenate([[0], np.cumsum(counts[own])])
                n, body = int(before[-1]), data[start:end].tobytes()
                h1, h2, h3, h4 = draws(name)
                if not body or any(m in body for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_FROM:
                    form, sizes, output = "plain", (None, None), body
                else:
                    form = "spm" if h4 % 100 < SUFFIX_FIRST_BELOW else "psm"
                    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                    a, b = (cut_place(data, end, rank, places[own], before) for rank in (low, high))
                    sizes = characters(data, start, a), characters(data, a, b)
                    output = arranged(form, body[: a - start], body[a - start : b - start], body[b - start :])
                found.append((n, form, *sizes, hashlib.sha256(output).hexdigest(), hashlib.sha256(restored(form, output)).hexdigest(), output.decode() if with_output else None))
            columns = [pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))]
            names = [key, "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns[: 6 + with_output]], names[: 7 + with_output])

    return spread(df.select(key, text), key).mapInArrow(run, schema)


def oracle_sql() -> str:
    """DuckDB SQL: the same by lists of tokens."""
    h = lambda k: f"('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), {1 + 8 * k}, 8))::BIGINT"
    return rf"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                   {h(0)} AS h1, {h(1)} AS h2, {h(2)} AS h3, {h(3)} AS h4 FROM documents
        ), c AS (
            SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain'
                        WHEN h4 % 100 < {SUFFIX_FIRST_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM t
        ), p AS (
            SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256 FROM p
    """
