"""Packing, token counts and encoding against the libraries."""

import hashlib
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest

from colloquy.llm import bpe, packing, queries, token_counts
from colloquy.llm.fragments import ByteBpe

from .conftest import FOLDER

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_round_trip(request, library, table):
    df = request.getfixturevalue(table)
    want = []
    for r in df.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in bpe.round_trip(df, BYTE).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_white_space_and_controls_as_the_library(library):
    """All texts of up to four parts of white space, controls, a letter, a digit, a mark and a sign, and 50,000 random longer ones."""
    bpe_ = ByteBpe(BYTE)
    few = [" ", "\n", "\xa0", "\x1f", "\u2003", "a", "1", "́", "'s", "."]
    all_ = [*map(chr, range(33)), "\x7f", "\x85", "\xa0", " ", "᠎", *map(chr, range(0x2000, 0x2010)), "\u2028", "\u2029", " ", " ", "　", "a", "é", "à", "1", "'", "́", "日", "<|endoftext|>"]
    found = ["".join(x) for n in range(1, 5) for x in product(few, repeat=n)] + ["".join(x) for n in (2, 3) for x in product(all_, repeat=n)]
    draw = np.random.default_rng(5)
    found += ["".join(draw.choice(all_, n)) for n in draw.integers(4, 12, 50_000)]

    def check(some):
        offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in some])])
        got = [np.frombuffer(x, "<u4").tolist() for x in bpe_.encode(np.frombuffer("".join(some).encode(), np.uint8), offsets)]
        assert got == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]

    check([t for t in found if "<|" not in t])
    check([t for t in found if "<|" in t][:4000])


def test_encode_then_decode(odd, library):
    ids = bpe.encode(odd, BYTE)
    want = {r.doc_id: r.text or "" for r in odd.collect()}
    assert all(r.text == want[r.doc_id] for r in bpe.decode(ids, BYTE).collect())


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_counts(request, table):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    df = request.getfixturevalue(table)
    want = [(r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 4096) for r in df.collect()]
    assert sorted(map(str, (tuple(r) for r in token_counts.token_counts(df, PIECE).collect()))) == sorted(map(str, want))


def test_counts_of_long_unbroken_texts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = ["w" * 100_000, "w" * 100_000, "ab " * 5 + "e" * 70_000 + " cd", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, PIECE).collect()} == {k: len(model.encode(t)) for k, t in enumerate(texts)}
    table = token_counts.frequent_fragments(df, PIECE)
    assert table and max(map(len, table)) <= token_counts.LONGEST


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_packing(request, library, table):
    df = request.getfixturevalue(table)
    ids = {}
    for r in df.collect():
        ids.setdefault(r.doc_id, np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], dtype="<u4"))
    rows = packing.best_fit(df, BYTE).collect()
    sequences, seen = {}, {}
    for r in rows:
        body = ids[r.doc_id][r.start : r.start + r.length]
        assert len(body) == r.length and zlib.crc32(body.tobytes()) == r.ids_crc32
        assert r.length == 1024 or r.piece == 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.02 * -(-total // 1024) + 1  # the bound itself may be out of reach for few pieces
    repeats = {}
    for r in df.collect():
        repeats[r.doc_id] = repeats.get(r.doc_id, 0) + 1
    assert seen == {k: len(v) * repeats[k] for k, v in ids.items()}


def test_packing_of_repeated_ids(spark, library):
    """Rows without id, and an id with different texts of equal length: places don't clash."""
    rows = [(None, "alpha beta gamma")] * 400 + [(7, "red green"), (7, "one two"), (7, "x " * 3000)]
    got = packing.best_fit(spark.createDataFrame(rows, "doc_id long, text string"), BYTE).collect()
    places = [(r.sequence_id, r.offset + k) for r in got for k in range(r.length)]
    assert len(places) == len(set(places)) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)


def test_fullest_is_the_best():
    from itertools import product

    counts = {7: 2, 5: 1, 3: 4, 2: 0}
    for room in range(30):
        best = max(7 * a + 5 * b + 3 * c for a, b, c in product(range(3), range(2), range(5)) if 7 * a + 5 * b + 3 * c <= room)
        taken = packing.fullest(counts, room)
        assert sum(k * n for k, n in taken.items()) == best and all(n <= counts[k] for k, n in taken.items())


def test_empty(empty):
    assert packing.best_fit(empty, BYTE).count() == bpe.round_trip(empty, BYTE).count() == token_counts.token_counts(empty, PIECE).count() == 0


def test_whole_tables(spark, docs):
    n = docs.count()
    assert queries.op3_bpe_round_trip(spark, FOLDER).count() == n == queries.op2_token_counts(spark, FOLDER).count()
