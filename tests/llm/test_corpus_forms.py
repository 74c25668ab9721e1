"""Power-of-two packing, the audit of filters, and fill-in-the-middle against brute force."""

import hashlib
import zlib
from itertools import permutations, product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from colloquy.llm import binary_packing, filter_audit, fim, queries
from colloquy.llm.word_bpe import WordBpe
from tests.oracle import connect, same

from .conftest import FOLDER, words

WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


def encoded(bpe, found):
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in found])])
    return [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(np.frombuffer("".join(found).encode(), np.uint8), offsets)]


def test_words_as_the_library(library):
    """All texts of up to four of these parts, many at once and one by one, and random longer ones."""
    bpe = WordBpe(WORD)
    parts = ["a", "Bc", "7", "'", "'s", "'LL", ".", "<", " ", "\n", "\x1f", "́", "é", " ", "日", "̸", "İ", "\x85", "<|endoftext|>", "ß"]
    found = ["".join(x) for n in range(1, 4) for x in product(parts, repeat=n)]
    draw = np.random.default_rng(3)
    found += ["".join(draw.choice(parts, 12)) for _ in range(4000)]
    plain = [t for t in found if "<|endoftext|>" not in t]
    assert encoded(bpe, plain) == [e.ids for e in library.encode_batch(plain, add_special_tokens=False)]
    assert encoded(bpe, found) == [e.ids for e in library.encode_batch(found, add_special_tokens=False)]


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_binary_packing(request, library, table):
    df = request.getfixturevalue(table)
    ids, repeats = {}, {}
    for r in df.collect():
        ids[r.doc_id] = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        repeats[r.doc_id] = repeats.get(r.doc_id, 0) + 1
    rows = binary_packing.pack(df, WORD, with_ids=True).collect()
    covered, sequences, buckets = {}, set(), {}
    for r in rows:
        own = ids[r.doc_id]
        body = own[r.start : r.start + r.length]
        assert r.doc_tokens == len(own) and len(body) == r.length and zlib.crc32(body.tobytes()) == r.ids_crc32 and r.ids == body.tolist()
        assert r.length == 1 << r.bucket <= 2048 and r.offset == 0 and r.sequence_id not in sequences  # a sequence of its own, without padding
        sequences.add(r.sequence_id)
        buckets.setdefault(r.bucket, []).append(r.sequence_id)
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
    assert sorted(sequences) == list(range(len(rows)))
    assert all(max(x) - min(x) == len(x) - 1 for x in buckets.values())
    for key, found in covered.items():
        n, at = len(ids[key]), 0
        want = [2048] * (n // 2048) + [1 << b for b in range(10, -1, -1) if n % 2048 >> b & 1]
        for size in want:
            assert found.count((at, size)) == repeats[key]
            at += size
        assert len(found) == len(want) * repeats[key]
    assert covered.keys() == ids.keys()


def test_binary_packing_of_rows_without_id(spark, library):
    df = spark.createDataFrame([(None, "the same text")] * 500 + [(4, "the same text"), (4, "another text, a longer one")], "doc_id long, text string")
    rows = binary_packing.pack(df, WORD).collect()
    n = len(library.encode("the same text", add_special_tokens=False).ids) + 1
    assert len({r.sequence_id for r in rows}) == len(rows) and sum(r.length for r in rows if r.doc_id is None) == 500 * n


def test_powers():
    for n in range(0, 9000):
        found = binary_packing.powers(n, 2048)
        assert sum(found) == n and all(x & (x - 1) == 0 and x <= 2048 for x in found) and len(found) == n // 2048 + bin(n % 2048).count("1")
    with pytest.raises(ValueError):
        binary_packing.pack(None, WORD, capacity=3)


def audited(docs, labels):
    """Rows by applying every order to every document."""
    good, toxic = ({r.doc_id for r in labels if getattr(r, c) == 1} - {None} for c in ("quality", "toxic"))
    ids = {}
    for r in docs:
        if r.doc_id is not None:
            ids.setdefault(r.text or "", []).append(r.doc_id)
    kinds = {}
    for r in docs:
        text, found = r.text or "", words(r.text)
        fails = "A" * (len(found) < 200) + "B" * (100 * len(set(found)) < 50 * len(found)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)) + "D" * any(c in text for c in "#$%&*|")
        fails += "E" * (r.doc_id is not None and r.doc_id > min(ids[text]))
        kinds.setdefault(r.lang or "", []).append((fails, r.doc_id in good, r.doc_id in toxic))
    out = []
    for part, found in kinds.items():
        rows, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = found
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                rows.append((part, order, step, len(left), len(gone), sum(f in x[0] for x in found) - len(gone), sum(x[0] == f for x in found), sum(x[1] for x in gone), sum(x[2] for x in gone), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_audit(request, spark, table):
    df = request.getfixturevalue(table)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet") if table == "docs" else spark.createDataFrame([(1, 1, 0), (1, None, 1), (3, 0, 1), (3, 0, None), (7, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").withColumns({"part_": F.lit(1), "n_": F.lit(1), "A": F.lit(1)})
    got = sorted(tuple(r) for r in filter_audit.audit(df, labels).collect())
    assert got == audited(df.collect(), labels.collect())
    assert len(got) == 600 * len({r.lang or "" for r in df.collect()})


def test_audit_copies_ties_and_rows_without_id(spark):
    rows = [(k, "a copied text", "en" if k % 2 else "de") for k in range(50)] + [(0, "a copied text", "en"), (None, "a copied text", "en"), (None, "a copied text", "de"), (None, "other", None), (60, "other", ""), (61, "x " * 300, ""), (62, "#" * 9 + " OK", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"id_": F.lit(1), "E": F.lit(1), "filter": F.lit(1), "step": F.lit(1), "part": F.lit("x")})
    labels = spark.createDataFrame([(k, k % 2, k % 3) for k in range(0, 70, 4)], "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in filter_audit.audit(df, labels).collect()) == audited(df.collect(), labels.collect())
    whole = [r for r in filter_audit.audit(df, labels, overall=True).collect() if r.part is None]
    one = audited(df.withColumn("lang", F.lit("all")).collect(), labels.collect())
    assert sorted((*r[1:],) for r in (tuple(r) for r in whole)) == [r[1:] for r in one]
    # The shares of an order's filters add up to what all five remove.
    assert sum(r.shapley for r in whole if r.filter_order == "ABCDE") == 120 * (len(rows) - min(r.kept for r in whole))


def middle(key, text):
    import re

    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = [int(hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, digest(text), digest(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return key, n, form, len(p), len(m), digest(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), digest(text)


@pytest.mark.parametrize("chunk", [1, 3, 4096])
@pytest.mark.parametrize("table", ["docs", "odd"])
def test_fill_in_middle(request, monkeypatch, spark, table, chunk):
    """Chunks of any size give the same; small ones are tried on the driver, as workers keep the usual size."""
    df = request.getfixturevalue(table)
    if chunk == 4096:
        extra = spark.createDataFrame([(k, t) for k, t in enumerate(["<P>a", "a<S>", "<<P", "<M" * 5000, "é" * 9000, "word " * 60000, "a" * 50000, "\n\r\n", "<P<S<M>"] * 7, 10**6)], "doc_id long, text string")
        df = df.select("doc_id", "text").union(extra).withColumns({"n": F.lit(1), "form": F.lit(1), "output": F.lit(1)})
        got = [tuple(r) for r in fim.transform(df).collect()]
        assert sorted(map(str, got)) == sorted(str(middle(r.doc_id, r.text or "")) for r in df.collect())
        for r in fim.transform(df, with_output=True).where("n < 2000").collect():
            assert hashlib.sha256(r.output.encode()).hexdigest() == r.output_sha256
        return
    monkeypatch.setattr(fim, "CHUNK", chunk)
    monkeypatch.setattr(fim, "BLOCK", 2 * chunk)
    import re

    found = [r.text[:400] for r in df.collect() if r.text]
    data, offsets = np.frombuffer("".join(found).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for t in found])])
    places, counts, first = fim.chunk_counts(data, offsets)
    for k, text in enumerate(found):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        own = slice(first[k], first[k + 1])
        before = np.concatenate([[0], np.cumsum(counts[own])])
        assert before[-1] == len(units)
        for rank in {0, 1, len(units) // 2, len(units) - 1, len(units)}:
            at = fim.cut_place(data, int(offsets[k + 1]), rank, places[own], before)
            assert at - offsets[k] == len("".join(units[:rank]).encode())


def test_restored_from_odd_parts():
    parts = [b"", b"<", b"<S", b"P>", b"<P", b"M>", b">", b"<M", b"S>a"]
    for p, m, s in product(parts, repeat=3):
        if not any(x in p + m + s for x in (b"<P>", b"<S>", b"<M>")):
            for form in ("psm", "spm"):
                assert fim.restored(form, fim.arranged(form, p, m, s)) == p + m + s


def test_empty_tables(spark, empty):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert binary_packing.pack(empty, WORD).count() == filter_audit.audit(empty, labels).count() == filter_audit.audit(empty, labels, overall=True).count() == fim.transform(empty).count() == 0


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_fill_in_middle"])
def test_sql(spark, name):
    assert same(spark, connect(FOLDER), queries.QUERIES[name], queries.ORACLE_SQL[name], FOLDER) > 0
