"""Readers that split files: equal to one pass over the whole text, wherever the splits are."""

from itertools import pairwise

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.sources import ranges, readers
from colloquy.sources.ranges import Range

PARTS = ["\n", "\n\n", "\n\n\n", "\r\n", "\r\n\r\n", "\r", " ", "Title", "A Short Title\n\n", "lower", "Word " * 9, "é\n", "日本", "\n \n"]


def plain(text):
    return text.replace("\r\n", "\n").replace("\r", "\n")


def whole_blocks(text):
    """All blocks; the end of the last line isn't part of the last block."""
    text = plain(text)
    found = text.split("\n\n")
    return found[:-1] + [found[-1].removesuffix("\n")] if text else []


def whole_articles(text):
    found = [b.strip() for b in plain(text).split("\n\n")]
    out, body = [], -1
    for i, (title, after) in enumerate(pairwise(found)):
        if i != body and title and after and len(title.split()) <= 8 and not title[0].islower():
            out.append((title, after))
            body = i + 1
    return out


def parts_of(path, size, cuts):
    edges = sorted({0, size, *(c % (size + 1) for c in cuts)})
    return [Range(path, size, a, b) for a, b in pairwise(edges)]


def expanded(rows):
    return [b for _, start, n, block in sorted(rows, key=lambda r: r[1]) for b in [""] * n + [block]]


def paired(parts):
    """Pairs of all ranges, with the state carried from one to the next."""
    out, state = [], 0
    for part in parts:
        out += [r[2:5] for r in ranges._article_rows(part, {"what": "sure"})] + [r[2:5] for r in ranges._article_rows(part, {"what": "open"}) if r[5] == state]
        _, _, *after = next(ranges._step_rows(part, {}))
        state = after[state]
    return [(t, b) for _, t, b in sorted(out)]


@pytest.fixture(scope="module")
def scratch(tmp_path_factory):
    return tmp_path_factory.mktemp("ranges")


@settings(max_examples=250, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14), st.lists(st.integers(0, 400), max_size=5))
def test_any_splits_give_the_whole(scratch, parts, cuts):
    text = "".join(parts)
    path = scratch / "t.txt"
    path.write_bytes(text.encode())
    size = len(text.encode())
    some = parts_of(str(path), size, cuts)
    assert expanded([r for p in some for r in ranges._block_rows(p, {})]) == whole_blocks(text)
    assert paired(some) == whole_articles(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<|end|>", "<|end|>", "<|", "end", "|>", "<", "a b", "\n", "é"]), max_size=14), st.lists(st.integers(0, 200), max_size=5))
def test_any_splits_give_all_delimited_texts(scratch, parts, cuts):
    text = "".join(parts)
    path = scratch / "d.txt"
    path.write_bytes(text.encode())
    rows = [r for p in parts_of(str(path), len(text.encode()), cuts) for r in ranges._delimited_rows(p, {"separator": "<|end|>"})]
    assert [r[2] for r in sorted(rows, key=lambda r: r[1])] == text.split("<|end|>")[:-1]


def test_reads_that_end_anywhere(scratch, monkeypatch):
    """Line ends, separators and characters across the borders of reads."""
    draw = np.random.default_rng(2)
    text = "".join(draw.choice(PARTS + ["<|end|>"] * 4, 300))
    path = scratch / "r.txt"
    path.write_bytes(text.encode())
    size = len(text.encode())
    for n in (1, 2, 3, 7, 64):
        monkeypatch.setattr(ranges, "READ", n)
        some = parts_of(str(path), size, range(0, size, 97))
        assert expanded([r for p in some for r in ranges._block_rows(p, {})]) == whole_blocks(text)
        assert paired(some) == whole_articles(text)
        assert [r[2] for p in some for r in ranges._delimited_rows(p, {"separator": "<|end|>"})] == text.split("<|end|>")[:-1]


def test_titles_only(spark, tmp_path):
    """A run of possible titles over many ranges: which is a title depends on how many stand before."""
    for lead in ("", "lower case\n\n"):
        text = lead + "\n\n".join(f"Title {i}" for i in range(1001))
        (tmp_path / "t.txt").write_text(text)
        got = ranges.articles(spark, str(tmp_path / "t.txt"), split=777).orderBy("start").collect()
        assert [(r.title, r.body) for r in got] == whole_articles(text)


def test_files_of_a_folder(spark, tmp_path):
    texts = {f"{i}.txt": f"One {i}\n\nbody {i}\n\n\nlow\n\nTwo\n\nlast {i}\n" * (i + 1) for i in range(3)}
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / name).write_text(text)
    (tmp_path / "in/_SUCCESS").write_text("Hidden\n\nfile")
    (tmp_path / "in/empty.txt").write_text("")
    for split in (5, 40, 1 << 20):
        rows = ranges.blocks(spark, f"file://{tmp_path}/in", split).orderBy("file", "start", "place").collect()
        assert [r.block for r in rows] == [b for t in texts.values() for b in whole_blocks(t)]
        assert sorted((r.title, r.body) for r in readers.articles(spark, str(tmp_path / "in"), split).collect()) == sorted(x for t in texts.values() for x in whole_articles(t))
    with pytest.raises(Exception, match="none"):
        ranges.blocks(spark, str(tmp_path / "none")).collect()


def test_large_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "large.txt"
    one = "".join(f"Story {i}\n\n" + "words of a story " * 60 + "\n\n" for i in range(1000))
    with path.open("w") as f:
        for _ in range(204):
            f.write(one)
    assert path.stat().st_size > 200 << 20
    df = ranges.articles(spark, str(path), split=path.stat().st_size // 8 + 1)
    assert ranges._scan(spark, str(path), "articles", path.stat().st_size // 8 + 1, what="sure").rdd.getNumPartitions() == 8
    assert df.count() == 204_000


def test_separators(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a<|end|><|end|>b\n<|end|>cut")
    for split in (1, 4, 100):
        rows = readers.delimited_texts(spark, str(tmp_path / "t.txt"), "<|end|>", split).orderBy("start").collect()
        assert [(r.start, r.text) for r in rows] == [(0, "a"), (8, ""), (15, "b\n")]
    for bad in ("", "\n\n", "aba"):
        with pytest.raises(ValueError):
            ranges.delimited(spark, str(tmp_path / "t.txt"), bad)
