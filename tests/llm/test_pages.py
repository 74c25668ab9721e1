"""Extraction, archives and neighbours."""

import hashlib
import html
import re

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import ann, html_text, queries, warc

from ..oracle import connect, same
from .conftest import FOLDER


def test_extracts_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = queries.op5_html_extraction(spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_held_out_pages():
    weights, pair = html_text.model()
    tree = html_text.Tree()
    for i, p in enumerate(html_text.labelled_pages(150, seed=77)):
        tree.add(i, p)
    p, _ = html_text.marginals(tree.arrays(), weights, pair)
    assert np.mean([(p[n] >= 0.5) == tree.mark[n] for _, n, _ in tree.blocks]) > 0.95


def test_pages_of_another_kind():
    """Other words, other templates, no hints about the article: blocks are told apart, and inline elements keep their text."""
    import random

    rnd = random.Random(3)
    vocabulary = "river stone market winter letter garden window morning captain harbour silver village journey mountain evening candle".split()
    sentence = lambda: " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(9, 30))).capitalize() + "."
    right = total = 0
    weights, pair = html_text.model()
    for n in range(120):
        own = [sentence() for _ in range(rnd.randint(2, 7))]
        opening, closing = rnd.choice([('<div id="c1">', "</div>"), ("<div><div>", "</div></div>"), ('<div class="grid12 x7">', "</div>"), ("<article>", "</article>")])
        junk = ["Home", "Prices", "Contact us", "All rights reserved 2024", "Accept cookies?"]
        page = (
            f'<html><body><ul class="menu"><li><a href="/">{junk[0]}</a></li><li><a href="/p">{junk[1]}</a></li><li><a href="/c">{junk[2]}</a></li></ul>'
            + opening + "".join(f"<p>{x}</p>" for x in own) + closing + f'<div class="cookie-bar">{junk[4]} <button>OK</button></div><footer><p>{junk[3]}</p></footer></body></html>'
        )
        got = html_text.extract([page], weights, pair)[0].split("\n\n")
        right += sum(x in got for x in own) + sum(x not in got for x in junk)
        total += len(own) + len(junk)
    assert right / total > 0.95
    inline = "<article><p>See <button>this</button> word, where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds <svg><title>tip</title><text>label</text></svg> and more words follow here.</p></article>"
    assert html_text.extract([inline], weights, pair) == ["See this word, where x=2 holds label and more words follow here."]


def test_marginals_are_exact():
    """Message passing against the sum over all labellings of a small tree."""
    from itertools import product

    tree = html_text.Tree()
    tree.add(0, '<div class="post"><p>Some text.</p><p>More <a href="x">here</a></p></div><nav>menu</nav>')
    rng = np.random.default_rng(0)
    weights, pair = rng.normal(size=len(html_text.FEATURES)), rng.normal(size=(2, 2, 2))
    p, _ = html_text.marginals(tree.arrays(), weights, pair)
    n = len(tree.parent)
    total, on = 0.0, np.zeros(n)
    for x in product((0, 1), repeat=n):
        s = sum(x[i] * weights[tree.feats[i]].sum() for i in range(n)) + sum(pair[int(tree.is_text[i])][x[tree.parent[i]]][x[i]] for i in range(n) if tree.parent[i] >= 0)
        total += np.exp(s)
        on += np.exp(s) * np.array(x)
    assert np.allclose(p, on / total)


def test_odd_pages(spark):
    odd = [None, "", "plain", "<p>a", "<article><p>x &amp; y &lt;z&gt; &#233;</p><script>if (a<b) '</p>'</script><p>One.</p></article>", "<div" * 2000, "<!-- open", "</p></div>", '<a href="' + "x" * 5000, "<table><tr><td>a<td>b", "&#0;&bogus;&amp"]
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(odd)], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars", "digest", "keeper", "payload", "size", "kind")})
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert got[0] == got[1] == "" and got[4] == "x & y <z> é\n\nOne."
    assert warc.archive_and_read(df).count() == len(odd)
    assert html_text.main_text(df.limit(0)).count() == warc.archive_and_read(df.limit(0)).count() == 0


def test_archive_is_its_sql(spark):
    assert same(spark, connect(FOLDER), queries.op9_warc, queries.ORACLE_SQL["op9_warc"], FOLDER) == 50


def test_archive_round_trip(spark, tmp_path):
    big, small = "é" * 600, "tiny"
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "http://c", small), (4, "http://d", small), (5, "http://e", None), (6, "http://f", big), (None, "http://g", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_records(spark, str(tmp_path / "w")).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 6), 2: ("revisit", 6), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("response", None)}
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == 3
    head, body = bytes(got[6].record).split(b"\r\n\r\n", 1)
    assert re.search(rb"\r\nWARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r\n", head)
    assert head.startswith(b"WARC/1.1\r\n") and body == big.encode() + b"\r\n\r\n" and got[6].payload_digest == hashlib.sha1(big.encode()).hexdigest() and got[1].payload_bytes == 1200
    assert b"\r\nX: y" not in bytes(got[1].record)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(700, 16)).astype(np.float32)
    vectors[100:140] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [float("inf")] + [0.0] * 15), (1200, []), (50, vectors[50].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "vec": F.lit(1), "member": F.lit(1)})
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 700, 50):
        s = unit @ unit[q]
        s[q] = -9
        order = np.lexsort((np.arange(700), -np.round(s, 12)))[:5]
        assert set(got[q]) == {1, 2, 3, 4, 5}
        hits += len({int(i) for i in order} & {v for v, _ in got[q].values()})
    assert set(got) == set(range(0, 700, 50)) and hits >= 0.9 * 5 * 14
    assert [got[100][k][0] for k in range(1, 6)] == [101, 102, 103, 104, 105]
    assert ann.nearest(df.limit(0)).count() == 0


def one_page(source):
    return html_text.extract([source], *html_text.model())[0]


_LINE = "The first sentence of an article that says a lot of things about the world. " * 2


def test_linked_lists_of_an_article_stay():
    nav = '<nav><ul><li><a href="x">Home</a></li><li><a href="y">About us</a></li></ul></nav>'
    got = one_page(f'<html><body>{nav}<article><h1>Head</h1><p>{_LINE}</p><ul><li><a href="a">One linked item</a></li><li><a href="b">Another linked item</a></li></ul><p>{_LINE}</p></article><footer>Foot</footer></body></html>')
    assert got.split("\n\n") == ["Head", _LINE.strip(), "One linked item", "Another linked item", _LINE.strip()]


def test_stand_ins_are_left_out_only_if_they_are_closed():
    for name in sorted(html_text.INSTEAD):
        closed = one_page(f"<article><h1>Head</h1><p>{_LINE}</p><p>before <{name}>Can't be shown.</{name}> after it the text goes on.</p><{name}><p>Neither can this.</p></{name}><p>{_LINE}</p></article>")
        assert " ".join(closed.split()) == f"Head {_LINE}before after it the text goes on. {_LINE.strip()}"
        unclosed = one_page(f"<article><h1>Head</h1><p>{_LINE}</p><p>before <{name} data='x'>and after it the text goes on.</p><p>{_LINE}</p></article>")
        assert " ".join(unclosed.split()) == f"Head {_LINE}before and after it the text goes on. {_LINE.strip()}"
        mixed = f"<div><{name}>a<p>b</div><{name}>c<{name}>d</{name}>e</{name}><{name}/>f</{name}>"
        assert [mixed[a:b] for a, b in sorted(html_text.stand_ins(mixed).items())] == [f"c<{name}>d</{name}>e</{name}>", f"d</{name}>"]
    assert html_text.stand_ins("<script><video></script></video><p>x") == {}
    many = "<object>" * 20000 + "<p>" * 20000 + "</div></video>" * 20000  # in time in proportion
    assert html_text.stand_ins(many) == {}


def test_neighbours_of_very_large_and_very_small_vectors(spark):
    draw = np.random.default_rng(8)
    vectors = draw.normal(size=(300, 8)) * 10.0 ** draw.choice([-200, -60, 0, 60, 200], 300)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    near = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    right = total = 0
    for r in ann.nearest(df, every=50, k=5).collect():
        sims = near @ near[r.query_id]
        assert abs(r.score - sims[r.vec_id]) < 1e-12
        best = [i for i in np.lexsort((np.arange(300), -sims)) if i != r.query_id][:5]
        right, total = right + (r.vec_id in best), total + 1
    assert total == 30 and right >= 29
