"""Quality rules, near-duplicates, personal data and scores against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from colloquy.llm import lm, near_dup, pii, quality, queries

from ..oracle import connect, same
from .conftest import FOLDER, lower, words


def test_quality_is_its_sql(spark):
    assert same(spark, connect(FOLDER), queries.op4_quality_rules, queries.ORACLE_SQL["op4_quality_rules"], FOLDER) == 200


def test_quality_counts(odd):
    rows = quality.quality_verdicts(odd).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        w, t = words(texts[r.doc_id]), texts[r.doc_id] or ""
        lines = [x for x in t.split("\n") if words(x)]
        at = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed)


def test_null_and_empty_groups_are_two(spark):
    """Texts of null and of empty sources have thresholds of their own."""
    plain = [(k, " ".join(f"word{(k + i) % 50}x{i}" for i in range(60)), "en", None) for k in range(40)]
    marked = [(100 + k, " ".join(f"#w{(k + i) % 50}x{i}#" for i in range(60)), "en", "") for k in range(40)]
    df = spark.createDataFrame(plain + marked, "doc_id long, text string, lang string, source string")
    groups = quality.thresholds(quality.with_counts(df, "text", ["doc_id", "lang", "source"]))
    assert sorted(r.g1 for r in groups.collect()) == ["", "="]


def test_quality_keeps_clean_and_drops_junk(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = [r for r in quality.quality_verdicts(docs).collect() if r.doc_id in labels and not r.base_failed]
    assert all(r.kept for r in rows if labels[r.doc_id] == 1)
    junk = [r.kept for r in rows if labels[r.doc_id] == 0]
    assert sum(junk) <= 0.1 * len(junk)


def test_quality_passes_columns(odd):
    kept = quality.filter_documents(odd)
    assert kept.columns == odd.columns and kept.count() <= odd.count()


def shingles(text):
    w = words(lower(text))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(texts, percent=85):
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sets, {k: find(k) for k in keys}


def test_near_duplicates(docs):
    sets, want = brute_components({r.doc_id: r.text for r in docs.collect()})
    for r in near_dup.components(docs).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicate_chains_and_groups(spark):
    """Copies, a group of near copies, a chain whose ends aren't alike, and texts that only share a passage."""
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for k in range(30):
        own = list(base)
        own[3 * k % 110] = f"x{k}"
        texts[k] = " ".join(own)
    for k in range(30, 40):
        texts[k] = " ".join(base)
    for k in range(40, 60):
        texts[k] = " ".join([*(f"p{i}" for i in range(70)), *(f"own{k}_{i}" for i in range(30))])
    for k in range(60, 70):
        texts[k] = " ".join(f"c{i}" for i in range(2 * (k - 60), 2 * (k - 60) + 60))
    texts[70] = texts[71] = ""
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    _, want = brute_components(texts)
    assert {r.doc_id: r.component_id for r in near_dup.components(df).collect()} == want


def test_near_copies_among_texts_of_one_template(spark):
    """True pairs are found though all of their buckets have other texts of the template, none similar enough, as pivots."""
    rng = random.Random(5)
    base, texts = [f"w{i}" for i in range(300)], {}
    for k in range(500):
        own = list(base)
        for at in range(rng.randrange(55), 300, 55):
            own[at] = f"x{k}_{at}"
        texts[k] = own
    for k in range(50):  # a near copy of each of the last texts
        own = list(texts[499 - k])
        for at in rng.sample(range(300), 4):
            own[at] = f"y{k}_{at}"
        texts[500 + k] = own
    texts = {k: " ".join(t) for k, t in texts.items()}
    _, want = brute_components(texts)
    assert len(set(want.values())) == 500
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.components(df).collect()} == want


def test_near_duplicates_at_sf001(spark):
    """A thousand documents, at both limits in use."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for percent in (80, 85):
        _, want = brute_components(texts, percent)
        assert {r.doc_id: r.component_id for r in near_dup.components(docs, percent=percent).collect()} == want


def test_one_id_with_several_texts(spark):
    """One node, linked with what either of its texts is similar to; a pivot with many members is dealt out."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "something else altogether in five words")]
    got = {r.doc_id: r.component_id for r in near_dup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_hot_pivot(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "MEMBERS", 7)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(60)]
    got = near_dup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 60 and {r.component_id for r in got} == {0}


def test_near_duplicates_odd(odd, empty):
    assert near_dup.components(odd).count() == odd.count()
    assert near_dup.remove_near_duplicates(odd).columns == odd.columns
    assert near_dup.components(empty).count() == 0


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(digits))) % 10 == 0
            if (kind == 1 and any(int(p) > 255 for p in m[0].split("."))) or (kind == 2 and not (16 <= len(digits) <= 19 and luhn)) or (kind == 3 and not 8 <= len(digits) <= 15):
                continue
            out.append(f"{pii.KINDS[kind]}:{m.start()}:{m.end()}")
    return out


HARD = ["4111 1111-1111 1111", "4111  1111 1111 1111", "a" * 9000 + "@b.c", "1 " * 9000, "x@" + "a." * 9000, "+" * 3000, "🎉 x@y.com.. 1.2.3.999 01.002.3.4", "a@b.c@d.e _f@g.h", "+1 (521) 555-2373+44 20 7946 0958"]


def test_personal_data(spark, docs, odd):
    texts = [r.text for r in docs.collect()] + HARD + [r.text for r in odd.collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_spans(df).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(filter(None, r.spans.split(",")))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in pii.KINDS]


def test_what_the_rules_lose(spark):
    """Numbers that run into one another are found one by one; numbers without a check digit and hex digits aren't cards."""
    rows = [
        (1, "from 99.114.106.61 4080166431094600 and on"),
        (2, "on +1 (269) 555-3296 4524132264652876 and on"),
        (3, "on +1 (836) 555-9331 53.121.55.90 and on"),
        (4, "the number 4080166431094601 stands here"),
        (5, 'token = "98e4c802c54c4021aa36798284236820092bfe6c" and on'),
        (6, "amex 378282246310005 was used"),
    ]
    got = {r.doc_id: r.spans for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "ip:5:18,card:19:35", 2: "card:21:37,phone:3:20", 3: "ip:21:33,phone:3:20", 4: "", 5: "", 6: "card:5:20"}


def test_trees_on_examples_not_fitted(spark):
    assert pii.fitted(spark)[2] > 0.95


def _second(n=1200, seed=5):
    """Examples by another generator than the fitted ones: other words, other texts around the spans."""
    rnd, out = random.Random(seed), []
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    x = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    luhn = lambda s: sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0
    end = lambda b: next(b + c for c in "0123456789" if luhn(b + c))
    frames = {
        0: (["You can contact {} any day.", "Bitte eine Mail an {} schicken!", "Questions? write {}, thanks"], ["We sat {} and waited.", "He left it {} again."]),
        1: (["The host {} is down.", "ping server {} now", "listens on {}, port 80"], ["The class {} is final.", "see {} in the source"]),
        2: (["Charge my card {} today.", "visa: {}", "tarjeta {} por favor"], ["tracking {} shipped", "isbn {} in print", "the serial {} is worn off"]),
        3: (["Call me on {} tonight.", "Telefon: {}", "my mobile is {}.", "fax {}"], ["order {} has left", "item {} is sold out", "a population of {} then"]),
    }
    for i in range(n):
        kind, good = i % 4, rnd.random() < 0.5
        if kind == 0:
            hit = rnd.choice(["karl.otto (at) firma.de", "li at post dot com", "m_ruiz[at]correo[dot]es", "eva22 at web dot mail dot org"]) if good else rnd.choice(["smiling at noon dot dash", "stars at night dot sky", "look (at) that.thing"])
        elif kind == 1:
            hit = rnd.choice([f"2001:{x(4)}::{x(4)}", f"fe80::{x(4)}:{x(4)}:{x(4)}:{x(4)}", ":".join(x(4) for _ in range(8))]) if good else rnd.choice(["dead::beef", "fa::ce", "babe::face", "1::2"])
        elif kind == 2:
            hit = rnd.choice([end("37" + d(12)), end("34" + d(12)), end("36" + d(11))]) if good else rnd.choice(["9" + d(12), d(15)])
        else:
            hit = rnd.choice([f"({d(3)}) {d(3)}-{d(4)}", d(10), f"0{d(2)} {d(7)}", f"00{d(12)}"]) if good else rnd.choice([d(10), d(11)])
        out.append((f"{i} " + rnd.choice(frames[kind][0 if good else 1]).format(hit), kind, good))
    return out


def test_figures_by_kind_on_another_generator(spark):
    examples = _second()
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(examples)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_spans(df).collect()}
    for kind, name in enumerate(pii.KINDS):
        own = [(name in got[i], good) for i, (_, k, good) in enumerate(examples) if k == kind]
        hits = sum(g and t for g, t in own)
        assert hits >= 0.9 * sum(t for _, t in own) and hits >= 0.85 * sum(g for g, _ in own), name
    assert all(0 <= v < float("inf") for v in pii.fitted(spark)[1])


def test_redaction(spark, odd):
    df = spark.createDataFrame([(1, "Write to é.me@x.org or +1 (521) 555-2373.", 5), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(df).collect()}
    assert got == {1: (t := "Write to é[EMAIL] or [PHONE].", len(t)), 2: ("clean", 5), 3: (None, None)}
    assert pii.redact(odd).columns == odd.columns


def test_scores(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    tokens = {k: [*words(lower(t)), None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    c = Counter(w for k in texts if not held[k] for w in tokens[k])
    n, v = sum(c.values()), len(c)
    rows = lm.scores(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens[r.doc_id]), sum(c[w] > 0 for w in tokens[r.doc_id]), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    ours, plain = (sum(getattr(r, x) for r in rows if r.held_out) for x in ("score", "base_score"))
    assert ours > plain  # a lower perplexity on texts that weren't trained on


def test_model_is_a_distribution(spark):
    """Spelling probabilities of all symbols after a context sum to one."""
    import numpy as np

    keys, counts = np.unique(np.concatenate([lm.symbol_keys(np.frombuffer(w, np.uint8), np.array([0, len(w)]), 3)[0] for w in (b"the", b"then", b"that", b"on", b"one")]), return_counts=True)
    s = lm.Spelling(3, keys, counts)
    for context in (int(keys[0]) // 257, 0, 97):
        assert s.symbol_probs(context * 257 + np.arange(257)).sum() == pytest.approx(1, abs=1e-9)


def test_scores_odd(odd, empty):
    assert lm.scores(odd).count() == odd.count()
    assert lm.scores(empty).count() == 0
