"""Personal data, found by boosted trees over candidate spans, in DataFrame functions only.

Generators propose spans of four kinds with high recall; they overlap freely. Four of them are plain rules whose
spans always stay (the base). The other candidates get format features (digits, separators, check digit, length) and
context features (words before them, neighbours), a score by boosted trees, and stay if the score reaches their
kind's calibrated threshold and nothing that stays overlaps them. Trees and thresholds are fitted on labelled
examples that are generated here: at most ``EXAMPLES`` of them, half to fit and half to calibrate.

Null text has no spans. Positions are code points, ends exclusive. Texts of any length are scanned whole; patterns
neither recurse nor restart inside a run, so a long run costs time in proportion. Rows keep their number, repeated
rows give repeated results, an empty table gives an empty table. Our own columns are dropped again; input columns
with the same names are put aside by the callers that pass rows through.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]

#: A local part starts where a run of its characters starts, or where the last match ended; a domain ends at the first
#: place where neither a label nor a dot with a label follows.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]+?(?![A-Za-z0-9-]|\.[A-Za-z0-9-])"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Run over texts in which separators that don't stand alone between two digits are masked.
CARD = r"[0-9][0-9 -]+"
LOOSE = r"(?<![0-9])[ -]|[ -](?![0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Candidates that trees decide on.
OBFUSCATED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?|\.)[A-Za-z]{2,10}(?![A-Za-z0-9])"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63}){0,3} dot [A-Za-z]{2,10}(?![A-Za-z0-9])"
IPV6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:]|\.[0-9])"
PLAIN_PHONE = r"(?<![0-9A-Za-z+(./:-])(?:00[0-9]{9,13}|[0-9]{10,11}|0[0-9]{2,4}[ /][0-9]{5,8})(?![0-9A-Za-z/-]|[.,:][0-9])"
LOCAL_PHONE = r"(?<![0-9A-Za-z+(.-])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
#: A card's number by itself; the rule drops it where it runs on into other numbers, as in an address before it.
LONE_CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])"

SPAN = "struct<kind:int,s:int,e:int,hit:string>"
EMPTY = f"cast(array() as array<{SPAN}>)"


def _find(text: str, pattern: str, kind: int) -> str:
    """SQL for all spans of ``pattern`` in the column ``text``; gaps between matches give the positions."""
    hits, rx = f"regexp_extract_all({text}, r'{pattern}', 0)", f"r'{pattern}'"
    pairs = f"zip_with({hits}, slice(split({text}, {rx}, -1), 1, size({hits})), (h, g) -> struct(h AS h, char_length(g) AS g))"
    return f"""aggregate({pairs}, struct(0 AS at, {EMPTY} AS out),
        (a, x) -> struct(a.at + x.g + char_length(x.h) AS at,
                         concat(a.out, array(struct({kind} AS kind, a.at + x.g AS s, a.at + x.g + char_length(x.h) AS e, x.h AS hit))) AS out),
        a -> a.out)"""


def _luhn(digits: str) -> str:
    """SQL for whether a string of digits has the right check digit."""
    value = f"cast(substr({digits}, char_length({digits}) - i, 1) AS int)"
    return f"(aggregate(transform(sequence(0, char_length({digits}) - 1), i -> IF(i % 2 = 0, {value}, IF({value} > 4, 2 * {value} - 9, 2 * {value}))), 0, (a, x) -> a + x) % 10 = 0)"


DIGITS = "regexp_replace(c.hit, '[^0-9]', '')"
#: Which matches of a rule count.
RULES = {
    0: "true",
    1: r"NOT exists(split(c.hit, r'\.'), p -> NOT p rlike '^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)$')",
    2: f"IF(char_length({DIGITS}) BETWEEN 16 AND 19, {_luhn(DIGITS)}, false)",
    3: f"char_length({DIGITS}) BETWEEN 8 AND 15",
}


def _when(gate: str, spans: str) -> str:
    """A generator runs only on texts that can hold its spans."""
    return f"CASE WHEN {gate} THEN {spans} ELSE {EMPTY} END"


def with_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds base_ (spans by the rules) and more_ (candidates)."""
    out = df.withColumn("t_", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    out = out.withColumn("d_", F.col("t_").rlike("[0-9]"))
    out = out.withColumn("c_", F.expr(f"CASE WHEN d_ AND t_ rlike '[0-9](?:[ -]?[0-9]){{12}}' THEN {_find('m', CARD, 2).replace('(m,', '(' + _masked() + ',')} ELSE {EMPTY} END"))
    rules = [
        _when("contains(t_, '@')", _find("t_", EMAIL, 0)),
        _when(r"d_ AND t_ rlike r'[0-9]\.[0-9]++\.[0-9]'", f"filter({_find('t_', IP, 1)}, c -> {RULES[1]})"),
        f"filter(c_, c -> {RULES[2]})",
        _when("d_ AND contains(t_, '+')", f"filter({_find('t_', PHONE, 3)}, c -> {RULES[3]})"),
    ]
    more = [
        _when(r"t_ rlike r'[\[(] ?at ?[\])]'", _find("t_", OBFUSCATED, 0)),
        _when("contains(t_, ' at ') AND contains(t_, ' dot ')", _find("t_", SPELLED, 0)),
        _when("d_ AND contains(t_, ':') AND t_ rlike '[0-9A-Fa-f]:(?:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:|:[0-9A-Fa-f])'", _find("t_", IPV6, 1)),
        _when(f"exists(c_, c -> NOT ({RULES[2]}))", _find("t_", LONE_CARD, 2)),
        _when(r"d_ AND t_ rlike r'[0-9]{3}[ .-][0-9]{4}'", _find("t_", LOCAL_PHONE, 3)),
        _when(r"d_ AND t_ rlike r'[0-9]{10}|0[0-9]{2,4}[ /][0-9]{5}'", _find("t_", PLAIN_PHONE, 3)),
    ]
    return out.withColumn("base_", F.expr(f"concat({', '.join(rules)})")).withColumn("more_", F.expr(f"concat({', '.join(more)})")).drop("c_", "d_")


def _masked() -> str:
    return f"regexp_replace(t_, r'{LOOSE}', '_')"


#: Words before a span that speak for or against it, by kind.
FOR = ["mail|contact|write", "address|host|server|client|ip", "card|visa|master|amex|pay|credit|debit|charge|karte|tarjeta|carte", "phone|call|tel|mobile|fax|contact|whatsapp|sms"]
AGAINST = "order|invoice|isbn|serial|version|tracking|sku|part|item|article|page|hash|build|ref|barcode|score|population"
FEATURES = ["kind", "digits", "luhn", "length", "marks", "first", "words", "against", "glued", "repeats", "ending", "groups"]
#: Endings of host names.
ENDINGS = "com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|eu|ch|at|example"


def _features() -> str:
    """SQL that makes a candidate c of the text t_ a struct of span and features."""
    before = "lower(substring(t_, greatest(c.s - 31, 1), least(c.s, 32)))"
    cases = " ".join(f"WHEN {k} THEN {before} rlike '{words}'" for k, words in enumerate(FOR))
    return f"""struct(c.kind AS kind, c.s AS s, c.e AS e, c.hit AS hit,
        char_length({DIGITS}) AS digits,
        IF(char_length({DIGITS}) >= 2 AND c.kind = 2 AND {_luhn(DIGITS)}, 1, 0) AS luhn,
        c.e - c.s AS length,
        char_length(regexp_replace(c.hit, '[0-9A-Za-z]', '')) AS marks,
        IF(char_length({DIGITS}) = 0, -1, cast(substr({DIGITS}, 1, 1) AS int)) AS first,
        IF(CASE c.kind {cases} END, 1, 0) AS words,
        IF({before} rlike '{AGAINST}', 1, 0) AS against,
        IF(substring(t_, c.e + 1, 1) rlike '[0-9A-Za-z]' OR (c.s > 0 AND substring(t_, c.s, 1) rlike '[0-9A-Za-z]'), 1, 0) AS glued,
        IF({DIGITS} rlike '([0-9])\\\\1{{5}}', 1, 0) AS repeats,
        IF(lower(c.hit) rlike '[^a-z](?:{ENDINGS})$', 1, 0) AS ending,
        size(split(c.hit, '[^0-9A-Za-z]+')) AS groups)"""


#: The bound of the fitted sample, and its seed.
EXAMPLES, SEED = 4000, 11


def _examples() -> list[tuple[str, int]]:
    """Generated texts, each with one span of the kind that its place gives, and whether it is personal data of that kind."""
    rnd, out = random.Random(SEED), []
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    checked = lambda d: sum(int(c) if i % 2 == 0 else (2 * int(c) - 1) % 9 + 1 if c != "0" else 0 for i, c in enumerate(reversed(d))) % 10 == 0
    filler = "the of and with from that this here and then over under zone item tall blue".split()
    prose = lambda n: " ".join(rnd.choice(filler) for _ in range(n))
    yes = [["mail me", "contact", "write to", ""], ["server", "client ip", "host", "address", ""], ["card", "visa", "pay with", "credit card", "", ""], ["call", "tel", "phone", "mobile", "", ""]]
    no = ["order", "invoice", "isbn", "tracking", "serial", "item", "ref", "build", "sku", "barcode"]
    ends, names = ENDINGS.split("|"), "anna b.lee info sales joe_k office maria".split()
    group = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    for i in range(EXAMPLES):
        kind, good = i % 4, rnd.random() < 0.5
        # Few texts speak against what they hold; so neither the format nor the words alone decide.
        told = rnd.random() < (0.8 if good else 0.1)
        if kind == 0:
            user = rnd.choice(names if rnd.random() < 0.7 else filler) + (digits(2) if good and rnd.random() < 0.4 else "")
            end = rnd.choice(ends) if rnd.random() < (0.97 if good else 0.08) else rnd.choice(filler)
            if rnd.random() < 0.5:
                hit = f"{user} {rnd.choice(['[at]', '(at)', '[ at ]'])} {rnd.choice(filler)}{rnd.choice([' [dot] ', ' (dot) ', '.'])}{end}"
            else:
                hit = f"{user} at {rnd.choice(filler)}{rnd.choice(['', ' dot ' + rnd.choice(filler)])} dot {end}"
        elif kind == 1:
            if rnd.random() < 0.5:
                hit = ":".join(group(rnd.choice([4, 4, 3, 1]) if good else rnd.choice([1, 2, 2])) for _ in range(8))
            elif good:
                hit = rnd.choice(["2001:db8", "fe80", "2a02:" + group(4), "fd" + group(2)]) + "::" + ":".join(group(rnd.randint(1, 4)) for _ in range(rnd.randint(1, 4)))
            else:  # names of a programming language, and numbers of times
                hit = rnd.choice(["cafe::" + rnd.choice(["bad", "add", "feed"]), "abc::def", f"{digits(1)}::{digits(1)}", f"ad::{digits(1)}", "bed::dead"])
        elif kind == 2:
            # Cards have the check digit, and are shorter than the rule's or run on from a number before them.
            if good:
                start, size = rnd.choice([("34", 15), ("37", 15), ("36", 14), ("38", 14), ("4", 16), ("5", 16), ("6", 16)])
                body = start + digits(size - len(start) - 1)
                body = next(body + d for d in "0123456789" if checked(body + d))
                hit = f"{digits(2)} {body}" if size == 16 else body
            else:
                body = rnd.choice("0123456789") + digits(rnd.choice([12, 13, 14, 15, 15, 15, 16, 17, 18]))
                if rnd.random() < 0.3:  # other numbers have the check digit by chance
                    body = next(body[:-1] + d for d in "0123456789" if checked(body[:-1] + d))
                hit = body if rnd.random() < 0.8 else rnd.choice("12") * len(body)
            told = rnd.random() < (0.7 if good else 0.1)
        else:
            area, a, b = digits(3), digits(3), digits(4)
            shaped, plain = [f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}"], [area + a + b, "0" + area + a + b, "00" + digits(rnd.randint(9, 13)), f"0{digits(2)} {digits(7)}", f"0{digits(3)}/{digits(6)}"]
            hit = rnd.choice(shaped if rnd.random() < (0.5 if good else 0.05) else plain if good or rnd.random() < 0.7 else [f"{area} {a} {b}", f"{area}{a}-{b}"])
            told = rnd.random() < (0.95 if hit in plain else 0.7) if good else rnd.random() < 0.01
        before = rnd.choice([w for w in yes[kind] if w]) if told else rnd.choice(["", prose(1)]) if good else rnd.choice([*no, *no, ""])
        out.append((f"{prose(4)} {before} {hit} {prose(3)}", int(good)))
    return out


def _fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3) -> tuple[float, list]:
    """Boosted trees of depth three on the logistic loss. A tree is (feature, cut, left, right), a leaf a number."""
    bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score, trees = np.full(len(y), bias), []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33))) for f in range(x.shape[1])]

    def grow(rows, grad, hess, depth):
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None)
        if depth:
            for f, places in enumerate(cuts):
                for cut in places:
                    left = rows & (x[:, f] <= cut)
                    gl, hl = grad[left].sum(), hess[left].sum()
                    if min(hl, h - hl) > 1:
                        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                        if gain > best[0]:
                            best = (gain, (f, float(cut), left))
        if best[1] is None:
            return float(rate * g / (h + 1))
        f, cut, left = best[1]
        return (f, cut, grow(left, grad, hess, depth - 1), grow(rows & ~left, grad, hess, depth - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.ones(len(y), dtype=bool), y - p, p * (1 - p), 3)
        trees.append(tree)
        score += predict(tree, x)
    return bias, trees


def predict(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    return np.where(x[:, f] <= cut, predict(left, x), predict(right, x))


def _sql(tree) -> str:
    if isinstance(tree, float):
        return f"{tree!r}D"
    f, cut, left, right = tree
    return f"IF(c.{FEATURES[f]} <= {cut!r}D, {_sql(left)}, {_sql(right)})"


_MODEL: dict = {}


def fitted(spark: SparkSession, precision: float = 0.97) -> tuple[str, list[float], float]:
    """SQL for a candidate's score, the kinds' thresholds, and the accuracy on the examples that weren't fitted."""
    if "model" not in _MODEL:
        examples = _examples()
        lines = spark.range(1).select(F.posexplode(F.split(F.lit("\n".join(t for t, _ in examples)), "\n")).alias("i", "text"))
        rows = with_candidates(lines).select("i", F.expr(f"transform(more_, c -> {_features()})").alias("x")).select("i", F.inline("x")).collect()  # at most a few candidates an example
        seen = [(r["i"], [r[f] for f in FEATURES]) for r in rows]
        x, y, i = np.array([v for _, v in seen], dtype=float), np.array([examples[k][1] * (v[0] == k % 4) for k, v in seen]), np.array([k for k, _ in seen])
        fit = i // 4 % 2 == 0
        bias, trees = _fit_trees(x[fit], y[fit])
        score = bias + sum(predict(t, x) for t in trees)
        limits = []
        for kind in range(4):
            own = ~fit & (x[:, 0] == kind)
            order = np.argsort(-score[own], kind="stable")
            exact = np.cumsum(y[own][order]) / np.arange(1, len(order) + 1)
            good = np.flatnonzero(exact >= precision)
            limits.append(max(0.0, float(score[own][order][good[-1]])) if len(good) else float("inf"))  # even odds at least
        _MODEL["model"] = (f"({bias!r}D + " + " + ".join(map(_sql, trees)) + ")", limits, float(((score > 0) == y)[~fit].mean()))
    return _MODEL["model"]


def with_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds base_ and spans_: arrays of (kind, s, e, hit), by kind and start."""
    score, limits, _ = fitted(df.sparkSession)
    out = with_candidates(df, text)
    limit = "CASE c.kind " + " ".join(f"WHEN {k} THEN {v!r}D" for k, v in enumerate(limits) if v != float("inf")) + " ELSE double('inf') END"
    chosen = f"filter(transform(more_, c -> {_features()}), c -> {score} >= {limit})"
    out = out.withColumn("more_", F.expr(f"CASE WHEN size(more_) > 0 THEN transform({chosen}, c -> struct(c.kind AS kind, c.s AS s, c.e AS e, c.hit AS hit)) ELSE {EMPTY} END"))
    tagged = "array_sort(concat(transform(base_, c -> struct(c.s AS s, 0 AS extra, c AS span)), transform(more_, c -> struct(c.s AS s, 1 AS extra, c AS span))))"
    # In order of start: a base span stays, and pushes out a candidate it overlaps; a candidate stays if it is clear.
    stay = f"""aggregate({tagged}, struct({EMPTY} AS out, 0 AS upto, 0 AS extra),
        (a, x) -> CASE
            WHEN x.s >= a.upto THEN struct(concat(a.out, array(x.span)) AS out, x.span.e AS upto, x.extra AS extra)
            WHEN x.extra = 1 THEN a
            WHEN a.extra = 1 THEN struct(concat(slice(a.out, 1, size(a.out) - 1), array(x.span)) AS out, x.span.e AS upto, 0 AS extra)
            ELSE struct(concat(a.out, array(x.span)) AS out, greatest(a.upto, x.span.e) AS upto, 0 AS extra) END,
        a -> array_sort(a.out))"""
    return out.withColumn("spans_", F.expr(f"CASE WHEN size(more_) > 0 THEN {stay} ELSE base_ END")).drop("more_")


def _joined(spans: str) -> Column:
    name = "CASE c.kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    return F.expr(f"array_join(transform({spans}, c -> concat({name}, ':', c.s, ':', c.e)), ',')")


def find_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the base spans' counts and digest, and all spans."""
    out = with_spans(df.select(F.col(f"`{key}`").alias("key_"), F.col(f"`{text}`").alias("text_")), "text_")
    counts = [F.expr(f"cast(size(filter(base_, c -> c.kind = {i})) AS bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select(F.col("key_").alias(key), *counts, F.sha2(_joined("base_"), 256).alias("base_sha256"), _joined("spans_").alias("spans"))


def redact(df: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``df`` with every span replaced by its kind in brackets; ``length``, if there, is counted anew. Null text stays null."""
    aside = {c: f"in_{i}_" for i, c in enumerate(df.columns)}
    out = with_spans(df.select(*(F.col(f"`{c}`").alias(a) for c, a in aside.items())), aside[text])
    mark = "CASE x.kind " + " ".join(f"WHEN {i} THEN '[{k.upper()}]'" for i, k in enumerate(KINDS)) + " END"
    ordered = "array_sort(transform(spans_, c -> struct(c.s AS s, c.e AS e, c.kind AS kind)))"
    parts = f"""aggregate({ordered}, struct(0 AS at, cast(array() AS array<string>) AS out),
        (a, x) -> IF(x.e <= a.at, a, struct(x.e AS at, concat(a.out, array(substring(t_, a.at + 1, greatest(x.s - a.at, 0)), {mark})) AS out)),
        a -> concat(array_join(a.out, ''), substring(t_, a.at + 1, 2147483647)))"""
    body = F.when(F.size("spans_") > 0, F.expr(parts)).otherwise(F.col(aside[text]).cast("string"))
    out = out.withColumn("body_", body)
    return out.select(*(F.col("body_").alias(c) if c == text else F.when(F.col("body_").isNull(), F.col(a)).otherwise(F.char_length("body_")).cast(df.schema[c].dataType).alias(c) if c == length else F.col(a).alias(c) for c, a in aside.items()))
