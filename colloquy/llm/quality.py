"""Quality rules with adaptive thresholds.

Each text gets exact counts (words, symbols, repeated lines and windows). Four rates made of them are kept as
integers, and their distributions for each language and source as histograms of at most WIDTH counts: a sketch that
is exact up to its bucket width, and that merges by adding. Sketches of sources merge to those of languages and of
the corpus. Thresholds are fences around the quartiles of a group's sketch; a group with fewer than ``least_group``
texts takes its language's fences, a small language the corpus', and no group's fences are much wider than its
language's, so that a source made of junk doesn't pass as its own norm. A text is kept if it passes the base rule
and lies within its group's fences.

Null text has no words and fails the base rule. A null language or source is a group of its own. Texts of any length
are counted whole. Repeated rows are counted as often as they occur. An empty table gives an empty table. Columns of
the input pass through ``filter_documents`` untouched; names of our own that clash are put aside.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, materialize, spread, texts

#: Buckets of a sketch; the last holds all larger values.
WIDTH = 2001
#: Rates, as (name, numerator, scale, denominator, least distance of a fence from the quartile). In thousandths, and
#: letters of a word in tenths.
RATES = [
    ("symbols", "n_symbols", 1000, "word_chars", 50),
    ("letters", "word_chars", 10, "n_words", 15),
    ("lines", "n_dup_lines", 1000, "n_lines", 500),
    ("repeats", "n_repeat_words", 1000, "n_words", 400),
]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def count_texts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The COUNTS of each text."""
    per_text = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    space = _SPACE[data]
    out = {"word_chars": per_text(~space & ((data & 0xC0) != 0x80)), "n_symbols": per_text(_SYMBOL[data])}
    body, number, ids, sizes, again, lines = data.tobytes(), {}, [], [], [], []
    for a, b in pairwise(offsets.tolist()):
        text = body[a:b]
        words = text.split()  # on exactly the six white-space bytes
        ids += [number.setdefault(w, len(number)) for w in words]
        sizes.append(len(words))
        own = [x for x in text.split(b"\n") if x and not x.isspace()]
        lines.append(len(own))
        again.append(len(own) - len(set(own)))
    out |= {"n_words": np.array(sizes), "n_dup_lines": np.array(again), "n_lines": np.array(lines)}
    out["n_repeat_words"] = _repeats(np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int64))
    return out


def _repeats(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text, how many words lie in a window of three words that the text has twice or more."""
    ends = np.cumsum(sizes)
    if len(ids) < 3:
        return np.zeros(len(sizes), dtype=np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    _, pair = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)
    window = pair[:-1].astype(np.int64) << 32 | ids[2:]
    at = np.flatnonzero(text[:-2] == text[2:])
    order = at[np.lexsort((window[at], text[at]))]
    same = (window[order[1:]] == window[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[order[twice] + k] = True
    total = np.concatenate([[0], np.cumsum(covered)])
    return total[ends] - total[ends - sizes]


def with_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all, if None) of the columns of ``df``, and the COUNTS of ``text``, under names of their own."""
    keep = df.columns if keep is None else keep
    fields = [df.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c}_ long" for c in COUNTS)])

    def run(batches):
        for batch in chunks(batches, text):
            found = count_texts(*texts(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(found[c], pa.int64()) for c in COUNTS)], [*keep, *(f"{c}_" for c in COUNTS)])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words_") < 50) | (100 * F.col("n_repeat_words_") > 50 * F.col("n_words_"))


def _rate(of: str, scale: int, by: str) -> Column:
    return F.when(F.col(f"{by}_") > 0, F.least(F.expr(f"{of}_ * {scale} div {by}_"), F.lit(WIDTH - 1))).otherwise(0)


def _group(column: str) -> Column:
    """A name for each value; null's is empty, and the empty value's isn't."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def sketches(counted: DataFrame, group: list[str]) -> DataFrame:
    """group, rate, bucket, n: the histograms of texts that pass the base rule."""
    rates = F.array(*(F.struct(F.lit(name).alias("rate"), _rate(of, scale, by).cast("int").alias("bucket")) for name, of, scale, by, _ in RATES))
    rows = counted.where(~base_failed()).select(*(_group(g).alias(f"g{i}") for i, g in enumerate(group)), F.explode(rates).alias("x"))
    return rows.groupBy(*(f"g{i}" for i in range(len(group))), "x.rate", "x.bucket").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Of merged sketches: keys, and for each rate the lower and upper fence; n_, how many texts."""
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    part = Window.partitionBy(*keys, "rate")
    merged = merged.withColumn("upto", F.sum("n").over(part.orderBy("bucket"))).withColumn("all", F.sum("n").over(part))
    quarter = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("all"), F.col("bucket")))
    q = merged.groupBy(*keys, "rate").agg(quarter(25).alias("q1"), quarter(75).alias("q3"), F.max("all").alias("all"))
    wide = [x for name, *_, least in RATES for x in (
        F.max(F.when(F.col("rate") == name, F.col("q1") - F.greatest(3 * (F.col("q3") - F.col("q1")), F.lit(least)))).alias(f"{name}_low{tag}"),
        F.max(F.when(F.col("rate") == name, F.col("q3") + F.greatest(3 * (F.col("q3") - F.col("q1")), F.lit(least)))).alias(f"{name}_high{tag}"))]
    return q.groupBy(*keys).agg(F.max("all").alias(f"n{tag}"), *wide)


def thresholds(counted: DataFrame, group: tuple[str, str] = ("lang", "source"), least_group: int = 30) -> DataFrame:
    """g0, g1 (language and source) and the fences that hold there."""
    sketch = materialize(sketches(counted, list(group)), "sketches")
    by_source, by_lang = _fences(sketch, ["g0", "g1"], "_s"), _fences(sketch, ["g0"], "_l")
    every = _fences(sketch.withColumn("one", F.lit(1)), ["one"], "_a").first()  # one row at most
    joined = by_source.join(by_lang, "g0", "left")
    out = []
    for name, *_, least in RATES:
        for side, tight, step in (("low", F.greatest, -least), ("high", F.least, least)):
            source, lang = (F.col(f"{name}_{side}{t}") for t in ("_s", "_l"))
            whole = F.lit(every[f"{name}_{side}_a"] if every else None)
            lang = F.when(F.col("n_l") >= least_group, lang).otherwise(whole)
            out.append(F.when(F.col("n_s") >= least_group, tight(source, lang + step)).otherwise(lang).alias(f"{name}_{side}"))
    return joined.select("g0", "g1", *out)


#: Up to so many groups the thresholds are broadcast; beyond, they are joined by shuffle, each group's rows salted.
BROADCAST_GROUPS, SALTS = 50_000, 32


def with_verdict(counted: DataFrame, fences: DataFrame, group: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Adds kept_ to rows with counts. ``fences`` must have been written: its rows are counted."""
    out = counted.withColumn("g0", _group(group[0])).withColumn("g1", _group(group[1]))
    if fences.count() <= BROADCAST_GROUPS:
        out = out.join(F.broadcast(fences), ["g0", "g1"], "left")
    else:
        salted = fences.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = out.withColumn("salt_", F.pmod(F.xxhash64("g0", "g1", *(f"{c}_" for c in COUNTS)), F.lit(SALTS)).cast("int")).join(salted, ["g0", "g1", "salt_"], "left").drop("salt_")
    inside = F.lit(True)
    for name, of, scale, by, _ in RATES:
        inside &= _rate(of, scale, by).between(F.col(f"{name}_low"), F.col(f"{name}_high"))
    out = out.withColumn("kept_", ~base_failed() & F.coalesce(inside, F.lit(False)))
    return out.drop("g0", "g1", *(f"{name}_{side}" for name, *_ in RATES for side in ("low", "high")))


def quality_verdicts(df: DataFrame, key: str = "doc_id", text: str = "text", group: tuple[str, str] = ("lang", "source"), least_group: int = 30) -> DataFrame:
    """A row per text: key, the counts, base_failed and kept."""
    counted = materialize(with_counts(spread(df.select(key, *group, text), key), text, [key, *group]), "counts")
    fences = materialize(thresholds(counted, group, least_group), "fences")
    out = with_verdict(counted, fences, group)
    return out.select(key, *(F.col(f"{c}_").alias(c) for c in COUNTS), base_failed().alias("base_failed"), F.col("kept_").alias("kept"))


def filter_documents(df: DataFrame, text: str = "text", group: tuple[str, str] = ("lang", "source"), least_group: int = 30) -> DataFrame:
    """The rows of ``df`` that are kept, with their own columns. Texts are read twice: for thresholds, and to filter."""
    aside = {c: f"in_{i}_" for i, c in enumerate(df.columns)}
    renamed = df.select(*(F.col(f"`{c}`").alias(a) for c, a in aside.items()))
    body, by = aside[text], (aside[group[0]], aside[group[1]])
    fences = materialize(thresholds(materialize(with_counts(renamed, body, list(by)), "counts"), by, least_group), "fences")
    out = with_verdict(with_counts(renamed, body), fences, by).where("kept_")
    return out.select(*(F.col(a).alias(c) for c, a in aside.items()))


def oracle_sql() -> str:
    """The same in DuckDB SQL, for texts without null ids."""
    rate = lambda of, scale, by: f"CASE WHEN {by} > 0 THEN least({of} * {scale} // {by}, {WIDTH - 1}) ELSE 0 END"
    rates = " UNION ALL ".join(f"SELECT lang, source, '{name}' AS rate, {rate(of, scale, by)} AS bucket FROM counted WHERE NOT base_failed" for name, of, scale, by, _ in RATES)
    least = "CASE rate " + " ".join(f"WHEN '{name}' THEN {m}" for name, *_, m in RATES) + " END"

    def level(tag: str, keys: str) -> str:
        k = f"{keys}, " if keys else ""
        return f"""
        {tag}_c AS (SELECT {k}rate, bucket, sum(n) AS n FROM sketch GROUP BY {k}rate, bucket),
        {tag}_w AS (SELECT {k}rate, bucket, sum(n) OVER (PARTITION BY {k}rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {k}rate) AS total FROM {tag}_c),
        {tag}_q AS (SELECT {k}rate, min(bucket) FILTER (100 * upto >= 25 * total) AS q1, min(bucket) FILTER (100 * upto >= 75 * total) AS q3, max(total) AS n FROM {tag}_w GROUP BY {k}rate),
        {tag} AS (SELECT {k}rate, n, q1 - greatest(3 * (q3 - q1), {least}) AS low, q3 + greatest(3 * (q3 - q1), {least}) AS high FROM {tag}_q)"""

    inside = " AND ".join(f"coalesce((SELECT {rate(of, scale, by)} BETWEEN f.low AND f.high FROM fences f WHERE f.lang = c.lang AND f.source = c.source AND f.rate = '{name}'), false)" for name, of, scale, by, _ in RATES)
    return rf"""
        WITH d AS (
            SELECT doc_id, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source, coalesce(text, '') AS text FROM documents
        ), w AS (
            SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
        ), tri AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM w, unnest(range(1, len(w) - 1)) AS t(i)
        ), rep AS (
            SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM tri, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY doc_id
        ), n AS (
            SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
                   (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                   (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l)::BIGINT AS n_lines
            FROM w LEFT JOIN rep USING (doc_id)
        ), counted AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n
        ), rates AS ({rates}),
        sketch AS (SELECT lang, source, rate, bucket, count(*) AS n FROM rates GROUP BY ALL),
        {level('s', 'lang, source')}, {level('l', 'lang')}, {level('a', '')},
        fences AS (
            SELECT lang, source, rate,
                   CASE WHEN sn >= 30 THEN greatest(slow, llow - m) ELSE llow END AS low, CASE WHEN sn >= 30 THEN least(shigh, lhigh + m) ELSE lhigh END AS high
            FROM (SELECT s.lang, s.source, rate, {least} AS m, s.n AS sn, s.low AS slow, s.high AS shigh,
                         CASE WHEN l.n >= 30 THEN l.low ELSE a.low END AS llow, CASE WHEN l.n >= 30 THEN l.high ELSE a.high END AS lhigh
                  FROM s JOIN l USING (lang, rate) JOIN a USING (rate))
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, NOT base_failed AND {inside} AS kept
        FROM counted c
    """
