"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Each set of word shingles gets two small collections of band values, A and B, each value made of ``ROWS`` minhashes.
Every pair (A_i, B_j) is a table key, so BANDS * BANDS tables cost only 2 * BANDS * ROWS minhash functions. Equal
sets are one class from the start. In each bucket the member with the smallest id is the pivot, and the others are
compared with it, so a bucket costs as many comparisons as it has members. The documents of buckets of three or more
that still hold different components then go through an exact prefix-filter join on their shingles, rarest first, with
position and length filters: every pair of them that is similar enough and not yet in one component is found, however
many share a passage. Every link is confirmed by exact counts on both full sets; components are found by label
propagation with pointer jumping on tables.

So a pair is lost only if it meets in no table: two sets of similarity 0.85 meet in at least one with probability
0.999, of 0.8 with 0.994, and more similar ones more surely.

Null and empty texts have the empty set, are linked with nothing, and are their own component. A text of fewer than
five words has its whole sequence as one shingle. Texts of any length give whole sets. Rows that
repeat an id and text share its component and are all kept. Rows with one id and different texts are one node: it
is linked with whatever any of its texts is similar to. A row without id joins its class but is no component's name,
and isn't kept unless it stands alone. A pair of similarity exactly at the limit is a link; of equal pivots the
smaller id wins. Columns but key and text aren't read, so names can't clash. An empty table gives an empty table.
"""

from __future__ import annotations

import gc
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerations, chunks, discard, materialize, scratch, spread, texts

#: Band values in each collection, minhashes in a band value.
BANDS, ROWS = 8, 3
#: Members of a pivot that one part compares with it.
MEMBERS = 500
_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(1, 2**63, 2 * BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _RNG.integers(1, 2**63, 2 * BANDS * ROWS, dtype=np.uint64)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


_WORDS: TwoGenerations = TwoGenerations(_word_hash, 100_000)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    body, get = data.tobytes().lower(), _WORDS.__getitem__
    words = [body[a:b].split() for a, b in pairwise(offsets.tolist())]
    flat = np.fromiter((get(w) for text in words for w in text), dtype=np.uint64, count=sum(map(len, words)))
    out, at = [], 0
    rolled = None
    if len(flat) >= width:
        rolled = flat[: len(flat) - width + 1] * _PLACE[0]
        for k in range(1, width):
            rolled = rolled + flat[k : len(flat) - width + 1 + k] * _PLACE[k]
        rolled = _mix(rolled)
    for text in words:
        n = len(text)
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            own = np.uint64(n)
            out.append(_mix(np.array([np.bitwise_xor.reduce(_mix(flat[at : at + n] * _PLACE[8 : 8 + n]) + own)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """2 * BANDS band values for each set that isn't empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    least = [np.minimum.reduceat((flat ^ t) * m, starts) for t, m in zip(_TURN, _MULTIPLY)]
    bands = []
    for b in range(2 * BANDS):
        value = np.zeros(len(sets), dtype=np.uint64)
        for r in range(ROWS):
            value = _mix(value ^ least[b * ROWS + r]) + np.uint64(b)
        bands.append(value)
    return np.stack(bands, axis=1).view(np.int64)


def _signed(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """id, n (size of the set), class (digest of the set, null if empty), bands."""

    def run(batches):
        import xxhash

        for batch in chunks(batches, text, 4 << 20):
            sets = shingle_sets(*texts(batch.column(text)), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands = signatures([sets[i] for i in full]) if full else np.zeros((0, 2 * BANDS), np.int64)
            own: list = [None] * len(sets)
            for i, b in zip(full, bands):
                own[i] = b
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(own, pa.list_(pa.int64()))], ["id", "n", "class", "bands"])

    return spread(df.select(key, text), key).mapInArrow(run, f"id {df.schema[key].dataType.simpleString()}, n long, class binary, bands array<long>")


def _sets(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    def run(batches):
        for batch in chunks(batches, text, 4 << 20):
            sets = shingle_sets(*texts(batch.column(text)), width)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "shingles"])

    return df.select(key, text).mapInArrow(run, f"id {df.schema[key].dataType.simpleString()}, shingles array<long>")


def connected_components(edges: DataFrame) -> DataFrame:
    """id and label (the smallest id reachable) for every id of the edges (a, b)."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        labels_ = labels.select("id", "label")
        near = both.join(labels_.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels_.join(near, "id").select("id", F.least("label", "near").alias("next"), F.col("label").alias("was"))
        jump = labels_.select(F.col("id").alias("next"), F.col("label").alias("far"))
        new = materialize(lower.join(jump, "next", "left").select("id", F.least("next", "far").alias("label"), "was"), "labels")
        discard(labels)
        if not new.where("label < was").limit(1).count():
            discard(both)
            return new.select("id", "label")
        labels = new


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are at least ``percent`` hundredths similar.

    A pivot ``a`` with very many members is dealt out: its set goes once to each ``MEMBERS`` of them.
    """
    pairs = materialize(pairs, "wanted")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")).where("parts > 1")
    of = lambda side: sets.select(F.col("id").alias(side), F.col("shingles").alias(f"s{side}"))
    deal = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")
    left = pairs.join(of("b"), "b").join(parts, "a", "left").withColumn("part", deal).drop("parts")
    right = of("a").join(parts, "a", "left").select("a", "sa", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    both = left.join(right, ["a", "part"]).withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b").distinct()


def _sharing(sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ``sets`` (id, shingles, component l) in different components that can be similar enough.

    Shingles are ordered by how many sets have them; those of one component only come first and join nothing. Two sets
    that are similar enough have their first common shingle early in both, and what follows it bounds what they share.
    """
    docs = sets.select(F.xxhash64("id", "shingles").alias("uid"), "id", "l", F.size("shingles").cast("long").alias("n"), "shingles")
    docs = materialize(docs.groupBy("uid", "id", "l", "n").agg(F.first("shingles").alias("shingles")), "mixed-sets")
    across = docs.select("l", F.explode("shingles").alias("g")).groupBy("g").agg(F.count("*").alias("c"), F.min("l").alias("lo"), F.max("l").alias("hi"))
    across = materialize(across.where("lo <> hi").select("g", "c"), "across")
    order = docs.select("uid", F.explode("shingles").alias("g")).join(across, "g").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("c", "g"))).alias("order"))
    own = F.col("n") - F.size("order")
    most = F.floor((100 - percent) * F.col("n") / 100) + 1 - own
    early = order.join(docs.drop("shingles"), "uid").where(most > 0).select("id", "l", "n", own.alias("own"), F.posexplode(F.slice("order", F.lit(1), most.cast("int"))))
    early = materialize(early.select("id", "l", "n", (F.col("n") - F.col("own") - F.col("pos")).alias("left"), F.col("col.g").alias("g")), "early")
    mine = ("id", "l", "n", "left")
    x = early.where((100 + percent) * F.col("left") >= 2 * percent * F.col("n")).select("g", *(F.col(c).alias(f"{c}x") for c in mine))  # the shorter of a pair
    y = early.select(F.col("g").alias("gy"), *(F.col(c).alias(f"{c}y") for c in mine))
    shorter = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("idx") < F.col("idy")))
    enough = (100 + percent) * F.least("leftx", "lefty") >= percent * (F.col("nx") + F.col("ny"))
    both = x.join(y, (F.col("g") == F.col("gy")) & (F.col("lx") != F.col("ly")) & shorter & enough & (100 * F.col("nx") >= percent * F.col("ny")))
    return both.select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct()


def _release(df: DataFrame) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that are done."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def components(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """key, n_shingles, component_id, kept: a row per row of ``df``."""
    signed = materialize(_signed(df, key, text, width), "signed")
    with scratch() as made:
        named = _components(df, signed, key, text, width, percent)
    discard(*(x for x in made if x is not named))
    out = signed.select("id", "n", "class").join(named, "class", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.col("component").isNull()).alias("kept"))


def _components(df: DataFrame, signed: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """class and component, written."""
    classes = materialize(signed.where("class IS NOT NULL AND id IS NOT NULL").groupBy("class").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")

    # One row for each table a class has an entry in: a value of each collection.
    half = lambda at: F.slice("bands", at, BANDS)
    first = classes.select(F.col("rep").alias("id"), "n", half(BANDS + 1).alias("second"), F.posexplode(half(1)).alias("i", "x"))
    entries = first.select("id", "n", "i", "x", F.posexplode("second").alias("j", "y")).select("id", "n", F.xxhash64("i", "j", "x", "y").alias("key"))
    dealt = entries.repartition(F.col("key"))  # one exchange, used for the pivots and for the members
    pivots = dealt.groupBy("key").agg(F.min(F.struct("id", "n")).alias("pivot"), F.count("*").alias("size")).where("size > 1")
    stars = dealt.join(pivots, "key").select("key", "id", "n", "size", F.col("pivot.id").alias("a"), F.col("pivot.n").alias("na"))
    stars = materialize(stars, "stars")
    alike = 100 * F.least("n", "na") >= percent * F.greatest("n", "na")
    every = materialize(stars.where(alike & (F.col("a") != F.col("id"))).groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("shared")), "pairs")
    wanted = stars.select(F.col("id").alias(key)).distinct()
    sets = materialize(_sets(df.select(key, text).join(wanted, key, "left_semi"), key, text, width), "sets")
    _release(df)

    # First each member with the pivot it shares most tables with; then what that hasn't joined.
    best = every.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")
    linked = materialize(_confirmed(best, sets, percent), "links")
    labels = connected_components(linked)
    rest = _apart(every.select("a", "b").join(best, ["a", "b"], "left_anti"), labels)
    links = materialize(_confirmed(rest, sets, percent), "links")
    if links.limit(1).count():
        linked = linked.union(links)
        labels = connected_components(linked)
    # What shares a bucket with documents of another component: all pairs of these, by an exact join.
    mixed = materialize(_mixed(stars.where("size > 2").select("key", "id"), labels).select("id").distinct(), "mixed")
    _release(df)
    if mixed.limit(1).count():
        new = _sharing(_label(sets.join(mixed, "id"), labels, "id", "l"), percent)
        new = materialize(_apart(new.join(every, ["a", "b"], "left_anti"), labels), "pairs")
        links = materialize(_confirmed(new, sets, percent), "links")
        if links.limit(1).count():
            labels = connected_components(linked.union(links))

    named = classes.select("class", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    return materialize(named.select("class", F.coalesce("label", "rep").alias("component")), "named")


def _label(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    named = labels.select(F.col("id").alias(column), F.col("label").alias(name))
    return rows.join(named, column, "left").withColumn(name, F.coalesce(name, column))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    return _label(_label(pairs, labels, "a", "la"), labels, "b", "lb").where("la <> lb").select("a", "b")


def _mixed(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries of buckets that hold more than one component."""
    named = _label(entries, labels, "id", "l")
    several = named.groupBy("key").agg(F.min("l").alias("lo"), F.max("l").alias("hi")).where("lo <> hi").select("key")
    return named.join(several, "key", "left_semi").drop("l")


def remove_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """``df`` without the rows that aren't kept; rows without id stay."""
    gone = components(df, key, text, width, percent).where(~F.col("kept") & F.col(key).isNotNull()).select(key)
    return df.join(gone, key, "left_anti").select(*df.columns)
