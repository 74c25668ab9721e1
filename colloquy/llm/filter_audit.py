"""How five filters act on one another: what each order of them keeps and loses, and each filter's fair share.

Every document gets five failure flags and is counted by part, flags and labels. A CUBE over part and the five flags
gives, for each set of filters, the row in which all selected flags are false: the documents that survive that set,
whatever the others say. A step of an order is a pair of such sets, before and after its filter; what the step does is
the difference of two rows. So 32 sets of a part answer all 120 orders.

Whether a text repeats one with a smaller id is decided by its SHA-256 digest, over all parts. Rows are first counted
by id, digest and flags, then by digest and labels, both before they meet, so a text that a third of all rows share is
a few rows when its digest's rows come together.

A null text is the empty text; null and empty parts are one part, the empty string. Rows without id fail the repeat
filter never, nor do they make others fail. Equal ids aren't smaller than one another. A document is good or toxic if
any of its rows in labels says so. Repeated rows count as often as they occur. An empty table has no parts and no rows.
Extra columns of either table are not read.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, materialize, spread, texts

FILTERS = "ABCDE"
_ALL = (1 << len(FILTERS)) - 1
#: The limits of the filters.
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITAL_PERCENT, SIGNS = 200, 50, 3, b"#$%&*|"

_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[list(SIGNS)] = True
_CHARACTER = np.ones(256, dtype=bool)
_CHARACTER[0x80:0xC0] = False


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are in a mask."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def measured(df: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """id_, part_, digest_ and the flags A to D of each row. Words lie between ASCII white space, so bytes will do."""
    of_key = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in chunks(batches, text):
            data, offsets = texts(batch.column(text))
            body, words, distinct, digests = data.tobytes(), [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                own = body[a:b]
                found = own.split()
                words.append(len(found))
                distinct.append(len(set(found)))
                digests.append(hashlib.sha256(own).digest())
            words, distinct = np.array(words, np.int64), np.array(distinct, np.int64)
            flags = [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT_PERCENT * words, 100 * _per_text(_CAPITAL[data], offsets) > MOST_CAPITAL_PERCENT * _per_text(_CHARACTER[data], offsets), _per_text(_SIGN[data], offsets) > 0]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("part_"), pa.array(digests, pa.binary()), *(pa.array(x) for x in flags)], ["id_", "part_", "digest_", *FILTERS[:4]])

    rows = df.select(key, text, F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part_"))
    return spread(rows, key).mapInArrow(run, f"id_ {of_key}, part_ string, digest_ binary, " + ", ".join(f"{f} boolean" for f in FILTERS[:4]))


def counted(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """part_, A to E, good_, toxic_ and n_: documents counted by part, flags and labels."""
    once = rows.groupBy("id_", "part_", "digest_", *FILTERS[:4]).agg(F.count("*").alias("n_"))
    says = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    said = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("name_")).agg(says("quality").alias("good_"), says("toxic").alias("toxic_"))
    # Rows without id meet no label; each goes by its digest, so they don't gather.
    name = F.coalesce(F.col("id_").cast("string"), F.concat(F.lit("no id: "), F.hex("digest_")))
    labelled = once.withColumn("name_", name).join(said, "name_", "left").fillna(0, ["good_", "toxic_"])
    groups = labelled.groupBy("digest_", "part_", *FILTERS[:4], "good_", "toxic_").agg(F.min("id_").alias("least_"), F.min_by("n_", "id_").alias("at_least_"), F.sum("n_").alias("all_"), F.coalesce(F.sum(F.when(F.col("id_").isNull(), F.col("n_"))), F.lit(0)).alias("nameless_"))
    # A digest has one row here for each part and label that its copies have, however many they are.
    first = F.min("least_").over(Window.partitionBy("digest_"))
    stays = F.col("nameless_") + F.when(F.col("least_") == first, F.col("at_least_")).otherwise(F.lit(0))
    split = groups.withColumn("stays_", stays).withColumn("x_", F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("stays_").alias("n_")), F.struct(F.lit(True).alias("E"), (F.col("all_") - F.col("stays_")).alias("n_")))))
    flat = split.select("part_", *FILTERS[:4], "x_.E", "good_", "toxic_", "x_.n_").where("n_ > 0")
    return flat.groupBy("part_", *FILTERS).agg(F.sum("n_").alias("n_"), F.sum(F.col("n_") * F.col("good_")).alias("good_"), F.sum(F.col("n_") * F.col("toxic_")).alias("toxic_"))


def survivors(counts: DataFrame) -> DataFrame:
    """part_ (null over all parts), set_ (bits of the filters applied), n_, good_, toxic_; empty sets of survivors too."""
    sums = [F.sum(c).alias(c) for c in ("n_", "good_", "toxic_")]
    over = F.grouping("part_").alias("over_")
    selected = sum((1 - F.grouping(f).cast("int")) * (1 << i) for i, f in enumerate(FILTERS))
    cube = counts.cube("part_", *FILTERS).agg(*sums, over, selected.alias("set_"))
    none_fails = ~F.coalesce(F.greatest(*(F.coalesce(F.col(f), F.lit(False)) for f in FILTERS)), F.lit(False))
    alive = cube.where(none_fails).select("part_", "over_", "set_", "n_", "good_", "toxic_")
    whole = alive.where("set_ = 0 AND (over_ = 0 OR n_ > 0)").select("part_", "over_", F.explode(F.sequence(F.lit(0), F.lit(_ALL))).alias("set_"))
    same = (F.col("a.set_") == F.col("b.set_")) & (F.col("a.over_") == F.col("b.over_")) & F.col("a.part_").eqNullSafe(F.col("b.part_"))
    return whole.alias("a").join(alive.alias("b"), same, "left").select("a.part_", "a.over_", "a.set_", *(F.coalesce(f"b.{c}", F.lit(0)).alias(c) for c in ("n_", "good_", "toxic_")))


def steps() -> list[tuple[str, int, str, int, int]]:
    """Order, step, its filter, and the sets before and after: 600 rows."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for k, f in enumerate(order, 1):
            after = before | 1 << FILTERS.index(f)
            out.append((order, k, f, before, after))
            before = after
    return out


def audit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", overall: bool = False) -> DataFrame:
    """A row for each part, order and step; ``overall`` adds rows with a null part, over all of them."""
    spark = df.sparkSession
    sets = materialize(survivors(materialize(counted(measured(df, key, text, part), labels, key), "audit-counts")), "audit-sets")
    sets = sets if overall else sets.where("over_ = 0")
    plan = F.broadcast(spark.createDataFrame(steps(), "filter_order string, step int, filter string, before_ int, set_ int"))  # 600 rows, whatever the data
    after = sets.join(plan, "set_")
    before = sets.select(F.col("part_").alias("p_"), F.col("over_").alias("o_"), F.col("set_").alias("before_"), *(F.col(c).alias(f"{c}before") for c in ("n_", "good_", "toxic_")))
    pairs = after.join(before, ["before_"]).where(F.col("part_").eqNullSafe(F.col("p_")) & (F.col("over_") == F.col("o_")))
    done = pairs.select("part_", "over_", "filter_order", "step", "filter", F.col("n_").alias("kept"), (F.col("n_before") - F.col("n_")).alias("removed"), (F.col("good_before") - F.col("good_")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic_")).alias("toxic_lost"))
    # 120 rows of each part and filter: as the first step it removes all that fail it, as the last those that fail only it.
    own = Window.partitionBy("part_", "over_", "filter")
    failing, alone = (F.max(F.when(F.col("step") == k, F.col("removed"))).over(own) for k in (1, len(FILTERS)))
    out = done.withColumns({"failing_": failing, "unique_fails": alone, "shapley": F.sum("removed").over(own)})
    return out.select(F.col("part_").alias("part"), "filter_order", "step", "kept", "removed", (F.col("failing_") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def oracle_sql() -> str:
    """DuckDB SQL: every order is applied step by step to documents counted by flags."""
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    order = "a.f || b.f || c.f || d.f || e.f"
    return rf"""
        WITH f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        orders AS (
            SELECT {order} AS filter_order FROM f a, f b, f c, f d, f e
            WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
        ), steps AS (
            SELECT filter_order, unnest([1, 2, 3, 4, 5])::INT AS step FROM orders
        ), l AS (
            SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
        ), w AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {words} AS u FROM documents
        ), flags AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   CASE WHEN len(u) < {LEAST_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(u)) < {LEAST_DISTINCT_PERCENT} * len(u) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITAL_PERCENT} * length(text) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                   || CASE WHEN coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false) THEN 'E' ELSE '' END AS fails
            FROM w LEFT JOIN l ON w.doc_id = l.doc_id
        ), kinds AS (
            SELECT part, fails, count(*)::BIGINT AS n, (count(*) FILTER (good))::BIGINT AS good, (count(*) FILTER (toxic))::BIGINT AS toxic FROM flags GROUP BY part, fails
        ), done AS (
            SELECT part, filter_order, step, fails, n, good, toxic, filter_order[step] AS own,
                   len(regexp_replace(filter_order[1:step - 1], '[^' || fails || '0]', '', 'g')) > 0 AS earlier, contains(fails, filter_order[step]) AS failed
            FROM kinds, steps
        ), sums AS (
            SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT earlier AND NOT failed), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (NOT earlier AND failed), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (earlier AND failed), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
                   coalesce(sum(good) FILTER (NOT earlier AND failed), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT earlier AND failed), 0)::BIGINT AS toxic_lost
            FROM done GROUP BY ALL
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM sums
    """
