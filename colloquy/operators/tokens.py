"""Token ids as arrays: offsets, windows, padding, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import keyed
from .episodes import ranked


def bpe_encoder(path: str, end_id: int):
    """A function over Arrow batches of (id, text), giving ids closed by ``end_id``; a worker loads the tokenizer once."""

    def run(batches):
        import pyarrow as pa
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for b in batches:
            ids = [e.ids + [end_id] for e in tokenizer.encode_batch([t or "" for t in b.column("text").to_pylist()], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return run


def encode_texts(df: DataFrame, path: str, end_id: int, key: str = "id", text: str = "text") -> DataFrame:
    """id and ids (closed by ``end_id``) of each text, in Arrow batches."""
    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(bpe_encoder(path, end_id), "id long, ids array<int>")


def windows(df: DataFrame, ids: str, key: str, length: int, n: int, seed: int) -> DataFrame:
    """``n`` windows of each row at keyed offsets: inputs, and targets one further on."""
    some = df.where(F.size(ids) > length).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = keyed.choice(F.concat_ws("|", key, "draw"), seed, F.size(ids) - length)
    return some.withColumn("at", at).select(key, "draw", "at", F.slice(ids, (F.col("at") + 1).cast("int"), length).alias("x"), F.slice(ids, (F.col("at") + 2).cast("int"), length).alias("y"))


def left_pad(df: DataFrame, batch: str, ids: str, pad: int = 0) -> DataFrame:
    """Adds padded and mask: all rows of a batch as long as its longest, padding first."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    fill = longest - F.size(ids)
    return df.withColumn("fill_", fill).withColumn("padded", F.concat(F.array_repeat(F.lit(pad), F.col("fill_")), F.col(ids))).withColumn("mask", F.concat(F.array_repeat(F.lit(0), F.col("fill_")), F.array_repeat(F.lit(1), F.size(ids)))).drop("fill_")


def round_robin(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """Adds slot: rows of each group dealt out in turn, from the least ``order`` (a number) on."""
    turned = df.withColumn("falling_", -F.col(order))
    return ranked(turned, by, [F.desc_nulls_last("falling_")], "falling_").withColumn("slot", F.pmod(F.col("rank") - 1, F.lit(n))).drop("rank", "of", "falling_")


def cut_at(df: DataFrame, order: str, ids: str, place: int) -> DataFrame:
    """Adds at_, how many of a row's tokens lie before ``place``, and begins_, whether the row starts there.

    Only keys and sizes are put in order, to find the one row that holds the place; ``order`` is unique.
    """
    from ..sources.sinks import token_offsets

    sizes = df.select(F.col(order), F.size(ids).cast("bigint").alias("size_"))
    reached = token_offsets(sizes, order, "size_").where((F.col("offset") < place) & (F.col("size_") > 0))
    last = reached.agg(F.max_by(F.struct(F.col(order).alias("key"), "offset", "size_"), "offset").alias("r")).first()["r"]
    size = F.size(ids)
    if last is None:
        return df.withColumn("at_", F.lit(0)).withColumn("begins_", F.lit(place > 0))
    key, more = F.lit(last["key"]), last["offset"] + last["size_"] < place
    at = F.when(F.col(order) < key, size).when(F.col(order) == key, F.least(size, F.lit(place - last["offset"]))).otherwise(0)
    return df.withColumn("at_", at.cast("int")).withColumn("begins_", F.lit(more) | (F.col(order) <= key))


def with_prefix_of(df: DataFrame, other: DataFrame, order: str, ids: str, most: int) -> DataFrame:
    """All rows of ``df``, then the first ``most`` tokens of ``other``, whose last row is cut where they end: part, order, ids."""
    head = cut_at(other, order, ids, most).where("begins_").withColumn(ids, F.slice(ids, F.lit(1), F.col("at_")))
    return df.select(F.lit(0).alias("part"), order, ids).union(head.select(F.lit(1), order, ids))


def held_out(total: int, fraction: float, least: int) -> int:
    return max(least, int(total * fraction))


def split_tail(df: DataFrame, order: str, ids: str, total: int, fraction: float = 0.005, least: int = 1) -> DataFrame:
    """As ``split_at``, by an order: only the row across the border is looked for, and no text is moved."""
    return _halves(cut_at(df, order, ids, total - held_out(total, fraction, least)), ids, F.col("at_")).drop("at_", "begins_")


def _halves(df: DataFrame, ids: str, at: Column) -> DataFrame:
    parts = F.array(F.struct(F.lit("train").alias("split"), F.slice(ids, F.lit(1), at).alias("i")), F.struct(F.lit("val").alias("split"), F.slice(ids, at + 1, F.size(ids)).alias("i")))
    rows = df.withColumn("x_", F.explode(parts)).where(F.size("x_.i") > 0)
    return rows.withColumn("split", F.col("x_.split")).withColumn(ids, F.col("x_.i")).drop("x_")


def split_at(df: DataFrame, ids: str, offset: str, total: int, fraction: float = 0.005, least: int = 1) -> DataFrame:
    """Tokens before the last ``fraction`` as train, the rest as val: a row across the border gives one of each. Adds split."""
    border = F.lit(total - held_out(total, fraction, least)) - F.col(offset)
    return _halves(df, ids, F.greatest(F.least(border, F.size(ids)), F.lit(0)).cast("int"))


def anchored(times: Column, gap: int, most: int) -> Column:
    """Batch numbers of sorted times: a batch opens with its first arrival, and closes after ``gap`` or at ``most``."""

    def step(acc, t):
        new = acc["start"].isNull() | (t - acc["start"] > gap) | (acc["size"] >= most)
        return F.struct(F.when(new, t).otherwise(acc["start"]).alias("start"), F.when(new, 1).otherwise(acc["size"] + 1).alias("size"), (acc["batch"] + new.cast("int")).alias("batch"), F.concat(acc["out"], F.array(acc["batch"] + new.cast("int"))).alias("out"))

    start = F.struct(F.lit(None).cast("bigint").alias("start"), F.lit(0).alias("size"), F.lit(-1).alias("batch"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(times, start, step, lambda a: a["out"])


def anchored_batches(df: DataFrame, by: str, time: str, key: str, gap: int, most: int) -> DataFrame:
    """by, key and batch of each arrival, as ``anchored`` numbers them.

    After a pause longer than ``gap`` a batch opens in any case, so only what lies between two such pauses is folded as
    one row; the numbers before are added by a running sum.
    """
    w = Window.partitionBy(by).orderBy("t_", key)
    rows = df.select(by, key, F.col(time).alias("t_")).withColumn("new_", F.coalesce(F.col("t_") - F.lag("t_").over(w) > gap, F.lit(True)).cast("int"))
    rows = rows.withColumn("session_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    folded = rows.groupBy(by, "session_").agg(F.array_sort(F.collect_list(F.struct(F.col("t_"), F.col(key)))).alias("e_"))
    folded = folded.withColumn("b_", anchored(F.transform("e_", lambda x: x["t_"]), gap, most))
    before = F.sum(F.array_max("b_") + 1).over(Window.partitionBy(by).orderBy("session_").rowsBetween(Window.unboundedPreceding, -1))
    folded = folded.withColumn("before_", F.coalesce(before, F.lit(0)))
    return folded.select(by, "before_", F.inline(F.arrays_zip(F.col(f"e_.{key}").alias(key), F.col("b_").alias("b_")))).select(by, key, (F.col("b_") + F.col("before_")).cast("int").alias("batch"))
