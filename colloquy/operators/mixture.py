"""Mixtures: cleaning by source, caps, ordered unions, splits and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import keyed, values
from ..functions import text as T


def clean(df: DataFrame, text: str = "text", strip: bool = True) -> DataFrame:
    """Rows without toxic phrases, their beats stripped."""
    out = df.where(~T.is_toxic(F.col(text)))
    return out.withColumn(text, T.strip_beats(F.col(text))) if strip else out


def cap(df: DataFrame, by: str | list[str] | None, order: str | list, most: int | Column) -> DataFrame:
    """The first rows of each group. The limit reaches the partitions before any shuffle."""
    keys, order = ([by] if isinstance(by, str) else by or []), (order if isinstance(order, list) else [order])
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order)
    if not keys and isinstance(most, int):
        return df.orderBy(*order).limit(most)
    return df.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= most).drop("n_")


def in_turn(df: DataFrame, order: Column, most: int, ties: list) -> DataFrame:
    """The first ``most`` rows by a hex digest of a unique key, with their place from 0.

    Digests are counted by their first three digits, and only rows of parts that begin before ``most`` are sorted, each
    part by itself. Rows of equal digests follow ``ties``.
    """
    rows = df.withColumn("order_", order).withColumn("part_", F.substring("order_", 1, 3))
    before = F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part, 4096 at most
    parts = rows.groupBy("part_").agg(F.count("*").alias("n_")).select("part_", F.coalesce(before, F.lit(0)).alias("before_")).where(F.col("before_") < most)
    place = F.row_number().over(Window.partitionBy("part_").orderBy("order_", *ties)) - 1
    return rows.join(F.broadcast(parts), "part_").withColumn("place", F.col("before_") + place).where(F.col("place") < most).drop("part_", "before_", "order_")


def mix(parts: dict[str, DataFrame], order: list[str] = values.SOURCE_ORDER, only: list[str] | None = None) -> DataFrame:
    """All parts, with source and source_rank. Nothing is deduplicated across parts."""
    chosen = [n for n in [*order, *(p for p in parts if p not in order)] if n in parts and (only is None or n in only)]
    return reduce(DataFrame.unionByName, [parts[n].withColumn("source", F.lit(n)).withColumn("source_rank", F.lit(i)) for i, n in enumerate(chosen)])


def totals(mixed: DataFrame, by: str = "source") -> DataFrame:
    """Rows and characters by source, and of all."""
    return mixed.rollup(by).agg(F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars")).select(F.coalesce(by, F.lit("(all)")).alias(by), "n_rows", "n_chars")


def holdout(df: DataFrame, key: Column, seed: int, fraction: float) -> DataFrame:
    """Adds split by keyed chance: rows of one key stay on one side."""
    return df.withColumn("split", F.when(keyed.uniform(key, seed) < fraction, "holdout").otherwise("train"))


def convert(df: DataFrame, render: Column, key: Column, seed: int, fraction: float, most: int, most_held: int) -> DataFrame:
    """Renders rows, rejects null and empty ones, splits by chance, shuffles and caps each split."""
    kept = holdout(df.withColumn("text", render).where("text IS NOT NULL AND text <> ''"), key, seed, fraction)
    order, ties = keyed.digest(key, f"{seed}-order"), [key]
    parts = [in_turn(kept.where(F.col("split") == split), order, n, ties) for split, n in (("train", most), ("holdout", most_held))]
    return parts[0].unionByName(parts[1]).drop("place")


def reservoir(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """A uniform sample of n rows: those of the smallest digests."""
    return df.orderBy(keyed.digest(F.col(key), seed)).limit(n)


def sample_by(df: DataFrame, by: str, key: str, seed: int, k: int) -> DataFrame:
    """k rows of each group without replacement."""
    return cap(df.withColumn("d_", keyed.digest(F.col(key), seed)), by, "d_", k).drop("d_")


def first_of(df: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return cap(df, [key] if isinstance(key, str) else key, order, 1)
