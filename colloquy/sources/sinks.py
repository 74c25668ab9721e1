"""Sinks: JSON lines, split and routed outputs, token files, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import token_files


def write_texts(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_new(df: DataFrame, path: str) -> None:
    """Refuses to overwrite."""
    df.write.mode("errorifexists").parquet(path)


def write_split(df: DataFrame, path: str, column: str = "split") -> None:
    """One pass, one folder for each split."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def route_by_flaws(df: DataFrame, path: str) -> None:
    """Rows without flaws and rows with, in one pass."""
    write_split(df.withColumn("outcome", F.when(F.size("flaws") == 0, "pass").otherwise("fail")), path, "outcome")


def token_offsets(df: DataFrame, order: str, size: str, per_range: int = 1_000_000) -> DataFrame:
    """Adds offset, the tokens before a row, by prefix sums in two levels: ranges of the order, then rows of a range.

    Ranges lie between quantiles of ``order`` (a number), at most 1023 of them, so no task sorts all rows.
    """
    rows = df.count()
    n = min(1024, max(8, -(-rows // per_range)))
    cuts = df.agg(F.percentile_approx(order, F.array(*(F.lit(i / n) for i in range(1, n))), 10_000).alias("c")).first()["c"] or []
    ranged = df.withColumn("part_", F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c < F.col(order))) if cuts else F.lit(0))
    totals = ranged.groupBy("part_").agg(F.sum(size).alias("n_"))
    before = totals.withColumn("before_", F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each range
    inside = F.sum(size).over(Window.partitionBy("part_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("inside_", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "part_").withColumn("offset", F.col("inside_") + F.coalesce("before_", F.lit(0))).drop("part_", "n_", "before_", "inside_")


def tail_split(df: DataFrame, offset: str, size: str, total: int, fraction: float = 0.005) -> DataFrame:
    """Adds split: val for the last ``fraction`` of all tokens (one at least), train before."""
    held = max(1, int(total * fraction))
    return df.withColumn("split", F.when(F.col(offset) + F.col(size) > total - held, "val").otherwise("train"))


def token_dtype(vocabulary: int) -> str:
    return "uint16" if vocabulary <= 65536 else "uint32"


def round_entry(ranked: DataFrame, promoted: str) -> DataFrame:
    """A line for each branch, best first, with marks for the promoted one and for rounds that don't improve."""
    line = F.concat(F.lit("- "), F.col("tag"), F.lit(" "), F.format_number("score", 1), F.when(F.col("tag") == promoted, F.lit(" PROMOTED")).otherwise(""), F.when(F.col("score") <= 74, F.lit(" NON-IMPROVING")).otherwise(""))
    return ranked.select("rank", line.alias("line"))


def write_token_files(df: DataFrame, uri: str, order: str, ids: str, width: int = 2, parts: int = 8) -> DataFrame:
    """Little-endian token files of fixed width below ``uri``, one a range of ``order``, with one commit.

    Executors must share ``uri``. Returns file and n_tokens of each, in order.
    """
    token_files.write(df, uri, [order], ids, width, parts)
    found = [(f.path.rsplit("/", 1)[-1], f.tokens) for f in token_files.token_files(uri, width)]
    return df.sparkSession.createDataFrame(found, "file string, n_tokens long")


def named_output(folder: str, split: str, tag: str = "npc") -> str:
    """Where a split of a mixture goes; mixtures of several tags stand side by side."""
    return f"{folder.rstrip('/')}/{split}_{tag}"


def append_metrics(spark, path: str, run: str, rows: list[tuple[int, int, float, float]]) -> None:
    """Adds a run's evaluations (step, tokens, train, val) to a table of metrics."""
    df = spark.createDataFrame([(run, *r) for r in rows], "run string, step long, tokens long, train double, val double")
    df.coalesce(1).write.mode("append").parquet(path)
