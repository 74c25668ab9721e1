"""The order of a scan as a key: file, start of the block that a task reads, place in it. Nothing is shuffled for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILE, START, PLACE = "scan_file", "scan_start", "scan_place"


def as_read(scan: DataFrame) -> DataFrame:
    """A scan of files with the key of its order. However files are split, rows by (file, start, place) follow the files.

    To be applied to the scan itself: what comes after, filters included, may come in any order.
    """
    return scan.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(START), F.monotonically_increasing_id().alias(PLACE))


def first_rows(rows: DataFrame, most: int | Column, by: list[str] | None = None) -> DataFrame:
    """The first ``most`` rows of each group in the order of ``as_read``, without sorting more than their blocks.

    Rows are counted by block first; a running sum over blocks (a row each) tells which hold them, and only those are
    numbered. The key stays, for a later sort.
    """
    by = by or []
    counts = rows.groupBy(*by, FILE, START).agg(F.count("*").alias("n_"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(FILE, START).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before_", F.coalesce(F.sum("n_").over(w), F.lit(0))).drop("n_")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, FILE, START)]
    held = rows.alias("r").join(before.alias("b"), same).select("r.*", "b.before_")
    limit = F.lit(most) if isinstance(most, int) else most
    some = held.where(F.col("before_") < limit)
    rank = F.row_number().over(Window.partitionBy(*by, FILE, START).orderBy(PLACE))
    return some.withColumn("rank_", F.col("before_") + rank).where(F.col("rank_") <= limit).drop("before_", "rank_")
