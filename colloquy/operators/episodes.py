"""Episodes: replays up to their end, selection by return, logs of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def until_done(steps: DataFrame, key: str, order: str, done: Column) -> DataFrame:
    """Steps up to and including the first that is done."""
    before = F.sum(done.cast("int")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return steps.withColumn("before_", F.coalesce(before, F.lit(0))).where("before_ = 0").drop("before_")


def ranked(df: DataFrame, group: str, by: list[Column], value: str, buckets: int = 64, most: int = 1000) -> DataFrame:
    """Adds rank, the place of a row in its group, and of, the group's rows, in two levels: ranges of ``value``, then rows of a range.

    ``by`` starts with ``value``, falling, nulls last. So a group of any size is sorted by many tasks; only the ranges'
    counts, ``buckets`` a group, meet in one. Rows of one value share a range. ``most`` bounds the groups whose cuts and
    counts are broadcast; beyond, they are joined by their group.
    """
    cuts = df.groupBy(F.col(group).alias("g_")).agg(F.percentile_approx(value, F.array(*(F.lit(i / buckets) for i in range(1, buckets))), 2000).alias("cuts_"))
    small = F.broadcast if df.select(F.approx_count_distinct(group)).first()[0] <= most else (lambda x: x)
    part = F.when(F.col(value).isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.coalesce("cuts_", F.array().cast("array<double>")), lambda c: c < F.col(value))))
    rows = df.join(small(cuts), F.col(group).eqNullSafe(F.col("g_"))).withColumn("part_", part).drop("cuts_", "g_")
    n = rows.groupBy(F.col(group).alias("g_"), F.col("part_").alias("p_")).agg(F.count("*").alias("n_"))
    before = n.withColumn("before_", F.coalesce(F.sum("n_").over(Window.partitionBy("g_").orderBy(F.desc("p_")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("of", F.sum("n_").over(Window.partitionBy("g_"))).drop("n_")
    inside = rows.withColumn("inside_", F.row_number().over(Window.partitionBy(group, "part_").orderBy(*by)))
    return inside.join(small(before), F.col(group).eqNullSafe(F.col("g_")) & (F.col("part_") == F.col("p_"))).withColumn("rank", F.col("inside_") + F.col("before_")).drop("inside_", "before_", "part_", "g_", "p_")


def top_fraction(episodes: DataFrame, task: str, score: str, order: str, fraction: float = 0.25, floor: float | None = None) -> DataFrame:
    """The best episodes of each task: at least one, and a share rounded half to even."""
    out = ranked(episodes, task, [F.desc_nulls_last(score), F.asc(order)], score)
    out = out.where(F.col("rank") <= F.greatest(F.lit(1), F.bround(F.col("of") * fraction, 0)))
    return (out if floor is None else out.where(F.col(score) > floor)).drop("of")


def recent(events: DataFrame, key: str, order: str, value: str, n: int = 6) -> DataFrame:
    """Adds recent: the last ``n`` values, this one included."""
    return events.withColumn("recent", F.collect_list(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(-n + 1, 0)))


def latest_matching(events: DataFrame, key: str, order: str, value: Column, test: Column) -> DataFrame:
    """For each key the newest value that passes ``test``."""
    return events.where(test).groupBy(key).agg(F.max_by(value, order).alias("latest"))
