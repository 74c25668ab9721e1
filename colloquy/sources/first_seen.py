"""Appends that don't repeat what is there: a table in which each key occurs once, over all runs.

Rows lie in folders by the first bits of their key's digest, with the digest beside them. An append keeps the first row
of each key of its own input, then reads the digests of the folders that its keys fall into, and of those only, and
leaves out what is there. It is one write, committed as a whole, so a run that fails adds nothing and can be repeated.
One run at a time may append to a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mixture import first_of
from .readers import exists

DIGEST, FOLDER = "key_digest", "key_folder"


def _keyed(df: DataFrame, key: Column, folders: int) -> DataFrame:
    digest = F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256)
    return df.withColumn(DIGEST, digest).withColumn(FOLDER, F.pmod(F.conv(F.substring(DIGEST, 1, 8), 16, 10).cast("bigint"), F.lit(folders)).cast("int"))


def fresh(df: DataFrame, path: str, key: Column, order: str, folders: int = 256) -> DataFrame:
    """The rows that an append would add: the first of each key, by ``order``, of those that the table lacks.

    A null key counts as the empty one. ``folders`` must be the same for all runs of a table.
    """
    spark = df.sparkSession
    keyed = _keyed(df, key, folders)
    rows = first_of(keyed, [FOLDER, DIGEST], order)
    if not exists(spark, path):
        return rows
    touched = [r[0] for r in keyed.select(FOLDER).distinct().collect()]  # at most ``folders`` numbers
    there = read(spark, path).where(F.col(FOLDER).isin(touched)).select(DIGEST, FOLDER)
    return rows.join(there, [FOLDER, DIGEST], "left_anti").select(*rows.columns)


def append(df: DataFrame, path: str, key: Column, order: str, folders: int = 256) -> None:
    """Adds what is fresh, a folder's rows by one task, so an append makes a file a folder and not one a task and folder."""
    fresh(df, path, key, order, folders).repartition(FOLDER).write.mode("append").partitionBy(FOLDER).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
