"""Pass statistics that move: attempts and passes by prompt, kept by a stream, read as of any checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def keep(results: DataFrame, path: str, checkpoint: str, prompt: str = "prompt", score: str = "score", least: float = 3.0, forever: bool = False) -> StreamingQuery:
    """Keeps attempts and passes (a score of ``least`` or more) of each prompt from a stream of results.

    State is two numbers a prompt. Each trigger writes the prompts it changed as a version of its own; a trigger that
    runs again replaces its version, so nothing counts twice. A null score is an attempt without a pass.
    """
    passed = F.coalesce((F.col(score) >= least).cast("long"), F.lit(0))
    stats = results.groupBy(F.col(prompt).alias("prompt")).agg(F.count("*").alias("attempts"), F.sum(passed).alias("passes"))

    def write(changed: DataFrame, version: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/version={version}")

    writer = stats.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer if forever else writer.trigger(availableNow=True)).start()


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """prompt, attempts and passes as of a version, or of the last: each prompt's last change up to there."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/version=*")
    rows = rows if version is None else rows.where(F.col("version") <= version)
    last = rows.groupBy("prompt").agg(F.max_by(F.struct("attempts", "passes"), "version").alias("s"))
    return last.select("prompt", "s.attempts", "s.passes")


def compact(spark: SparkSession, path: str, to: str, version: int | None = None) -> None:
    """Writes a snapshot as version -1 of a new folder, which later versions go on from."""
    snapshot(spark, path, version).write.mode("overwrite").parquet(f"{to}/version=-1")
