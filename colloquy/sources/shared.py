"""The folder that the driver and all executors share, for tables and files that are written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own if that is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or LOCAL).rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
