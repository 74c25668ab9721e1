"""Keyed randomness: the same row gets the same number on any cluster, in any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(key: Column, seed: int | str) -> Column:
    """A hex digest to order by: a shuffle that doesn't depend on partitions."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def uniform(key: Column, seed: int | str) -> Column:
    """A number in [0, 1)."""
    return F.conv(F.substring(digest(key, seed), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def choice(key: Column, seed: int | str, n: Column | int) -> Column:
    """An index from 0 to n - 1."""
    return F.pmod(F.conv(F.substring(digest(key, seed), 9, 8), 16, 10).cast("bigint"), F.lit(n) if isinstance(n, int) else n)


def sql_digest(key: str, seed: int | str) -> str:
    """The same in DuckDB."""
    return f"md5(({key})::VARCHAR || '|{seed}')"


def sql_uniform(key: str, seed: int | str) -> str:
    return f"(('0x' || substr({sql_digest(key, seed)}, 1, 8))::BIGINT / 4294967296.0)"


def sql_choice(key: str, seed: int | str, n: int | str) -> str:
    return f"(('0x' || substr({sql_digest(key, seed)}, 9, 8))::BIGINT % ({n}))"
