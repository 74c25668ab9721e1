"""Plans of several stages: a corpus build, and rounds that rank and promote."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..operators import experiments, mixture


def build_mixture(parts: dict[str, DataFrame], order_column: str, caps: dict[str, int] | None = None, only: list[str] | None = None) -> DataFrame:
    """Cleans each part by its source's rules, caps it after cleaning, and appends all in the fixed order."""
    caps = values.CAPS if caps is None else caps
    ready = {}
    for name, df in parts.items():
        kept = mixture.clean(df, strip=name not in values.KEEP_BEATS)
        ready[name] = mixture.cap(kept, None, order_column, caps[name]) if name in caps else kept
    return mixture.mix(ready, only=only)


def run_round(stages: list[tuple[str, Callable[[], object], bool]]) -> list[tuple[str, str]]:
    """Runs stages in order; a failed stage that is needed ends the round, another is noted."""
    log = []
    for name, stage, needed in stages:
        try:
            stage()
            log.append((name, "done"))
        except Exception as error:  # noqa: BLE001
            log.append((name, f"failed: {error}"))
            if needed:
                break
    return log


def promote(branches: DataFrame, key: str = "tag", seed: int = 1, best: int = 3) -> DataFrame:
    """One of the ``best`` branches, by keyed choice."""
    from ..functions.keyed import digest

    return experiments.rank_and_promote(branches).where(F.col("rank") <= best).orderBy(digest(F.col(key), seed)).limit(1)


def grid(spark: SparkSession, parameters: dict[str, list], wave: int) -> DataFrame:
    """All combinations of short lists of parameters, in order, in waves of ``wave`` runs. Made on the driver: it launches them."""
    rows = sorted(product(*parameters.values()))
    return spark.createDataFrame([(*r, i // wave) for i, r in enumerate(rows)], [*parameters, "wave"])


def run_waves(runs: list[Callable[[], object]], wave: int = 8) -> list[str]:
    """Starts runs side by side, ``wave`` at a time, and gives the outcome of each in order."""
    def attempt(run: Callable[[], object]) -> str:
        try:
            run()
        except Exception as error:  # noqa: BLE001
            return f"failed: {error}"
        return "done"

    with ThreadPoolExecutor(wave) as pool:
        return [outcome for at in range(0, len(runs), wave) for outcome in list(pool.map(attempt, runs[at : at + wave]))]
