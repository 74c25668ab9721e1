"""Experiments: summaries by arm, differences, ranks, losses, schedules and budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .episodes import ranked


def by_arm(runs: DataFrame, arm: str, loss: str) -> DataFrame:
    """Mean, half spread and perplexity of each arm."""
    return runs.groupBy(F.col(arm).alias("arm")).agg(F.count("*").alias("n"), F.avg(loss).alias("mean"), F.when(F.count("*") > 1, (F.max(loss) - F.min(loss)) / 2).alias("half_spread"), F.exp(F.avg(loss)).alias("ppl"))


def deltas(arms: DataFrame, pairs: DataFrame) -> DataFrame:
    """The difference of the means of arms a and b, with a verdict."""
    a, b = arms.select(F.col("arm").alias("a"), F.col("mean").alias("ma")), arms.select(F.col("arm").alias("b"), F.col("mean").alias("mb"))
    d = F.col("ma") - F.col("mb")
    return pairs.join(F.broadcast(a), "a").join(F.broadcast(b), "b").select("a", "b", F.round(d, 6).alias("delta"), F.when(d > 0.01, "YES").when(d < -0.01, "no").otherwise("tie").alias("verdict"))


def gap_recovered(base: Column, ours: Column, big: Column) -> Column:
    return F.when(base - big > 0, 100 * (base - ours) / (base - big))


def rank_and_promote(branches: DataFrame) -> DataFrame:
    """Rank by score, then by the second score; null scores don't take part."""
    rows = branches.where("score IS NOT NULL").withColumn("all_", F.lit(0))
    return ranked(rows, "all_", [F.desc("score"), F.coalesce("second", F.lit(0.0)).desc(), F.asc("tag")], "score").drop("all_", "of")


def best_so_far(df: DataFrame, run: str, step: str, loss: str) -> DataFrame:
    """Adds best, the least loss before, and whether a row improves on it."""
    before = F.min(loss).over(Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("best", before).withColumn("improved", F.coalesce(F.col(loss) < before, F.lit(True)))


def weighted_ppl(df: DataFrame, group: str, logprob: str, tokens: str) -> DataFrame:
    return df.groupBy(group).agg(F.sum(tokens).alias("n_tokens"), F.exp(-F.sum(logprob) / F.greatest(F.sum(tokens), F.lit(1))).alias("ppl")).where("n_tokens > 0")


def pairwise_divergence(df: DataFrame, branch: str, probe: str, text: str) -> DataFrame:
    """For two branches, the share of probes with different texts. Branches are few; probes join on their key."""
    a = df.select(F.col(branch).alias("a"), F.col(probe).alias("p"), F.col(text).alias("ta"))
    b = df.select(F.col(branch).alias("b"), F.col(probe).alias("p"), F.col(text).alias("tb"))
    return a.join(b, "p").where("a < b").groupBy("a", "b").agg(F.round(F.avg((F.col("ta") != F.col("tb")).cast("double")), 6).alias("divergence"), F.count("*").alias("n"))


def learning_rate(step: Column, total: int, peak: float, warmup: int, stable: float = 0.6) -> Column:
    """Warm-up, a flat part, and a cosine down to a tenth."""
    flat = warmup + int(stable * (total - warmup))
    done = (step - flat) / F.lit(float(max(1, total - flat)))
    return F.when(step < warmup, peak * (step + 1) / warmup).when(step < flat, F.lit(peak)).otherwise(peak * (0.1 + 0.45 * (1 + F.cos(F.lit(math.pi) * done))))


def parameter_tiers(vocab: Column, d: Column, layers: Column, table: Column, ffn: Column) -> Column:
    """Parameters that every token computes with, streams, and looks up."""
    each = 4 * d * d + 3 * d * ffn + 2 * d * table
    return F.struct((layers * each + d * layers * table).alias("core"), (vocab * d).alias("stream"), (vocab * layers * table).alias("table"))


def widest_ffn(target: Column, d: Column, layers: Column, table: Column) -> Column:
    """The widest hidden layer whose core stays within ``target``, in closed form."""
    return F.floor((target - d * layers * table - layers * (4 * d * d + 2 * d * table)) / (layers * 3 * d)).cast("bigint")


def scaled_rate(batch: Column, base: float = 1e-3, at: int = 32) -> Column:
    """A learning rate in proportion to the batch."""
    return F.lit(base) * (batch / F.lit(float(at)))


# Fixed values. Bytes of fast memory and of flash, and bytes a second that flash gives.
SRAM, FLASH, FLASH_RATE = 320 * 1024, 15 * 1024 * 1024, 60e6


def bandwidth(vocab: Column, d: Column, layers: Column, table: Column, ffn: Column, bits: int = 4) -> Column:
    """Bytes of each tier, which of them fit, milliseconds a token for the head and the rows looked up, and the ceiling of tokens a second."""
    t, b = parameter_tiers(vocab, d, layers, table, ffn), bits / 8
    head, rows = t["stream"] * b / FLASH_RATE, layers * table * b / FLASH_RATE
    return F.struct(
        (t["core"] * b).alias("core_bytes"), (t["stream"] * b).alias("stream_bytes"), (t["table"] * b).alias("table_bytes"), (t["core"] * b <= SRAM).alias("core_fits"),
        (t["table"] * b <= FLASH).alias("table_fits"), (head * 1000).alias("head_ms"), (rows * 1000).alias("table_ms"), (F.lit(1.0) / (head + rows)).alias("ceiling"),
    )


def arm_report(runs: DataFrame, arm: str, loss: str, order: list[str]) -> DataFrame:
    """Arms in the given order; those without runs are left out."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col(arm))
    return by_arm(runs.where(place > 0), arm, loss).withColumn("place", F.array_position(F.array(*(F.lit(x) for x in order)), F.col("arm"))).orderBy("place")


def quantization_report(losses: DataFrame, base: str, ours: str) -> DataFrame:
    """Each arm's loss before and after quantization with the share of the edge over ``base`` that ``ours`` keeps.

    ``losses`` has a row for each arm: arm, fp, q.
    """
    of = lambda a, c: F.max(F.when(F.col("arm") == a, F.col(c)))
    gap = losses.agg((of(base, "fp") - of(ours, "fp")).alias("fp_gap"), (of(base, "q") - of(ours, "q")).alias("q_gap"))
    retained = F.when(F.col("fp_gap") != 0, 100 * F.col("q_gap") / F.col("fp_gap"))
    return losses.join(F.broadcast(gap)).select("arm", "fp", "q", (F.col("q") - F.col("fp")).alias("degraded"), F.when(F.col("arm") == ours, retained).alias("edge_retained"))


def mean_loss(evaluations: DataFrame, run: str, loss: str) -> DataFrame:
    return evaluations.groupBy(run).agg(F.avg(loss).alias("loss"), F.count(loss).alias("n"))


def divergence_report(pairs: DataFrame, least: float = 0.05) -> DataFrame:
    """Pairs from the closest on, with the mean over all and whether branches have collapsed. A row for each two branches."""
    mean = pairs.agg(F.avg("divergence").alias("mean"))
    return pairs.join(F.broadcast(mean)).withColumn("collapsed", F.col("mean") < least).orderBy("divergence", "a", "b")


def depth_report(df: DataFrame, depth: str) -> DataFrame:
    """How often each depth occurs, from none on, and the mean."""
    by = df.groupBy(F.col(depth).alias("depth")).agg(F.count("*").alias("n"))
    mean = by.agg((F.sum(F.col("depth") * F.col("n")) / F.sum("n")).alias("mean"))
    return by.join(F.broadcast(mean)).orderBy("depth")


def holdout_scores(df: DataFrame, file: str, tokens: str, logprob: str, least: int = 8) -> DataFrame:
    """Perplexity of each file: texts of fewer than ``least`` tokens count as rows but aren't scored; n tokens give n - 1 predictions."""
    long = F.col(tokens) >= least
    n = F.coalesce(F.sum(F.when(long, F.col(tokens) - 1)), F.lit(0))
    lp = F.coalesce(F.sum(F.when(long, F.col(logprob))), F.lit(0.0))
    return df.groupBy(F.col(file).alias("file")).agg(F.count("*").alias("n_rows"), n.alias("n_tokens"), F.exp(-lp / F.greatest(n, F.lit(1))).alias("ppl")).where("n_tokens > 0")
