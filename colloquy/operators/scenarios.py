"""Scenarios against rollouts: what an answer says and does, whether it is the oracle's, and rates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

KINDS = ["none", "GOTO", "DEAL", "BUY"]


def kind_of(oracle: Column) -> Column:
    """none, GOTO, BUY, or else DEAL."""
    return F.when(oracle.isNull(), "none").when(F.startswith(oracle, F.lit("[GOTO")), "GOTO").when(F.startswith(oracle, F.lit("[BUY")), "BUY").otherwise("DEAL")


def answers(rollouts: DataFrame, oracle: str = "oracle", text: str = "text", places: list[str] | None = None) -> DataFrame:
    """Adds what is graded of an answer, cut at the next player's line: said, kind, ok, formatted, beats, acts, action, quoted, near.

    ``formatted``: one action line at most, and it parses. ``action`` is the first action line, null if it doesn't parse.
    ``unknown``: it leads to none of ``places``. ``quoted`` and ``near`` are about prices of answers whose oracle deals.
    """
    strip = lambda t: F.btrim(t, F.lit(" \t\n\x0b\f\r"))
    out = rollouts.withColumn("said", strip(F.substring_index(text, "Player:", 1))).withColumn("lines_", T.action_lines(F.col("said")))
    acts = F.size("lines_.actions")
    out = out.withColumn("action", T.parse_action(F.try_element_at(F.col("lines_.actions"), F.lit(1)))).withColumn("wanted_", T.parse_action(F.col(oracle)))
    out = out.withColumn("kind", kind_of(F.col(oracle))).withColumn("ok", T.oracle_ok(F.col("wanted_"), F.col("action")))
    deal = F.startswith(F.col(oracle), F.lit("[DEAL:")) & F.col("wanted_").isNotNull()
    prices = F.when(deal, T.quoted_prices(F.col("said"))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("formatted", (acts <= 1) & ((acts == 0) | F.col("action").isNotNull())).withColumn("beats", F.col("said").rlike(r"\*[^*]+\*"))
    out = out.withColumn("acts", acts > 0).withColumn("dialog", F.length(strip(F.array_join("lines_.dialog", " ")))).withColumn("n_actions", acts)
    known = F.col("action.arg").isin(places) if places is not None else F.lit(True)
    out = out.withColumn("unknown", (F.col("action.verb") == "GOTO") & ~F.coalesce(known, F.lit(False)))
    return out.withColumn("quoted", F.size(prices) > 0).withColumn("near", F.exists(prices, lambda p: F.abs(p - F.col("wanted_.price")) <= 0.3 * F.col("wanted_.price"))).drop("lines_", "wanted_")


def with_items(graded: DataFrame, items: DataFrame, item: str = "item") -> DataFrame:
    """Adds invalid: an action that doesn't parse, leads nowhere known, or trades an unknown item."""
    dim = items.select(F.col(item).alias("item_"), F.lit(True).alias("known_")).distinct()
    traded = F.col("action.verb").isin("DEAL", "BUY")
    joined = graded.join(dim, F.when(traded, F.col("action.arg")) == F.col("item_"), "left")
    invalid = F.col("acts") & (F.col("action").isNull() | F.coalesce(F.col("unknown"), F.lit(False)) | (F.coalesce(traded, F.lit(False)) & F.col("known_").isNull()))
    return joined.withColumn("invalid", invalid).drop("item_", "known_")


def report(graded: DataFrame) -> DataFrame:
    """One row of counts: answers, formatted, beats, acts, invalid, oracle's, with quoted prices, near the oracle's."""
    flags = {"formatted": "formatted", "beats": "beats", "acts": "acts", "invalid": "invalid", "hits": "ok", "quoted": "quoted", "near": "near"}
    return graded.agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in flags.items()))


def report_by_kind(graded: DataFrame, hit: Column | None = None) -> DataFrame:
    """Hits and totals of the kinds that occur."""
    return graded.groupBy("kind").agg(F.count_if(F.col("ok") if hit is None else hit).alias("hits"), F.count("*").alias("total"))


def accepted(least: int = 16) -> Column:
    """Answers fit to learn from: one action at most, the oracle's, and some words besides."""
    return (F.col("n_actions") <= 1) & (F.col("dialog") >= least) & F.col("ok")


def accepted_text(prompt: str = "prompt") -> Column:
    return F.concat(F.col(prompt), F.lit(" "), F.col("said"), F.lit("\nPlayer:\n"))


def probe_rates(probes: DataFrame, text: str, card: str, intent: Column, stopped: Column) -> DataFrame:
    """Shares of answers that drift to other names, meet their intent (or have none), and stop by themselves."""
    drift = F.size(T.drift_names(F.col(text), F.col(card))) > 0
    share = lambda c, name: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6).alias(name)
    return probes.agg(F.count("*").alias("n"), share(drift, "drift"), share(F.coalesce(intent, F.lit(True)), "intent"), share(stopped, "clean"))


def samples(graded: DataFrame, order: list[str], n: int = 6) -> DataFrame:
    """The first answers, shortened for a report."""
    return graded.orderBy(*order).limit(n).withColumn("said", F.substring(F.replace("said", F.lit("\n"), F.lit(" / ")), 1, 110))


def holders(items: DataFrame, wanted: DataFrame, item: str = "item", trade: str = "trade") -> DataFrame:
    """Each wanted item with the trades that list it."""
    return items.select(item, trade).distinct().join(wanted.select(item).distinct(), item, "left_semi")


def rumour(latest: Column, key: Column, rumours: list[str], seed: int = 31) -> Column:
    """The latest event in seven of ten cases if there is one, else a rumour."""
    from ..functions import keyed

    return F.when(latest.isNotNull() & (keyed.uniform(key, seed) < 0.7), latest).otherwise(F.element_at(T.strings(rumours), (keyed.choice(key, seed, len(rumours)) + 1).cast("int")))
