"""Grading of answers: flaws, rewards, and what they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import values
from .dialogue import action_reward


def _body(answer: Column) -> Column:
    return T.strip(answer)


def _strangers(body: Column, card: Column) -> tuple[Column, Column]:
    """Whether a speaker claims a name that the card lacks, by either turn of phrase."""
    claims = F.regexp_extract_all(body, F.lit(values.CLAIM), 1)
    named = F.regexp_extract_all(body, F.lit(values.NAMED), 1)
    return tuple(F.exists(x, lambda c: ~F.contains(card, c)) for x in (claims, named))


def flaws(answer: Column, card: Column, name: Column, kind: str) -> Column:
    """The flaws of an answer to a kind of question, in a fixed order."""
    body = _body(answer)
    claims, named = _strangers(body, card)
    beat = body.rlike(values.BEAT)
    grounded = F.arrays_overlap(T.content_words(card), T.content_words(body))
    checks = [
        (F.startswith(T.strip_left(answer), F.lit("Player:")) | F.startswith(T.strip_left(answer), F.lit("###")), "prefix_leak"),
        (claims, "persona_swap"),
        (named, "persona_swap"),
        (F.contains(body, F.lit("Description:")) | F.contains(body, F.lit("<START>")), "card_continuation"),
        (T.is_toxic(body), "template_echo"),
        (beat, "action_text"),
        (~beat & F.lit(kind == "identity") & ~F.contains(body, F.element_at(T.words(name), 1)), "identity_missed"),
        (~T.has_intent(kind, body), "intent_missed"),
        (F.contains(answer, F.lit("### Player")) | F.contains(answer, F.lit("### System")), "marker_leak"),
        (F.length(body) < 16, "too_short"),
        ((F.size(T.words(body)) > 8) & T.repeats_ngram(body), "repetition"),
        (F.lit(kind == "object") & ~grounded, "object_ungrounded"),
    ]
    return F.array_compact(F.array(*(F.when(test, F.lit(flaw)) for test, flaw in checks)))


def flaw_histogram(graded: DataFrame) -> DataFrame:
    """Each flaw's count, and its rate over all answers."""
    n = graded.agg(F.count("*").alias("n"))
    return graded.select(F.explode("flaws").alias("flaw")).groupBy("flaw").agg(F.count("*").alias("n_flaws")).join(F.broadcast(n)).select("flaw", "n_flaws", F.round(F.col("n_flaws") / F.col("n"), 6).alias("rate"))


def flaw_ranking(graded: DataFrame, order: list[str]) -> DataFrame:
    """Each flaw's count and rank: the most frequent first, of equals the one that is seen first in ``order``."""
    seen = graded.select(*order, F.posexplode("flaws").alias("at_", "flaw"))
    counts = seen.groupBy("flaw").agg(F.count("*").alias("n_flaws"), F.min(F.struct(*order, "at_")).alias("first_"))
    # A row for each kind of flaw.
    return counts.select("flaw", "n_flaws", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n_flaws"), "first_")).alias("rank"))


def pass_rate(graded: DataFrame) -> DataFrame:
    return graded.agg(F.count("*").alias("n"), F.count_if(F.size("flaws") == 0).alias("n_pass"), F.round(F.count_if(F.size("flaws") == 0) / F.greatest(F.count("*"), F.lit(1)), 6).alias("pass_rate"))


def reward(answer: Column, question: Column, card: Column, stopped: Column, oracle: Column | None = None, mode: str = "off") -> Column:
    """Adherence in one number; some flaws end the count at once.

    ``stopped``: whether the answer ended by itself. ``oracle``: the action line that is right, or null; with it, modes
    "v2" and "gate" hold the answer's first action line against it.
    """
    body = _body(answer)
    part = lambda test, yes, no=0.0: F.when(test, F.lit(yes)).otherwise(F.lit(no))
    claims, named = _strangers(body, card)
    kind = F.create_map(*(F.lit(x) for pair in values.QUESTIONS.items() for x in pair))[question]
    intent = kind.isNull()
    for k in sorted(set(values.QUESTIONS.values())):
        intent |= (kind == k) & T.has_intent(k, body)
    own = F.array_except(F.regexp_extract_all(F.lower(card), F.lit("([a-z]{5,})"), 1), T.strings([*values.STOP_WORDS, "player", "start"]))
    shared = F.arrays_overlap(own, F.regexp_extract_all(F.lower(body), F.lit("([a-z]{5,})"), 1))
    total = F.lit(1.0) + part(body.rlike(values.BEAT), -0.5) + part(intent, 1.0, -0.5) + part(shared, 1.0)
    last = F.element_at(T.words(F.element_at(F.split(card, "\n"), -1)), 1)
    total += F.when((question == "Tell me about yourself.") & F.contains(card, F.lit("\n")), part(F.contains(body, last), 0.5, -0.5)).otherwise(0.0)
    total += part((question == "Is that thing on your table for sale?") & ~shared, -0.5)
    total += part(stopped | F.contains(answer, F.lit("\nPlayer:")), 0.5, -0.5)
    acts = T.action_lines(body)["actions"]
    present, act = F.size(acts) > 0, T.parse_action(F.get(acts, F.lit(0)))
    asked = F.lit(None).cast("string") if oracle is None else oracle
    total += action_reward(act, present, T.parse_action(asked), card, values.PLACES, mode, asked.isNotNull())
    total += part(F.length(body) >= 24, 0.5) + part(T.repeats_ngram(body), -1.0)
    total = F.when(asked.isNotNull() & ~present & F.lit(mode == "gate"), -1.0).otherwise(total)
    return F.when(claims | named, -1.0).when(F.contains(body, F.lit("Description:")) | F.contains(body, F.lit("<START>")), -0.5).when(T.is_toxic(body), -0.5).otherwise(total)


def advantage(df: DataFrame, group: str, score: str) -> DataFrame:
    """(score - mean) / (sample deviation + 1e-4) in groups whose scores differ."""
    w = Window.partitionBy(group)
    off = F.col(score) - F.avg(score).over(w)
    out = df.withColumn("advantage", off / (F.stddev_samp(score).over(w) + 1e-4)).withColumn("far_", F.max(F.abs(off)).over(w))
    return out.where("far_ >= 1e-6").drop("far_")


def repeat_penalty(df: DataFrame, text: str, order: str, chars: int = 120) -> DataFrame:
    """Adds penalty: -0.5 for each row whose collapsed head occurred before."""
    key = T.collapsed_head(F.col(text), chars)
    return df.withColumn("penalty", F.when(F.row_number().over(Window.partitionBy(key).orderBy(order)) > 1, -0.5).otherwise(0.0))


def learning_zone(df: DataFrame, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """Prompts neither too easy nor too hard, and fresh ones; all, if none is."""
    rate = F.col("passes") / F.col("attempts")
    marked = df.withColumn("zone", F.when(F.col("attempts") < 2, "fresh").when(rate.between(low, high), "in_zone"))
    some = marked.agg(F.count("zone").alias("some_"))
    return marked.join(F.broadcast(some)).where("zone IS NOT NULL OR some_ = 0").select(*df.columns, F.coalesce("zone", F.lit("all")).alias("zone"))


def low(df: DataFrame, reward: str, least: float = 1.5) -> DataFrame:
    """Rows for the sink of failures."""
    return df.where(F.col(reward) < least)
