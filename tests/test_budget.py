"""Prompts within a budget: equal to those made of whole histories, in blocks of any size, and linear in an episode."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from colloquy import studies
from colloquy.operators import budget, demos

FOLDER = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@pytest.mark.parametrize("length, block", [(64, None), (256, None), (40, 50), (40, 43)])
def test_equal_to_whole_histories(spark, length, block):
    steps = studies._steps(spark, FOLDER)
    whole = demos.fit_rows(studies._demos(spark, FOLDER).withColumn("id", F.concat_ws("|", "conv_id", "turn")), TOKENIZER, length)
    rows = budget.gathered(steps, TOKENIZER, length, "conv_id", "turn", F.lit("Play well."), block=block)
    got = budget.fitted(rows, TOKENIZER, length)
    assert sorted((f"{r.key}|{r.step}", r.text, r.kept) for r in got.collect()) == sorted((r.id, r.text, r.kept) for r in whole.collect())


def episodes(spark, n, name="a"):
    """Steps with texts of many lengths, line ends and blanks among them."""
    draw = np.random.default_rng(4)
    texts = ["", "look ", "a\n", "\n\n", "x" * 40, "the long way round the hill " * 6, "é 日本"]
    rows = [(name, k, str(draw.choice(texts)), str(draw.choice(texts[:5])), str(draw.choice(["go", "wait here", ""])), False) for k in range(n)]
    return spark.createDataFrame(rows, "e string, s long, long string, short string, action string, done boolean")


def test_blocks_and_ends(spark, library):
    """Blocks that the budget reaches across; an end, ends before the first action, nulls, and an episode of one step."""
    rows = [(e, k, f"obs {k} " * (k % 5), None, f"act {k}", k == end if end is not None else None) for e, n, end in (("x", 200, 150), ("y", 90, 0), ("z", 1, None), (None, 3, None)) for k in range(n)]
    steps = spark.createDataFrame(rows, "e string, s long, long string, short string, action string, done boolean").unionByName(episodes(spark, 300))
    plain = demos.replayed(steps.where("e IS NOT NULL").fillna(False, ["done"]).fillna("", ["short"]), "e", "s")
    from colloquy.operators import conversations as C

    want = {(r.e, r.s): (r.prompt, r.action) for r in plain.select("e", "s", "action", C.flatten(demos.messages(F.lit("Do."), F.col("past"), F.col("long"), F.col("short"))).alias("prompt")).collect()}
    fit = demos.fitter(TOKENIZER, 50)
    for block in (53, 60, 4096):
        rows = budget.gathered(steps, TOKENIZER, 50, "e", "s", F.lit("Do."), block=block)
        got = {(r.key, r.step): r.text for r in budget.fitted(rows, TOKENIZER, 50).collect()}
        assert got == {k: fit(p, a) for k, (p, a) in want.items()}
        kept = {(r.key, r.step): r.ids for r in budget.with_instruction(rows, TOKENIZER, 50).collect()}
        head = library.encode("user: Do.", add_special_tokens=False).ids
        for k, (p, _) in want.items():
            tail = library.encode(p.removeprefix("user: Do.\n"), add_special_tokens=False).ids
            assert kept[k] == head + tail[-(50 - len(head)) :]


def test_long_episode_is_linear(spark):
    """100,000 steps: no step holds more turns than its budget, and many tasks share the episode."""
    steps = spark.range(100_000).select(F.lit("one").alias("e"), F.col("id").alias("s"), F.concat(F.lit("you see thing "), "id").alias("long"), F.lit("").alias("short"), F.lit("go on").alias("action"), F.lit(False).alias("done"))
    rows = budget.gathered(steps, TOKENIZER, 128, "e", "s", F.lit("Play."))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert len(rows.groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.size("past"))).collect()) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    r = rows.agg(F.count("*").alias("n"), F.max(F.size("past")).alias("most"), F.sum(F.size("past")).alias("all")).first()
    assert r.n == 99_999 and r.most <= 20 and r["all"] < 20 * 100_000
    last = budget.fitted(rows.where("step = 99999"), TOKENIZER, 128).first()
    assert last.kept and last.text.endswith("assistant: go on") and "thing 99998" in last.text and "thing 99993" in last.text


def test_instruction_longer_than_the_budget(spark, library):
    rows = budget.gathered(episodes(spark, 5), TOKENIZER, 10, "e", "s", F.lit("many words of an instruction " * 9))
    want = library.encode("user: " + "many words of an instruction " * 9, add_special_tokens=False).ids[-10:]
    assert all(r.ids == want for r in budget.with_instruction(rows, TOKENIZER, 10).collect())
