"""Orders, permutations, replays and appends by hand."""

import json

import pytest
from pyspark.sql import functions as F

from colloquy.functions import permute
from colloquy.functions import text as T
from colloquy.operators import conversations as C
from colloquy.operators import order, replays
from colloquy.sources import first_seen, readers


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 99, 1000, 4096, 4097])
def test_permutations(spark, n):
    for seed in (1, "b"):
        rows = spark.range(n).select("id", permute.place(F.col("id"), n, seed).alias("k")).withColumn("back", permute.row_at(F.col("k"), n, seed)).collect()
        assert sorted(r.k for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    if n >= 99:  # no row keeps its neighbours, and a half of the rows isn't a half of the order
        k = {r.id: r.k for r in rows}
        assert sum(abs(k[i] - k[i + 1]) == 1 for i in range(n - 1)) < n / 20
        assert 0.3 * n / 2 < sum(k[i] < n / 2 for i in range(n // 2)) < 0.7 * n / 2 + 10


def test_large_permutation(spark):
    n = (1 << 40) + 12345
    rows = spark.range(n - 500, n).select("id", permute.place(F.col("id"), n, 9).alias("k")).withColumn("back", permute.row_at(F.col("k"), n, 9)).collect()
    assert len({r.k for r in rows}) == 500 and all(0 <= r.k < n and r.back == r.id for r in rows)


@pytest.mark.parametrize("size", ["1g", "20k", "2k"])
def test_first_rows_follow_the_files(spark, tmp_path, size):
    """Files read as one, some or many tasks: the rows are those of sequential reading."""
    rows = [{"s": "ab"[i % 3 == 0], "text": f"text {i} " * (i % 9), "i": i} for i in range(3000)]
    (tmp_path / "in").mkdir()
    for k, (a, b) in enumerate([(0, 1700), (1700, 1701), (1701, 3000)]):
        (tmp_path / f"in/{k}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows[a:b]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        scan = readers.json_lines(spark, str(tmp_path / "in"), "s string, text string, i long")
        clean = order.as_read(scan).where("text NOT LIKE '%text 5%'")
        want = [r for r in rows if "text 5" not in r["text"]]
        for n in (1, 7, 600, 5000):
            got = order.first_rows(clean, n).orderBy(order.FILE, order.START, order.PLACE).collect()
            assert [r.i for r in got] == [r["i"] for r in want[:n]]
            by = order.first_rows(clean, n, ["s"]).orderBy(order.FILE, order.START, order.PLACE).collect()
            assert [r.i for r in by] == sorted(r["i"] for s in "ab" for r in [x for x in want if x["s"] == s][:n])
        if size == "2k":
            assert clean.rdd.getNumPartitions() > 32
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def act(kind="ChatAction", **kw):
    return {"action": {"action_type": kind, "kwargs": kw}}


def test_chat_turns_of_replays(spark, tmp_path):
    """Actions of other types, without message or speaker, or that are no objects; roles from prompts, or none."""
    game = {"id": 7, "steps": [
        [act(message=" Hello all. ", actor_id="Ada", raw_prompt='{"your_role_name":  "Seer", "x": 1}'), act("VoteAction", message="no", actor_id="Bob"), {"action": 3}, {"action": None}, {}],
        [act(message="", actor_id="Ada"), act(message="no speaker"), act(actor_id="Bob"), act(message="Two words.", actor_id="Bob", raw_prompt="none"), {"action": "ChatAction"}],
        [], [act(message="I vote for the miller tonight.", actor_id="Cyd")],
    ]}
    (tmp_path / "a.json").write_text(json.dumps(game, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text('{"other": []}')
    (tmp_path / "d.txt").write_text(json.dumps(game))
    turns = replays.chat_turns(readers.game_replays(spark, str(tmp_path)))
    rows = sorted((r.step, r.agent, r.speaker, r.role, r.text) for r in turns.collect())
    assert rows == [(0, 0, "Ada", "Seer", " Hello all. "), (1, 3, "Bob", "Villager", "Two words."), (3, 0, "Cyd", "Villager", "I vote for the miller tonight.")]
    placed = turns.withColumn("turn", F.col("step") * 100 + F.col("agent"))
    cards = C.game_cards(placed, F.concat("speaker", F.lit(", a "), "role"), F.lit("s"), key="file")
    assert [r.card for r in cards.collect()] == ["Description: Cyd, a Villager\nScenario: s\n<START>\nAda: Hello all.\nBob: Two words.\nCyd: I vote for the miller tonight.\n"]


def test_appends_add_what_is_new(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c"), (4, None), (5, "")], "i long, text string")
    key = F.substring(T.collapse(F.col("text")), 1, 120)
    first_seen.append(df, path, key, "i", folders=16)
    assert sorted(r.i for r in first_seen.read(spark, path).collect()) == [1, 3, 4]
    for _ in range(2):
        assert first_seen.fresh(df, path, key, "i", folders=16).count() == 0
        first_seen.append(df, path, key, "i", folders=16)
    assert first_seen.read(spark, path).count() == 3
    more = df.union(spark.createDataFrame([(9, "d"), (8, " d ")], df.schema))
    first_seen.append(more, path, key, "i", folders=16)
    assert sorted(r.i for r in first_seen.read(spark, path).collect()) == [1, 3, 4, 8]
    scan = first_seen.fresh(more.where("i = 9"), path, key, "i", folders=16)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "ReadSchema: struct<key_digest:string>" in scan  # only digests of the folders asked for
