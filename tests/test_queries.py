"""Every query that has SQL gives the rows of that SQL; the others keep their invariants."""

import pytest

from colloquy import ingest, queries, studies

from .oracle import connect, same

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    same(spark, con, queries.QUERIES[name], queries.ORACLE_SQL[name], FOLDER)


def test_chain_depth(spark):
    import re

    stop = set("about their would could should there which these those where every".split())
    words = lambda t: set(re.findall("[a-z]{5,}", t.lower())) - stop
    df = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    turns = {(r.conv_id, r.turn): r for r in df.collect()}
    for r in queries.chain_depth(spark, FOLDER).collect():
        before = max((k for k in turns if k[0] == r.conv_id and k[1] < r.turn), key=lambda k: k[1])
        seen, depth = words(turns[before].text), 0
        for s in re.split(r"[.!?]\s", turns[r.conv_id, r.turn].text):
            if not words(s) & seen:
                break
            seen |= words(s)
            depth += 1
        assert r.depth == depth


def test_anchored_batches(spark):
    rows = queries.anchored_microbatch(spark, FOLDER).collect()
    times = {r.event_id: int(r.ts.timestamp() * 1000) for r in spark.read.parquet(f"{FOLDER}/events.parquet").collect()}
    users = {}
    for r in rows:
        users.setdefault(r.user_id, []).append((times[r.event_id], r.event_id, r.batch))
    assert sum(map(len, users.values())) == len(times)
    for items in users.values():
        start = size = None
        batch = -1
        for t, _, b in sorted(items):
            if start is None or t - start > 3_600_000 or size >= 4:
                start, size, batch = t, 0, batch + 1
            size += 1
            assert b == batch


def test_levels_in_blocks(spark):
    """Any blocks give the levels of going through the events one by one; floors, caps, ties and nulls."""
    import random

    from pyspark.sql import functions as F

    from colloquy.operators import world

    rnd = random.Random(3)
    rows = [(k, i, rnd.choice([-9, -2, 0, 1, 7, None])) for k in ("a", "b") for i in range(300)] + [("c", 0, 50)]
    df = spark.createDataFrame(rows, "k string, i long, d long")
    want, level = {}, {}
    for k, i, d in rows:
        level[k] = want[k, i] = min(max(level.get(k, 5) + (d or 0), 0), 12)
    for width in (1, 7, 1000):
        got = world.levels(df.repartition(5), "k", ["i"], "d", 0, 12, 5, F.floor(F.col("i") / width)).collect()
        assert {(r.k, r.i): r.level for r in got} == want
    assert world.levels(df.limit(0), "k", ["i"], "d", 0, 12, 5, F.col("i")).count() == 0


def test_sale_texts_end_with_their_oracle(spark):
    rows = queries.sale_scenario_text(spark, FOLDER).collect()
    assert rows and all(r.text.startswith("Mara's Description: ") and "\n<START>\n" in r.text for r in rows)
    for r in rows:
        last = r.text.split("\n")[-1]
        assert last == r.oracle if r.oracle else not last.startswith("[")


def test_draws_are_distinct_and_null_where_too_few(spark):
    from colloquy.operators import dialogue

    items = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("b", "w")], "trade string, item string")
    rows = spark.createDataFrame([(i, t) for i in range(30) for t in "abc"], "key long, trade string")
    got = dialogue.draw(rows, items, "trade", "item", "key", "s", ["one", "two", "three"]).collect()
    assert len(got) == 90
    for r in got:
        drawn = [x.item for x in (r.one, r.two, r.three) if x]
        assert len(set(drawn)) == len(drawn) == {"a": 3, "b": 1, "c": 0}[r.trade]


def test_waves_go_on_after_a_failure():
    from colloquy.plans.rounds import run_waves

    assert run_waves([lambda: 1, lambda: 1 / 0, lambda: 2], wave=2) == ["done", "failed: division by zero", "done"]


def test_persona_records(spark):
    from pyspark.sql import functions as F

    from colloquy.operators import dialogue

    talk = "{{char}}: Description: hidden\n{{char}}: Hail  there.\n{{user}}: Who are you?\n{{char}}: A smith.\n{{user}}: Good."
    rows = [
        ("Mara", "A long road brings you here! And now. Sit.", talk),
        ("Mara", None, talk),
        ("mara", None, talk),
        ("Mara", None, "{{user}}: One.\n{{char}}: Two."),
        ("Mara", None, talk + "\n{{user}}: " + "x" * 401),
        ("Mara", None, talk + "\n{{user}}: "),
        ("Mara", None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, greeting string, script string")
    got = {r.i: r.card for r in df.select("i", dialogue.persona_record(F.col("name"), F.col("greeting"), F.col("script")).alias("card")).collect()}
    body = "\nScenario: a meeting with Mara.\n<START>\nMara: Hail there.\nPlayer: Who are you?\nMara: A smith.\nPlayer: Good.\n"
    assert got.pop(0) == "Description: A long road brings you here! And now." + body
    assert got.pop(1) == "Description: Mara, a character." + body
    assert set(got.values()) == {None}
