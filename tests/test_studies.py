"""Hand-made rows, libraries and plain Python for demonstrations, prompts, scenarios, results and token files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy import studies
from colloquy.operators import demos, episodes, experiments, numeric, prompts, scenarios, tokens
from colloquy.sources import readers, sinks

FOLDER = "/root/testdata/sf0.001"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def test_unknown_environment_is_an_error(spark):
    rules = spark.createDataFrame([("a", "", False, 0, "Go.")], demos.RULES)
    rows = spark.createDataFrame([("a", None, None), ("a", "x", "m")], "env string, task string, first string")
    assert [r.instruction for r in demos.instructed(rows, rules).collect()] == ["Go.", "Go."]
    for env in ("b", None):
        with pytest.raises(Exception, match="unknown environment"):
            demos.instructed(spark.createDataFrame([(env, "", "")], "env string, task string, first string"), rules).collect()


def test_observations_with_and_without_texts(spark):
    given = [('{"text": {"long_term_context": "L", "short_term_context": "S"}}', "L", "S"), ('{"text": "flat"}', "", ""), ("{}", "", ""), ("[1]", "", ""), ("broken", "", ""), (None, "", ""), ('{"text": {"long_term_context": null}}', "", "")]
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(given)], "i int, o string")
    long, short = demos.observation_text(F.col("o"))
    for r in df.select("i", long.alias("l"), short.alias("s")).collect():
        assert (r.l, r.s) == given[r.i][1:]


def test_replay_drops_the_reset_and_stops_at_the_first_end(spark):
    rows = [("e", i, f"L{i}", "", f"a{i}", i in (0, 2)) for i in range(5)] + [("one", 0, "L", "", "a", True)]
    df = spark.createDataFrame(rows, "k string, i int, long string, short string, action string, done boolean")
    got = {r.i: (r.long, [(h.seen, h.action) for h in r.past], r.action) for r in demos.replayed(df, "k", "i").collect()}
    assert got == {1: ("L0", [], "a1"), 2: ("L1", [("L0", "a1")], "a2")}


def test_messages_leave_out_empty_parts(spark):
    none = F.array().cast("array<struct<seen:string,action:string>>")
    for long, short, want in (("L", "S", "Current Observation:\nS\nL"), ("L", "", "Current Observation:\nL"), ("", "", "Current Observation:")):
        m = spark.range(1).select(demos.messages(F.lit("I"), none, F.lit(long), F.lit(short)).alias("m")).first().m
        assert [(x.role, x.text) for x in m] == [("user", "I"), ("user", want)]


def test_invalid_actions_on_the_first_and_the_last_row(spark):
    mark = "Your previous output did not contain a valid action. Defaulted to action: "
    rows = [("e", 0, mark + "wait\nA", "junk"), ("e", 1, "B", "go"), ("e", 2, mark + "\nC", "more junk"), ("e", 3, "D", "up"), ("f", 0, mark + "x\n", "y")]
    df = spark.createDataFrame(rows, "k string, i int, observation string, action string")
    got = {(r.k, r.i): (r.seen, [h.action for h in r.past]) for r in demos.selfplay(df, "k", "i").collect()}
    assert got == {("e", 1): (mark + "wait\nA", ["wait"]), ("e", 3): (mark + "\nC", ["wait", "go", ""])}


def test_rows_fit_as_the_tokenizer_counts(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    kept = {}
    for r in studies.demo_rows(spark, FOLDER).collect():
        kept[r.id] = r
        assert r.kept == (r.text is not None) and (not r.kept or count(r.text) <= 256)
    made = {f"{r.conv_id}|{r.turn}": r for r in studies._demos(spark, FOLDER).collect()}
    assert kept.keys() == made.keys() and any(r.kept for r in kept.values())
    for k, r in made.items():
        if count(r.prompt) + count(" " + r.action) <= 256 and count(r.prompt + " " + r.action) <= 256:
            assert kept[k].text == r.prompt + " " + r.action
        elif kept[k].kept:
            assert kept[k].text.endswith("assistant: " + r.action)
    rows = spark.createDataFrame([("long", "p", "word " * 300), ("null", None, None)], "id string, prompt string, action string")
    assert {r.id: r.kept for r in demos.fit_rows(rows, TOKENIZER, 256).collect()} == {"long": False, "null": True}


def test_scenarios_of_odd_conversations(spark):
    rows = ["H\n<START>\nMara: Hi\nPlayer: a\nMara: b\n[DEAL: Rope 3]\nPlayer: c\nMara: d", "H\n<START>\nMara: Hi\nPlayer: a\n[BUY: x 1]\n[GOTO: y]", "H\n<START>\nPlayer: first line only\nMara: x", "no mark", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string")
    got = {r.i: (r.prompt, r.oracle, r.keeper) for r in prompts.scenarios(df).collect()}
    assert got == {0: (rows[0][: rows[0].index("c") + 1] + "\nMara:", None, "Mara"), 1: ("H\n<START>\nMara: Hi\nPlayer: a\nMara:", "[BUY: x 1]", "Mara")}


def test_asked_lines_of_odd_cards(spark):
    rows = ["H\n<START>\nMara: Hi\nPlayer: q: one \nPlayer: q2\nMara: a: b\nPlayer: q3\nplain", "H\n<START>\nMara: Hi", "H\n<START>\nPlayer: q\nMara: a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, card string")
    got = {r.i: tuple(r.a) for r in df.select("i", prompts.asked_lines(F.col("card")).alias("a")).collect()}
    assert got == {0: ("q2", "a: b", "plain"), 1: (None, None, None), 2: ("q", "a", None)}


def test_answers_by_hand(spark):
    rows = [
        ("[DEAL: Rope 10]", "It is 12 gold.\n[DEAL: Rope 13]\nPlayer: [GOTO: x]", ("DEAL", True, True, False, True, True)),
        ("[DEAL: Rope 10]", "[DEAL: Rope 14]", ("DEAL", False, True, False, False, None)),
        (None, "Just words.", ("none", True, True, False, False, None)),
        (None, "*bows* ok\n[WAIT:]\n[GOTO: Karhold]", ("none", False, False, False, False, None)),
        ("[GOTO: Karhold]", "[GOTO: Nowhere]", ("GOTO", False, True, True, False, None)),
        ("[BUY: Rope 3]", "[DANCE]", ("BUY", False, False, True, False, None)),
        (None, "", ("none", True, True, False, False, None)),
    ]
    df = spark.createDataFrame([(i, o, t) for i, (o, t, _) in enumerate(rows)], "i int, oracle string, text string")
    items = spark.createDataFrame([("Rope",), ("Rope",)], "item string")
    for r in scenarios.with_items(scenarios.answers(df, places=["Karhold"]), items).collect():
        kind, ok, formatted, invalid, quoted, near = rows[r.i][2]
        assert (r.kind, r.ok, r.formatted, r.invalid, r.quoted) == (kind, ok, formatted, invalid, quoted), r
        assert near is None or r.near == near


def test_half_scales_are_numpys(spark):
    x = [0.0, 1e-9, 1e-8, 6e-8, 3.1e-5, 6.1e-5, 0.1, 1 / 3, 1.0009765625, 1.00048828125, 2047.5, 2049.0, 65504.0, 65519.0, 65520.0, 1e6]
    got = [r.h for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(numeric.half(F.col("x")).alias("h")).collect()]
    with np.errstate(over="ignore"):
        assert got == [float(np.float16(v)) for v in x]
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").join(studies.quantize_half_scales(spark, FOLDER), "vec_id").collect()
    for r in rows[:50]:
        want = []
        v = np.array(r.embedding, np.float64)
        for g in range(0, len(v), 24):
            p = v[g : g + 24]
            s = float(np.float16(max(np.abs(p).max() / 7, 1e-8)))
            want += list(np.clip(np.round(p / s), -7, 7) * s if s else p * 0)
        assert np.allclose(r.dq, want, atol=1e-12)


def test_ranks_of_ties_nulls_and_a_hot_group(spark):
    rows = [("hot", i, float(i % 7) if i % 5 else None) for i in range(900)] + [("b", i, 1.0) for i in range(3)] + [(None, 0, 2.0)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = episodes.ranked(df, "g", [F.desc_nulls_last("v"), F.asc("i")], "v", buckets=8).collect()
    assert len(got) == len(rows)
    for g in ("hot", "b", None):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.rank)
        assert [r.i for r in mine] == [r[1] for r in want] and [r.rank for r in mine] == list(range(1, len(want) + 1)) and {r.of for r in mine} == {len(want)}
    wide = episodes.ranked(df, "g", [F.desc_nulls_last("v"), F.asc("i")], "v", buckets=8, most=0)
    assert sorted(map(str, wide.collect())) == sorted(map(str, got))


def test_collapsed_branches(spark):
    rows = [(b, p, "same") for b in "xyz" for p in range(5)]
    pairs = experiments.pairwise_divergence(spark.createDataFrame(rows, "b string, p int, t string"), "b", "p", "t")
    assert {(r.a, r.b, r.mean, r.collapsed) for r in experiments.divergence_report(pairs).collect()} == {("x", "y", 0.0, True), ("x", "z", 0.0, True), ("y", "z", 0.0, True)}


def test_token_files_hold_all_tokens_in_order(spark, tmp_path):
    rows = [(i, list(range(i * 3, i * 3 + i % 4))) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, ids array<int>")
    made = sinks.write_token_files(df, f"file://{tmp_path}/bins", "k", "ids", parts=4).collect()
    back = np.concatenate([np.fromfile(p, "<u2") for p in sorted((tmp_path / "bins").glob("tokens-*.bin"))])
    assert list(back) == [t for _, ids in rows for t in ids] and sum(r.n_tokens for r in made) == len(back)
    with pytest.raises(Exception, match="doesn't fit"):
        sinks.write_token_files(spark.createDataFrame([(0, [70000])], "k long, ids array<int>"), f"file://{tmp_path}/bad", "k", "ids").collect()


def test_split_across_a_row(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], 0), (1, [4, 5, 6, 7], 3), (2, [], 7)], "k int, ids array<int>, offset long")
    got = sorted((r.k, r.split, r.ids) for r in tokens.split_at(df, "ids", "offset", 7, fraction=0.3).collect())
    assert got == [(0, "train", [1, 2, 3]), (1, "train", [4, 5]), (1, "val", [6, 7])]


def test_results_returns_holdouts_and_metrics(spark, tmp_path):
    runs = tmp_path / "runs"
    runs.mkdir()
    for i, arm in enumerate(["a", "a", "b"]):
        (runs / f"r{i}.json").write_text(json.dumps({"arm": arm, "final_val": 1.0 + i, "params": {"core": 5}, "other": [1]}, indent=1))
    assert {(r.arm, r.mean, r.n) for r in experiments.by_arm(readers.results(spark, str(runs)), "arm", "final_val").collect()} == {("a", 1.5, 2), ("b", 3.0, 1)}
    play = tmp_path / "play" / "maze" / "t"
    play.mkdir(parents=True)
    (play / "t_run_00.json").write_text('{"episode_return": 2.5}')
    (play / "t_run_01.json").write_text('{"x": 1}')
    returns = readers.episode_returns(spark, str(tmp_path / "play"))
    assert sorted(r.episode_return for r in returns.collect()) == [0.0, 2.5]
    steps = spark.createDataFrame([(f"file:{play}/t_run_00.csv", 1), (f"file:{play}/t_run_07.csv", 2)], "file string, step int")
    stem = F.regexp_replace("stem", "^file:/+", "/")
    plain = steps.withColumn("file", F.regexp_replace("file", "^file:/+", "/"))
    assert [(r.step, r.episode_return) for r in readers.episodes_with_returns(plain, returns.withColumn("stem", stem)).collect()] == [(1, 2.5)]
    with pytest.raises(FileNotFoundError):
        readers.holdouts(spark, str(runs))
    for n in "ba":
        (runs / f"{n}_holdout.jsonl").write_text('{"text": "%s"}\n\n' % n)
    assert [(r.file, r.text) for r in readers.holdouts(spark, str(runs)).collect()] == [("a_holdout.jsonl", "a"), ("b_holdout.jsonl", "b")]
    path = sinks.named_output(str(tmp_path / "out"), "metrics", "x")
    for run in ("one", "two"):
        sinks.append_metrics(spark, path, run, [(1, 10, 2.0, 2.5)])
    assert spark.read.parquet(path).count() == 2


def test_pool_prefers_oracles_every_third_step(spark):
    pool = spark.createDataFrame([(0, 0, 0, None), (1, 9, 9, None), (2, 9, 9, "[WAIT:]")], "place long, attempts long, passes long, oracle string")
    got = {r.step: (r.kind, r.place) for r in prompts.curriculum(spark.range(6).withColumnRenamed("id", "step"), pool).collect()}
    assert got == {i: ("oracle", 2) if i % 3 == 0 else ("zone", 0) for i in range(6)}
    known = pool.where("place = 1")
    assert {r.kind for r in prompts.curriculum(spark.range(6).withColumnRenamed("id", "step"), known).collect()} == {"all"}
    assert prompts.curriculum(spark.range(6).withColumnRenamed("id", "step"), pool.limit(0)).count() == 0
