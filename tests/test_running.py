"""Statistics kept by a stream equal those of the table, at every checkpoint."""

from pyspark.sql import functions as F

from colloquy.operators import conversations as C
from colloquy.operators import grading, prompts
from colloquy.sources import readers
from colloquy.streaming import running


def test_every_checkpoint_equals_the_batch(spark, tmp_path):
    """Files come one by one; each version equals a count over the files so far; a compacted table goes on."""
    path, state, seen = str(tmp_path / "stats"), str(tmp_path / "state"), []
    for k in range(4):
        rows = [(f"p{i % (k + 2)}", None if i == 3 else float((i * 7 + k) % 5)) for i in range(10)]
        seen += rows
        spark.createDataFrame(rows, "prompt string, score double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        running.keep(spark.readStream.schema("prompt string, score double").parquet(str(tmp_path / "in")), path, state).awaitTermination()
        want = {}
        for p, s in seen:
            a = want.setdefault(p, [0, 0])
            a[0] += 1
            a[1] += s is not None and s >= 3
        for version in (None, k):
            assert {r.prompt: [r.attempts, r.passes] for r in running.snapshot(spark, path, version).collect()} == want
        if k == 1:
            then = want
    assert {r.prompt: [r.attempts, r.passes] for r in running.snapshot(spark, path, 1).collect()} == then
    running.compact(spark, path, str(tmp_path / "small"), 3)
    assert {r.prompt: [r.attempts, r.passes] for r in running.snapshot(spark, str(tmp_path / "small")).collect()} == want
    # The curriculum is drawn from a snapshot.
    pool = running.snapshot(spark, path).select(F.substring("prompt", 2, 9).cast("long").alias("place"), "attempts", "passes", F.lit(None).cast("string").alias("oracle"))
    drawn = prompts.curriculum(spark.range(40).withColumnRenamed("id", "step"), pool).collect()
    zone = {int(p[1:]) for p, (a, b) in want.items() if a < 2 or 0.15 <= b / a <= 0.85}
    assert len(drawn) == 40 and {r.place for r in drawn} <= zone


def test_flaws_by_count_and_first_seen(spark):
    rows = [(2, ["a", "b"]), (1, ["c", "b"]), (3, ["a", "c", "c"]), (4, None), (5, [])]
    got = grading.flaw_ranking(spark.createDataFrame(rows, "i int, flaws array<string>"), ["i"]).orderBy("rank").collect()
    assert [(r.flaw, r.n_flaws) for r in got] == [("c", 3), ("b", 2), ("a", 2)]


def test_block_text(spark):
    df = spark.createDataFrame([([("text", "a"), ("image", None), ("text", "b c")],), (None,), ([],)], "c array<struct<type:string,text:string>>")
    assert sorted(r.t for r in df.select(C.block_text(F.col("c")).alias("t")).collect()) == ["", "", "a  b c"]


def test_observations_of_episode_files(spark, tmp_path):
    import json

    import numpy as np

    one = {"action": np.array(["a", "b"]), "reward": np.zeros(2), "terminated": np.zeros(2, bool), "truncated": np.array([False, True])}
    np.savez(tmp_path / "x.npz", **one, long_term_context=np.array(["l0", "l1"]), short_term_context=np.array(["", "s1"]))
    np.savez(tmp_path / "y.npz", **one, text=np.array([json.dumps({"long_term_context": "j0"}), ""]))
    np.savez(tmp_path / "z.npz", **one)
    got = sorted((r.file[-5], r.step, r.long, r.short, r.truncated) for r in readers.episode_arrays(spark, str(tmp_path)).collect())
    assert got == [("x", 0, "l0", "", False), ("x", 1, "l1", "s1", True), ("y", 0, "j0", "", False), ("y", 1, "", "", True), ("z", 0, "", "", False), ("z", 1, "", "", True)]
