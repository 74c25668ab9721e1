"""Readers, sinks, plans and streams over small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import keyed
from colloquy.operators import mixture, tokens
from colloquy.plans import rounds
from colloquy.sources import readers, sinks
from colloquy.streaming import jobs


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"text": "a"}\n\n{"text": "b"}\nnot json\n')
    assert {r.text for r in readers.json_lines(spark, str(p), "text string", strict=False).collect()} == {"a", "b"}
    with pytest.raises(Exception):  # noqa: B017
        readers.json_lines(spark, str(p), "text string").collect()
    assert readers.optional(spark, str(tmp_path / "none.jsonl"), "text string").count() == 0
    with pytest.raises(FileNotFoundError):
        readers.must_exist(spark, str(tmp_path / "none.jsonl"))


def test_csv_and_folders(spark, tmp_path):
    (tmp_path / "b.csv").write_text('title,word_count,content\nA,3,"one\ntwo ""three"""\nB,1\n')
    assert [tuple(r) for r in readers.book_csv(spark, str(tmp_path / "b.csv")).collect()] == [("A", "3", 'one\ntwo "three"')]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.json").write_text(json.dumps({"title": "x"}))
    (tmp_path / "d/y.json").write_text("{broken")
    found = readers.json_folder(spark, [str(tmp_path / "d"), str(tmp_path / "no")], "title string").collect()
    assert [r.title for r in found if r.title] == ["x"]
    (tmp_path / "n.csv").write_text("Ada\nBob\n")
    assert readers.lines(spark, [str(tmp_path / "n.csv"), str(tmp_path / "none")]).count() == 2


def test_articles_and_texts(spark, tmp_path):
    (tmp_path / "w.txt").write_text("Title One\n\nBody of the first article.\n\nlower start\n\nTitle Two\n\nAnother body here.")
    assert [tuple(r) for r in readers.articles(spark, str(tmp_path / "w.txt")).collect()] == [("Title One", "Body of the first article."), ("Title Two", "Another body here.")]
    (tmp_path / "t.txt").write_text("a<|end|>b<|end|>cut")
    assert [r.text for r in readers.delimited_texts(spark, str(tmp_path / "t.txt"), r"<\|end\|>").collect()] == ["a", "b"]
    (tmp_path / "log").write_text("pass rate: 74.5%\npass rate: 1%")
    assert readers.log_metric(spark, str(tmp_path / "log"), r"pass rate: ([0-9.]+)").first().value == 74.5
    assert readers.log_metric(spark, str(tmp_path / "nolog"), "x").first().value is None


def test_episodes_and_tokens(spark, tmp_path):
    folder = tmp_path / "env/task1"
    folder.mkdir(parents=True)
    np.savez(folder / "e.npz", action=np.array(["up", "down"]), reward=np.array([0.0, 1.0]), terminated=np.array([False, True]), truncated=np.array([False, False]))
    rows = readers.episode_arrays(spark, str(tmp_path)).withColumn("task", readers.task_of(F.col("file"), "env")).collect()
    assert [(r.step, r.action, r.task) for r in sorted(rows, key=lambda r: r.step)] == [(0, "up", "task1"), (1, "down", "task1")]
    np.arange(5000, dtype="<u2").tofile(tmp_path / "t.bin")
    got = readers.token_file(spark, str(tmp_path / "t.bin"))
    assert got.count() == 5000 and got.where("position <> token").count() == 0
    files = spark.createDataFrame([("a/1.csv",), ("a/1.json",), ("a/2.json",)], "path string")
    assert [r.path for r in readers.with_suffix_sibling(files, ".json", ".csv").collect()] == ["a/1.json"]


def test_sinks(spark, tmp_path):
    df = spark.range(100).withColumn("text", F.concat(F.lit("t"), "id")).withColumn("n", F.lit(3).cast("long"))
    split = mixture.holdout(df, F.col("id"), 7, 0.3)
    sinks.write_split(split, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 100 and set(r.split for r in back.select("split").distinct().collect()) == {"train", "holdout"}
    sinks.write_new(df, str(tmp_path / "once"))
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_new(df, str(tmp_path / "once"))
    sinks.write_texts(df, str(tmp_path / "j"))
    sinks.write_texts(df, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 200
    offsets = sinks.token_offsets(df, "id", "n").orderBy("id").collect()
    assert [r.offset for r in offsets] == [3 * i for i in range(100)]
    assert sinks.tail_split(sinks.token_offsets(df, "id", "n"), "offset", "n", 300).where("split = 'val'").count() == 1
    assert sinks.token_dtype(65536) == "uint16" and sinks.token_dtype(65537) == "uint32"


def test_plans(spark):
    docs = spark.createDataFrame([(1, "*waves* hi"), (2, "You are a new friend"), (3, "ok")], "id long, text string")
    got = rounds.build_mixture({"world": docs, "sim": docs}, "id", {"sim": 1}).collect()
    assert sorted((r.source, r.text) for r in got) == [("sim", "*waves* hi"), ("world", "hi"), ("world", "ok")]
    log = rounds.run_round([("a", lambda: 1, True), ("b", lambda: 1 / 0, False), ("c", lambda: 1 / 0, True), ("d", lambda: 1, True)])
    assert [n for n, _ in log] == ["a", "b", "c"]
    branches = spark.createDataFrame([("a", 3.0, 1.0), ("b", 3.0, None), ("c", None, 9.0)], "tag string, score double, second double")
    assert rounds.promote(branches).first().tag in {"a", "b"}


def test_keyed_uniform_is_stable(spark):
    assert spark.sql("SELECT 'k' AS k").select(keyed.uniform(F.col("k"), 7)).first()[0] == pytest.approx(0.010433056857436895)


def test_encode_and_pad(spark):
    import public_tokenizers

    df = spark.createDataFrame([(1, "hello there"), (2, ""), (3, None)], "id long, text string")
    ids = tokens.encode_texts(df, public_tokenizers.path("byte_bpe_50k.json"), 50256)
    got = {r.id: r.ids for r in ids.collect()}
    assert got[2] == got[3] == [50256] and got[1][-1] == 50256
    padded = tokens.left_pad(ids.withColumn("b", F.lit(1)), "b", "ids").collect()
    assert len({len(r.padded) for r in padded}) == 1


def test_streams(spark, tmp_path):
    rows = [(i, "a" if i % 2 else "b", f"2024-01-01 00:00:00.{i:03d}") for i in range(40)]
    spark.createDataFrame(rows, "id long, k string, t string").select("id", "k", F.col("t").cast("timestamp").alias("t")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, k string, t timestamp").parquet(str(tmp_path / "in"))
    q = jobs.micro_batches(stream, "k", "t", gap_ms=15, most=4).writeStream.format("memory").queryName("mb").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT key, batch, count(*) AS n FROM mb GROUP BY key, batch").collect()
    assert sum(r.n for r in got) == 40 and max(r.n for r in got) == 4
    q = jobs.append_to(stream.select("id"), str(tmp_path / "out"), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
