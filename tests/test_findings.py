"""Inputs on which queries once differed from their SQL, or that larger tables hold."""

from colloquy import ingest, queries, studies  # noqa: F401  (they register their queries)

from .oracle import connect, same


def check(spark, tmp_path, name, tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    return same(spark, connect(tmp_path), queries.QUERIES[name], queries.ORACLE_SQL[name], tmp_path)


def test_widest_layers_of_large_keys(spark, tmp_path):
    rows = [(k, s) for k, s in ((1, 0), (90_000, 0), (90_001, 1), (2_000_000, 3), (7_200_000, 2))]
    assert check(spark, tmp_path, "ffn_solver", {"part": (rows, "p_partkey long, p_size int")}) == len(rows)


#: Cuts that end with white space of each kind, without a sentence end before.
_ENDS = ["x" * 399 + e + "y" * 50 for e in (" ", "\n", "\t", "\r", "\x0b", "　")] + [e + "ab" * 10 + e for e in ("\n", " ", "\x0b", " ")]


def test_cuts_before_white_space(spark, tmp_path):
    assert check(spark, tmp_path, "truncate_sentence", {"documents": (list(enumerate(_ENDS)), "doc_id long, text string")}) == len(_ENDS)


def _turns():
    return [(c, t, "user" if t % 2 else "assistant", _ENDS[(c + t) % len(_ENDS)]) for c in range(10) for t in range(6)], "conv_id long, turn int, role string, text string"


def test_game_cards_before_white_space(spark, tmp_path):
    assert check(spark, tmp_path, "game_cards", {"conversations": _turns()}) > 0


def test_replay_cards_before_white_space(spark, tmp_path):
    assert check(spark, tmp_path, "replay_cards", {"conversations": _turns()}) > 0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_splits_are_not_numbered_whole(spark, tmp_path):
    rows = [(i, f"text {i}" if i % 9 else ("" if i % 2 else None)) for i in range(5000)]
    assert check(spark, tmp_path, "run_conversion", {"documents": (rows, "doc_id long, text string")}) > 3000
    windows = [line for line in _plan(queries.QUERIES["run_conversion"](spark, tmp_path)).split("\n") if "row_number()" in line]
    assert windows and all("part_" in line for line in windows)


def test_expanded_items_without_rows_for_each_adjective(spark, tmp_path):
    rows = [(i, float(i) + 0.5) for i in range(300)] + [(7, 7.5)]
    assert check(spark, tmp_path, "item_expansion", {"part": (rows, "p_partkey long, p_retailprice double")}) == 301 + 300 * 4
    plan = _plan(queries.QUERIES["item_expansion"](spark, tmp_path))
    assert "Window" not in plan and "Join" not in plan


def test_small_ranges_share_tasks(tmp_path):
    from colloquy.sources import ranges

    for i in range(7):
        (tmp_path / f"{i}.txt").write_bytes(b"x" * (3 << 20) + b"\n")
    parts = ranges.ranges(str(tmp_path), 1 << 10)
    packs = ranges.packs(parts)
    assert len(parts) > 20_000 and len(packs) <= 2 * ranges.TASKS
    assert [(r.path, r.start, r.end) for p in packs for r in p.parts] == [(r.path, r.start, r.end) for r in parts]


def _texts(sizes):
    return [(i, None if n is None else " ".join(["w"] * n)) for i, n in enumerate(sizes)], "doc_id long, text string"


def test_tokens_are_cut_without_moving_texts(spark, tmp_path):
    talk = [(1, 0, "user", "a b")], "conv_id long, turn int, role string, text string"
    for sizes in ([3000, 0, 0, 1990, 10, 0, 7], [10, 0, 20, 0], [6000], [4999, 0, 2, 0, 900], [0, 0]):
        tables = {"documents": _texts(sizes), "conversations": talk}
        check(spark, tmp_path, "tail_append", tables)
        if sum(sizes):
            check(spark, tmp_path, "token_split", tables)
    assert "Window" not in _plan(queries.QUERIES["token_split"](spark, tmp_path))


def test_logs_of_many_runs_share_files(spark, tmp_path):
    rows = [(c, t, "user", f"line {c}\n, {t} \"x\" ") for c in range(1200) for t in range(2)]
    assert check(spark, tmp_path, "replay_logs", {"conversations": (rows, "conv_id long, turn int, role string, text string")}) == len(rows)
    assert len(queries.QUERIES["replay_logs"](spark, tmp_path).inputFiles()) == 3


def test_ways_of_parts_are_those_of_relaxing(spark, tmp_path):
    import datetime
    import random

    from colloquy.operators import world

    rnd = random.Random(5)
    roads = [(f"{p}-{rnd.randrange(8)}", f"{p}-{rnd.randrange(8)}", rnd.randrange(9), p) for p in range(30) for _ in range(4 if p % 2 else 14)]
    df = spark.createDataFrame(roads, "src string, dst string, ticks long, part int").repartition(3)
    got = lambda **kw: sorted(map(tuple, world.travel_ticks(df, **kw).collect()))
    want = got()
    assert want and got(part="part") == got(part="part", small=10) == got(part="part", small=0) == want
    rows = [(i, i % 7, datetime.datetime(1992, 1 + i % 12, 1 + i % 28)) for i in range(400)]
    for name in ("travel_ticks", "graph_reachability"):
        assert check(spark, tmp_path, name, {"orders": (rows, "o_orderkey long, o_custkey long, o_orderdate timestamp")}) > 0
    assert "checkpoint" not in _plan(queries.QUERIES["travel_ticks"](spark, tmp_path)).lower()


def _chain_of(n):
    """Orders of one customer's year, and a few of others."""
    import datetime
    import random

    rnd = random.Random(7)
    day = lambda: datetime.datetime(1995, 1, 1) + datetime.timedelta(days=rnd.randrange(365))
    rows = [(i, 1, day()) for i in range(n)] + [(n + i, 2 + i % 20, day()) for i in range(60)]
    return {"orders": (rows, "o_orderkey long, o_custkey long, o_orderdate timestamp")}


def test_reach_of_long_chains(spark, tmp_path):
    assert check(spark, tmp_path, "graph_reachability", _chain_of(180)) > 180


def test_ways_of_long_chains(spark, tmp_path):
    assert check(spark, tmp_path, "travel_ticks", _chain_of(180)) > 180 * 180


def test_stops_without_customer_or_date_are_of_no_chain(spark, tmp_path):
    import datetime

    rows = [(i, None if i % 3 == 0 else 1, None if i % 3 == 1 else datetime.datetime(1995, 1, 1 + i)) for i in range(24)]
    for name in ("travel_ticks", "graph_reachability"):
        assert check(spark, tmp_path, name, {"orders": (rows, "o_orderkey long, o_custkey long, o_orderdate timestamp")}) > 0


def test_ways_are_relaxed_until_none_gets_shorter(spark):
    from colloquy.operators import world

    n = 70
    roads = [(f"s{a}", f"s{b}", 1, 0) for i in range(n - 1) for a, b in ((i, i + 1), (i + 1, i))] + [(None, "s0", 2, 0), ("s0", None, 2, 0)]
    df = spark.createDataFrame(roads, "src string, dst string, ticks long, part int")
    got = lambda **kw: sorted(map(repr, map(tuple, world.travel_ticks(df, **kw).collect())))
    at = [("s%d" % i, i) for i in range(n)] + [(None, -2)]
    want = sorted(repr((a, b, abs(i - j))) for a, i in at for b, j in at)
    assert got(part="part", small=0, held=0) == got(part="part", small=0) == got(part="part") == want
    assert {tuple(r) for r in world.reaches(df, "part", held=0).collect()} == {(a, n + 1) for a, _ in at}


def test_reach_is_that_of_ways(spark):
    import random

    from colloquy.operators import world

    rnd = random.Random(6)
    pairs = [(f"{p}-{rnd.randrange(40)}", f"{p}-{rnd.randrange(40)}", p) for p in range(20) for _ in range(5 if p % 2 else 30)]
    df = spark.createDataFrame([(a, b, 1, p) for x, y, p in pairs for a, b in ((x, y), (y, x))], "src string, dst string, ticks long, part int").repartition(3)
    got = lambda **kw: sorted(map(tuple, world.reaches(df, "part", **kw).collect()))
    want = sorted(map(tuple, world.travel_ticks(df, part="part").groupBy("src").count().collect()))
    assert want and got() == got(held=20) == got(held=0) == want


def test_actions_are_parsed_once(spark):
    from pyspark.sql import functions as F

    from colloquy.functions import text as T

    parsed = spark.range(1).select(T.parse_action(F.concat(F.lit(" [BUY: a "), "id", F.lit("]\u3000"))).alias("a"))
    plan = _plan(parsed)
    assert plan.count("regexp_extract") <= 4 and "regexp_replace" not in plan
    assert tuple(parsed.first().a) == ("BUY", "a", 0)


def test_trims_take_all_white_space(spark):
    from pyspark.sql import functions as F

    from colloquy.functions import text as T

    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(c, f"{c}{c}x{c}y{c}") for c in chars], "c string, t string")
    for r in df.select("c", T.strip(F.col("t")).alias("s"), T.strip_left(F.col("t")).alias("l"), T.strip_right(F.col("t")).alias("r")).collect():
        t = f"{r.c}{r.c}x{r.c}y{r.c}"
        assert (r.s, r.l, r.r) == (t.strip(), t.lstrip(), t.rstrip())


def test_plain_words_are_joined_without_the_library(spark):
    import random

    import numpy as np
    import public_tokenizers

    from colloquy.llm import word_bpe

    bpe = word_bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(3)
    made = lambda chars: {"".join(rnd.choices(chars, k=n)) for n in range(1, 40) for _ in range(200)}
    words = {t.removesuffix("</w>") for t in bpe.whole.get_vocab() if t.isascii() and t.encode() not in bpe.specials} | set(word_bpe._LETTERS) | made("aehEtz") | made("-=*.</w>") | made("a\xe9\xdf\u0130'sT.,5 ") | made(word_bpe._LETTERS) | made("e\u0301\u4e00 a\xaa\xb2'\x1c")
    found = [f"{rnd.choice(['', ' ', chr(10)])}{w}" for w in sorted(words)]
    want = [np.array(e.ids, "<u4").tobytes() for e in bpe.whole.encode_batch(found, add_special_tokens=False)]
    assert [bpe._one(f.encode()) for f in found] == want
    data = "".join(found).encode()
    offsets = np.cumsum([0, *(len(f.encode()) for f in found)])
    assert bpe.encode(np.frombuffer(data, np.uint8), offsets) == want

    class Silent:
        def encode(self, *_, **__):
            raise AssertionError("a plain word went to the library")

    bpe.whole = Silent()
    assert all(map(bpe._one, (b"\n Unbelievable", b" 7", b"...", " caf\xe9,".encode())))


def test_levels_of_short_keys_need_no_blocks(spark):
    import random

    from pyspark.sql import functions as F

    from colloquy.operators import world

    rnd = random.Random(4)
    rows = [(k, i, rnd.choice([-9, -2, 0, 1, 7, None])) for k, n in (("a", 90), ("b", 20), (None, 5), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, d long").repartition(3)
    plans, want = [], None
    for few in (256, 20, 0):
        made = world.levels(df, "k", ["i"], "d", 0, 12, 5, F.floor(F.col("i") / 7), few)
        got = sorted(map(tuple, made.collect()))
        assert len(got) == 111 and got == (want or got)
        want = got
        plans.append("FlatMapGroups" in _plan(made))
    assert plans == [False, True, True]


def test_items_of_a_large_group_are_numbered_by_many_tasks(spark):
    from colloquy.operators import dialogue

    rows = [(i % 2 if i % 50 else None, f"item {i * 7919 % 1000}" if i % 33 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "trade int, item string").repartition(5)
    plain = lambda group: sorted((r[1] for r in rows if r[0] == group), key=lambda x: (x is not None, x))
    for per_range in (100, 10_000):
        numbered = dialogue.numbered(df, "trade", "item", per_range)
        got = sorted(map(tuple, numbered.select("trade", "i_", "item").collect()), key=lambda r: r[:2])
        assert got == [(g, i, item) for g in (0, 1) for i, item in enumerate(plain(g))]
    assert "part_" in _plan(dialogue.numbered(df, "trade", "item", 100))
    drawn = dialogue.draw(spark.range(3).selectExpr("id", "id AS trade"), df, "trade", "item", "id", "s", ["one"])
    assert _plan(drawn).count("RepartitionByExpression [trade") == 2


def test_appends_write_a_file_a_folder(spark, tmp_path):
    import glob

    from pyspark.sql import functions as F

    from colloquy.sources import first_seen

    rows = spark.range(0, 3000, 1, 7).select("id", F.concat(F.lit("text "), F.col("id") % 1000).alias("text"))
    path = str(tmp_path / "seen")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would put so few rows into one task
    for start in (0, 0, 500):
        first_seen.append(rows.where(F.col("id") >= start), path, F.col("text"), "id", folders=16)
        first_seen.append(rows.withColumn("text", F.concat("text", F.lit(f" {start}"))), path, F.col("text"), "id", folders=16)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = first_seen.read(spark, path).select("id", "text").collect()
    assert len(got) == len({r.text for r in got}) == 3000 and max(r.id for r in got) == 999
    assert len(glob.glob(f"{path}/*/*.parquet")) <= 16 * 3


def test_heads_are_those_of_the_whole_collapsed_text(spark):
    from pyspark.sql import functions as F

    from colloquy.functions import text as T

    texts = [None, "", " ", "a", " a  b ", "a" * 50, "a b" * 20, " " * 39 + "x" * 30, " " * 41 + "x y  z" * 9, "x" + " " * 38 + "y" + " " * 5 + "z" * 20, "ab\u3000\u3000" * 30, "x" * 9 + " " * 60 + "y", "\U0001f600 \u00e9" * 30]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.collapsed_head(F.col("t"), 10).alias("head"), F.substring(T.collapse(F.col("t")), 1, 10).alias("want")).collect():
        assert r.head == r.want, r
