"""Dialogues of cards on hand-made rows, and packed numbers against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import cards, mixture, numeric

CARD = "key long, name string, description string, scenario string, source string"


def turns(text):
    assert text.startswith("### System:\n") and text.endswith("\n")
    return [block.split("\n", 1) for block in text.rstrip("\n").split("### ")[1:]]


@pytest.fixture(scope="module")
def many(spark):
    return spark.createDataFrame([(i, f"Ada{i}", " A smith of {name} who has worked here since the flood. And more. ", None if i % 2 else "\tThe forge is cold and the road is closed today! Ask.", [None, "", "Tarn"][i % 3]) for i in range(60)], CARD)


def test_dialogues_have_two_or_three_subjects(many):
    rows = cards.dialogues(many, "key", 2).collect()
    assert len(rows) == 120 and len({(r.key, r.variant) for r in rows}) == 120
    asked = {a: k for k, options in cards.ASKED.items() for a in options}
    sizes, orders = set(), set()
    about, scene = "A smith of {name} who has worked here since the flood.", "The forge is cold and the road is closed today!"
    for r in rows:
        (head, system), *said = turns(r.text)
        assert head == "System:" and system.strip() == f"You are {r.name}. Background: {r.description.strip()} Current Location: {(r.scenario or '').strip()} Speak in character."
        assert [s[0] for s in said] == ["Player:", "NPC:"] * (len(said) // 2)
        kinds = [asked[s[1].strip()] for s in said[::2]]
        assert kinds[0] == "greeting" and kinds[-1] == "farewell" and len(set(kinds)) == len(kinds) and set(kinds[1:-1]) <= set(cards.SUBJECTS)
        sizes.add(len(kinds) - 2)
        orders.add(tuple(kinds[1:-1]))
        for kind, (_, answer) in zip(kinds, said[1::2]):
            answer = answer.removesuffix("\n")
            assert answer == answer.strip() and "{about}" not in answer and "{scene}" not in answer
            want = about if r.scenario is None else scene
            if kind == "identity":
                assert about in answer and (f"{r.name} of Tarn" in answer) == (r.source == "Tarn")
            elif kind in ("sale", "quest"):
                assert want in answer
            elif kind == "place":
                assert want in answer and {None: "these parts", "Tarn": "Tarn"}.get(r.source, "") in answer
    assert sizes == {2, 3} and len(orders) > 20


def test_caps_and_renamed_cards(spark, many):
    got = cards.legacy(many, "key", total=7, renamed=5).collect()
    first = sorted((r for r in got if r.kind == "card"), key=lambda r: r.place)
    other = sorted((r for r in got if r.kind == "renamed"), key=lambda r: r.place)
    assert [r.place for r in first] == list(range(7)) and [r.variant for r in first] == [0, 1, 0, 1, 0, 1, 0]
    assert [r.place for r in other] == list(range(5)) and [r.key for r in other][:4] == [r.key for r in first][::2]
    assert not any(f"Ada{r.key}." in r.text for r in other)
    again = cards.legacy(many.repartition(7), "key", total=7, renamed=5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    odd = spark.createDataFrame([(1, None, "d", "s", "x"), (2, "n", None, "s", "x"), (3, "n", "", "", "")], CARD)
    assert {(r.kind, r.key) for r in cards.legacy(odd, "key").collect()} == {("card", 3), ("renamed", 3)}
    assert cards.legacy(many.limit(0), "key").count() == 0


def test_in_turn_is_the_head_of_the_order(spark):
    df = spark.range(5000).withColumn("extra", F.lit("x"))
    order = F.md5(F.col("id").cast("string"))
    want = [r.id for r in df.orderBy(order).limit(1234).collect()]
    got = mixture.in_turn(df, order, 1234, ["extra"]).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == want and [r.place for r in sorted(got, key=lambda r: r.place)] == list(range(1234))
    assert mixture.in_turn(df, order, 10_000, []).count() == 5000 and mixture.in_turn(df.limit(0), order, 3, []).count() == 0


def test_ragged_rows_pack_as_numpy_packs_them(spark):
    rng = np.random.default_rng(5)
    given = {i: (rng.normal(size=n) * 10.0 ** rng.integers(-4, 5)).tolist() for i, n in enumerate([1, 2, 3, 4, 5, 7, 8, 9, 12])} | {100: [0.0, 0.0, 0.0], 101: []}
    df = spark.createDataFrame(list(given.items()), "i int, x array<double>")
    rows = df.select("i", numeric.scales(F.col("x"), 4, 4, fp16=True).alias("s"), numeric.packed(numeric.codes(F.col("x"), 4, 4, fp16=True)).alias("p")).collect()
    assert len(rows) == len(given)
    for r in rows:
        x, scales, codes = np.array(given[r.i]), [], []
        for a in range(0, len(x), 4):
            s = float(np.float16(max(np.abs(x[a : a + 4]).max() / 7, 1e-8)))
            scales.append(s)
            codes += [8 + int(np.clip(np.round(v / s), -7, 7)) if s else 8 for v in x[a : a + 4]]
        want = "".join(f"{codes[k] + 16 * (codes[k + 1] if k + 1 < len(codes) else 0):02x}" for k in range(0, len(codes), 2))
        assert (r.s, r.p or "") == (scales, want)
