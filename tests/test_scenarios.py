"""Scenarios of a keeper's shop on hand-made rows: what is said, and the action that ends it."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import dialogue as D

ITEMS = "trade string, item string, price double, property string, provenance string, stock int, origin string"


def spoken(text):
    return text.rstrip("\n").split("\n")


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(400).select(F.col("id").alias("key"), F.lit("smith").alias("trade"), F.lit("Mara").alias("keeper"), F.lit(1.0).alias("markup"), (F.col("id") % 2 * 5 + 4).alias("level"), F.lit(1.0).alias("demand"), F.lit("Karhold").alias("place"))


def test_sales(spark, many):
    """Levels 4 and 9 alone set the markup of 0.97 and 1.12; one other item is there to be listed."""
    items = spark.createDataFrame([("smith", "axe", 100.0, "a sharp edge", "made in Dun", 2, "Dun"), ("smith", "saw", 50.0, "fine teeth", "made in Tor", 1, "Tor")], ITEMS)
    rows = D.sale(many, items, "key").collect()
    assert len(rows) == 400 and {r.kind for r in rows} == {"buy", "haggle", "talk"}
    declines = set()
    for r in rows:
        lines, star = spoken(r.text), r.star.item
        base, markup = (100 if star == "axe" else 50), 1 + 0.03 * (r.level - 5)
        assert r.price == round(base * markup) and lines[:2] == ["Mara's Description: a keeper of a shop.", "<START>"] and lines[3] == "Player: What do you have for sale?"
        other, rest = ("saw", 50) if star == "axe" else ("axe", 100)
        listed = f"{star}, {r.price} gold -- {'a sharp edge' if star == 'axe' else 'fine teeth'}. There is also {other} at {round(rest * markup)} gold"
        assert (listed in lines[4]) != (f"{'A sharp edge' if star == 'axe' else 'Fine teeth'}." in lines[4])
        if r.kind == "buy":
            assert lines[5] == f"Player: I'll take the {star}." and lines[-1] == r.oracle == f"[DEAL: {star} {r.price}]"
        elif r.kind == "talk":
            assert lines[5] == f"Player: Tell me about the {star}." and r.oracle is None and lines[-1].endswith(f"It is {r.price} gold.")
        elif r.oracle:
            floor = round(base * min(0.97, 0.85 + 0.01 * r.level) * markup)
            assert floor <= r.offer and lines[5] == f"Player: {r.offer} gold, final offer." and lines[-1] == f"[DEAL: {star} {r.offer}]"
        else:
            assert lines[5] == f"Player: How about {r.offer} gold?" and f"{r.price} gold" in lines[-1]
            declines.add((r.level >= 7, lines[-1].startswith("Mara: I have sold such things longer")))
    assert declines == {(True, True), (False, False)}
    alone = D.sale(many, items.where("item = 'axe'"), "key").collect()
    assert not any("There is also" in r.text for r in alone) and D.sale(many, items.limit(0), "key").count() == 0


def test_errands(spark, many):
    items = spark.createDataFrame([("smith", "axe", 100.0, "p", "q", 0, "Dun"), ("smith", "saw", 55.0, "p", "q", 6, "Tor"), ("smith", "nail", 5.0, "p", "q", 5, "Tor")], ITEMS)
    rows = many.withColumn("reason", F.when(F.col("key") % 2 == 0, "the pass is shut")).withColumn("rumor", F.lit("iRON is dear")).withColumn("lineage", F.when(F.col("key") % 2 == 0, "of the Osters"))
    found = {}
    for r in D.errand_text(D.errands(rows, items, "key"), "key").collect():
        lines = spoken(r.text)
        found.setdefault(r.kind, []).append((r, lines))
        assert lines[-1] == r.oracle if r.oracle else not lines[-1].startswith("[")
        assert r.text.endswith("\n") and lines[1].startswith("Scenario: Mara's shop") and lines[2] == "<START>"
    for r, lines in found["missing"]:
        assert lines[4] == "Player: Do you have axe?" and r.oracle in (None, "[GOTO: Karhold]")
        assert (lines[5] == "Mara: That I do not have, not today -- the pass is shut.") == (r.key % 2 == 0)
        assert ("Karhold" in lines[7]) == bool(r.oracle)
    assert {bool(r.oracle) for r, _ in found["missing"]} == {True, False}
    for r, lines in found["restock"]:
        assert r.oracle == "[GOTO: Dun]" and "axe" in lines[5] and "Dun" in lines[5] and "130 gold" in lines[5]
    for r, lines in found["turn_in"]:
        assert lines[1] == "Scenario: Mara's shop, you carry: axe." and r.oracle == "[BUY: axe 130]" and "130 gold" in lines[-2]
    sold = {(r.wanted, r.oracle) for r, _ in found["player_sell"]}
    assert sold <= {("axe", "[BUY: axe 60]"), ("axe", None), ("saw", None), ("nail", "[BUY: nail 3]"), ("nail", None)} and ("saw", None) in sold and ("axe", "[BUY: axe 60]") in sold
    talks = found["small_talk"]
    assert all("IRON is dear" in lines[-1] and r.oracle is None for r, lines in talks)
    assert {lines[3] for r, lines in talks if r.key % 2} == {"Mara: Good day. Mind the step."}
    assert {lines[3] for r, lines in talks if r.key % 2 == 0} == {"Mara: Good day. Mind the step.", "Mara: Good day. Of the Osters, for what that is worth."}
    full = D.errands(rows, items.where("stock > 0"), "key").collect()
    assert {r.kind for r in full} == {"player_sell", "small_talk"}
