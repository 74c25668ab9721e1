"""Dialogues from cards of characters: a greeting, two or three of five subjects in a keyed order, and a farewell.

A card has name, description, scenario and source; a null or blank scenario gives way to the description, a null source
to "these parts". Cards without a name or a description give no dialogue and take no place under a cap.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keyed
from ..functions import text as T
from .dialogue import bank, made_name
from .mixture import in_turn

SUBJECTS = ["identity", "sale", "quest", "place", "lore"]
GESTURES = ["*nods*", "*looks round*", "*puts the work away*", ""]
#: What a player says, and what is answered; {gesture}, {name}, {origin}, {about}, {scene} and {place} are filled in.
ASKED = {
    "greeting": ["Good morning.", "Hello, is anyone there?", "May I come in?"],
    "identity": ["What is your name?", "Have we met before?"],
    "sale": ["What can I buy here?", "I have coin to spend."],
    "quest": ["Is there work for me?", "Can I be of use?"],
    "place": ["What is this place?", "I am lost. Where is this?"],
    "lore": ["What do people tell here?", "What happened here?"],
    "farewell": ["I must go.", "Until next time."],
}
SAID = {
    "greeting": ["{gesture} Come closer, I am {name}.", "{gesture} You found {name}. Sit down."],
    "identity": ["My name is {name}{origin}. {about}", "{name}{origin}, as they call me. {about}"],
    "sale": ["There are some things here. {scene} Name your price.", "{name} sells to all who pay. {scene}"],
    "quest": ["There is. {scene} Come back when it is done.", "I could use a hand. {scene}"],
    "place": ["This is {place}. {scene}", "You are in {place}, friend. {scene} Take care."],
    "lore": ["What I know is this. {about}", "They tell it so: {scene}"],
    "farewell": ["{gesture} Go well. {name} stays here.", "{gesture} A good road to you."],
}
#: Where renamed characters come from.
ORIGINS = ["Dunmere", "Oster Vale", "the Salt Reach", "Tarn", "Highfold"]


def filled(options: list[str], key: Column, seed: str, parts: dict[str, Column]) -> Column:
    """One of the sentences, with its parts filled in; braces within a part stay as they are."""
    whole = lambda option: F.concat(*(parts[x] if k % 2 else F.lit(x) for k, x in enumerate(re.split(r"{(\w+)}", option))))
    return F.element_at(F.array(*map(whole, options)), (keyed.choice(key, seed, len(options)) + 1).cast("int"))


def dialogues(cards: DataFrame, key: str, variants: int = 2, seed: str = "card") -> DataFrame:
    """Adds variant (from 0) and text: ``variants`` dialogues of each card."""
    rows = cards.where("name IS NOT NULL AND description IS NOT NULL").withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    about, scene = T.strip(F.col("description")), T.strip(F.coalesce("scenario", F.lit("")))
    rows = rows.withColumns({"by_": F.concat_ws("|", F.col(key).cast("string"), "variant"), "about_": about, "scene_": scene})
    rows = rows.withColumns({"said_": T.first_sentence(F.col("about_")), "seen_": F.when(F.col("scene_") != "", T.first_sentence(F.col("scene_")))})
    origin = F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit(" of "), "source")).otherwise("")
    rows = rows.withColumns({"origin_": origin, "scene_part_": F.coalesce("seen_", "said_"), "place_": F.coalesce("source", F.lit("these parts"))})
    by, c = F.col("by_"), F.col
    parts = {"name": c("name"), "origin": c("origin_"), "about": c("said_"), "scene": c("scene_part_"), "place": c("place_")}

    def turn(kind: str) -> Column:
        own = parts | {"gesture": bank(GESTURES, by, f"{seed}-{kind}-gesture")}
        return F.concat(F.lit("### Player:\n"), bank(ASKED[kind], by, f"{seed}-{kind}-asked"), F.lit("\n### NPC:\n"), T.strip(filled(SAID[kind], by, f"{seed}-{kind}-said", own)))

    turns = F.array(*(F.struct(keyed.digest(F.concat_ws("|", by, F.lit(kind)), seed).alias("d"), turn(kind).alias("t")) for kind in SUBJECTS))
    taken = F.slice(F.array_sort(turns), F.lit(1), (2 + keyed.choice(by, f"{seed}-n", 2)).cast("int"))
    system = F.concat(F.lit("You are "), c("name"), F.lit(". Background: "), c("about_"), F.lit(" Current Location: "), c("scene_"), F.lit(" Speak in character."))
    text = F.concat_ws("\n", F.lit("### System:"), T.strip(system), turn("greeting"), F.array_join(F.transform(taken, lambda x: x["t"]), "\n"), turn("farewell"))
    return rows.withColumn("text", F.concat(text, F.lit("\n"))).drop("by_", "about_", "scene_", "said_", "seen_", "origin_", "scene_part_", "place_")


def legacy(cards: DataFrame, key: str, total: int = 30_000, renamed: int = 15_000, variants: int = 2, seed: str = "card") -> DataFrame:
    """kind, place, key, variant, text: up to ``total`` dialogues of cards in a keyed order, then up to ``renamed`` of renamed ones.

    ``place`` is that of the dialogue among its kind. Renamed cards are the first of the same order, with a made-up name
    and another origin, and have one dialogue each.
    """
    order = keyed.digest(F.col(key), f"{seed}-order")
    usable = cards.where("name IS NOT NULL AND description IS NOT NULL").select(key, "name", "description", "scenario", "source")

    def some(kind: str, rows: DataFrame, most: int, each: int, seed: str) -> DataFrame:
        made = dialogues(in_turn(rows, order, -(-most // each), ["name", "description", "scenario", "source"]), key, each, seed)
        made = made.withColumn("place", F.col("place") * each + F.col("variant")).where(F.col("place") < most)
        return made.select(F.lit(kind).alias("kind"), "place", key, "variant", "text")

    other = usable.withColumns({"name": made_name(F.col(key), f"{seed}-other"), "source": bank(ORIGINS, F.col(key), f"{seed}-origin")})
    return some("card", usable, total, variants, seed).unionByName(some("renamed", other, renamed, 1, f"{seed}-other"))
