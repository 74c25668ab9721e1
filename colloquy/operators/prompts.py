"""Prompts made of cards, personas and scenarios, pools of them, and the choice of the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import keyed
from ..functions import text as T

START = "<START>\n"


def card_parts(card: Column) -> tuple[Column, Column, Column]:
    """header, name and first line of a card, split once at its start mark; null without one."""
    at = F.instr(card, START)
    header = F.when(at > 0, F.substring(card, F.lit(1), at - 1))
    rest = F.when(at > 0, F.substring(card, at + len(START), F.length(card)))
    return header, F.substring_index(rest, ":", 1), F.substring_index(rest, "\n", 1)


def card_prompts(cards: DataFrame, questions: list[str], key: str, card: str = "card", n: int = 2, seed: int = 13) -> DataFrame:
    """For each card ``n`` of the questions, drawn by its key: question, prompt and what is known (header and name).

    The header ends in a line end already, so an empty line stands before the start mark.
    """
    header, name, first = card_parts(F.col(card))
    drawn = F.slice(F.array_sort(F.array(*(F.struct(keyed.digest(F.concat_ws("|", key, F.lit(i)), seed).alias("d"), F.lit(q).alias("q")) for i, q in enumerate(questions)))), 1, n)
    rows = cards.withColumn("h_", header).withColumn("n_", name).withColumn("f_", first).where("h_ IS NOT NULL")
    rows = rows.withColumn("question", F.explode(F.transform(drawn, lambda x: x["q"])))
    prompt = F.concat("h_", F.lit("\n<START>\n"), "f_", F.lit("\nPlayer: "), "question", F.lit("\n"), "n_", F.lit(":"))
    return rows.withColumn("prompt", prompt).withColumn("known", F.concat("h_", F.lit("\n"), "n_")).drop("h_", "n_", "f_")


def persona_questions(personas: DataFrame, questions: list[str], bio: str = "bio", unseen: Column | None = None) -> DataFrame:
    """Each persona with each question of a short list; personas not ``unseen`` in training stand as they are."""
    text = F.col(bio) if unseen is None else F.when(unseen, F.concat(F.lit("You are an NPC. "), F.col(bio))).otherwise(F.col(bio))
    return personas.withColumn("prompt", text).withColumn("question", F.explode(T.strings(questions)))


def role_prompts(texts: DataFrame, key: str, text: str = "text", n: int = 100, seed: int = 11) -> DataFrame:
    """Of ``n`` texts in role blocks, drawn by key, the part before the first player's turn, and that turn."""
    drawn = texts.where(F.contains(text, F.lit("### Player:"))).orderBy(keyed.digest(F.col(key), seed), key).limit(n)
    system = F.substring_index(text, "### Player:", 1)
    rest = F.substring(text, F.length(system) + len("### Player:") + 1, F.length(text))
    prompt = F.when(F.endswith(system, F.lit("\n")), system).otherwise(F.concat(system, F.lit("### System:\n")))
    return drawn.withColumn("prompt", prompt).withColumn("question", F.regexp_replace(F.substring_index(rest, "### NPC:", 1), r"^\s+|\s+$", ""))


def scenario_of(conversation: Column) -> Column:
    """prompt, oracle and keeper: a conversation cut after its last player's line, and the first action from there on.

    Null without a start mark or a player's line.
    """

    def cut(header, keeper, w):
        last = F.array_max(F.transform(w, lambda x, i: F.when((i > 0) & F.startswith(x, F.lit("Player:")), i)))
        made = lambda at: F.struct(
            F.concat(header, F.lit(START), F.array_join(F.slice(w, F.lit(1), at + 1), "\n"), F.lit("\n"), keeper, F.lit(":")).alias("prompt"),
            F.try_element_at(F.filter(F.slice(w, at + 1, F.size(w)), lambda x: F.startswith(x, F.lit("["))), F.lit(1)).alias("oracle"),
            keeper.alias("keeper"),
        )
        return T.let(last, lambda at: F.when(at.isNotNull(), made(at)))

    def parts(c):
        header, keeper, _ = card_parts(c)
        lines = F.split(F.substring(c, F.instr(c, START) + len(START), F.length(c)), "\n")
        return T.let(F.struct(header.alias("h"), keeper.alias("k"), lines.alias("w")), lambda x: F.when(x["h"].isNotNull(), cut(x["h"], x["k"], x["w"])))

    return T.let(conversation, parts)


def scenarios(conversations: DataFrame, text: str = "text") -> DataFrame:
    """Conversations with prompt, oracle and keeper in the text's place; those that make no scenario are left out."""
    keep = [c for c in conversations.columns if c != text]
    return conversations.select(*keep, F.inline(F.array_compact(F.array(scenario_of(F.col(text))))))


def scenario_prompts(scenarios: DataFrame, order: str, n: int, prompt: str = "prompt", keeper: str = "keeper") -> DataFrame:
    """The first ``n`` scenarios with question (of the last player's line) and bio."""
    bio = F.concat(F.substring_index(prompt, "<START>", 1), F.lit("\n"), keeper)
    return scenarios.orderBy(order).limit(n).withColumn("question", T.last_line_after(F.col(prompt), "Player: ")).withColumn("bio", bio)


def pool(personas: DataFrame, scenarios: DataFrame, order: str, n: int) -> DataFrame:
    """Prompts of personas, then those of scenarios, of which the first ``n`` stay: place, prompt, question, bio, oracle."""
    cols = ["prompt", "question", "bio", "oracle", order]
    both = personas.withColumn("oracle", F.lit(None).cast("string")).select(F.lit(0).alias("part"), *cols).union(scenarios.select(F.lit(1), *cols))
    few = both.orderBy("part", order, "question").limit(n)
    return few.withColumn("place", F.row_number().over(Window.orderBy("part", order, "question")) - 1).drop("part")  # at most n rows


def curriculum(steps: DataFrame, prompts: DataFrame, step: str = "step", place: str = "place", oracle_turn: int = 3, seed: int = 7) -> DataFrame:
    """The prompt of each step: of those in the learning zone or fresh (else of all), by turns of those with an oracle.

    ``prompts`` holds place, attempts, passes and oracle, and is a pool: its size is the pool's limit.
    """
    rate = F.col("passes") / F.col("attempts")
    zone = (F.col("attempts") < 2) | rate.between(0.15, 0.85)
    kinds = F.array(F.lit("all"), F.when(zone, F.lit("zone")), F.when(F.col("oracle").isNotNull(), F.lit("oracle")))
    listed = prompts.select(place, F.explode(F.array_compact(kinds)).alias("kind"))
    listed = listed.withColumn("index", (F.row_number().over(Window.partitionBy("kind").orderBy(place)) - 1).cast("bigint"))
    n = listed.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("all", "zone", "oracle")))
    turn = (F.col(step) % oracle_turn == 0) & (F.col("oracle") > 0)
    kind = F.when(turn, "oracle").when(F.col("zone") > 0, "zone").otherwise("all")
    size = F.when(turn, F.col("oracle")).when(F.col("zone") > 0, F.col("zone")).otherwise(F.col("all"))
    drawn = steps.join(F.broadcast(n)).where("all > 0").withColumn("kind", kind).withColumn("index", keyed.choice(F.col(step), seed, size))
    return drawn.join(F.broadcast(listed), ["kind", "index"]).select(step, "kind", place)


def asked_lines(card: Column) -> Column:
    """question, gold and other of a card: its first player's line with an answer, that answer, and the next such answer.

    An answer is a line right after a player's line that isn't one itself.
    """
    header, _, _ = card_parts(card)
    lines = F.split(F.substring(card, F.length(header) + len(START) + 1, F.length(card)), "\n")
    strip = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    player = lambda x: F.startswith(x, F.lit("Player:"))

    def answered(w):
        pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.filter(pairs, lambda p: player(p["a"]) & ~player(p["b"]))

    said = lambda b: strip(F.regexp_replace(b, r"(?s)^[^:]*:", ""))
    get = lambda p, i: F.try_element_at(p, F.lit(i))
    made = lambda p: F.struct(said(get(p, 1)["a"]).alias("question"), said(get(p, 1)["b"]).alias("gold"), said(get(p, 2)["b"]).alias("other"))
    return F.when(header.isNotNull(), T.let(T.let(lines, answered), made))
