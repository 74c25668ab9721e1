"""Conversations: from turns in rows to rendered cards, windows and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def gather(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row a conversation, its turns (turn, role, text) in order."""
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("turn"), "role", "text"))).alias("turns"))


def system_and_turns(turns: Column) -> tuple[Column, Column]:
    """The last system text, or the first user text in roleplay mode; and the turns besides."""
    system = F.filter(turns, lambda t: t["role"] == "system")
    said = F.filter(turns, lambda t: (t["role"] == "user") & F.contains(F.lower(t["text"]), F.lit("roleplay mode")))
    text = F.coalesce(F.try_element_at(system, F.lit(-1))["text"], F.try_element_at(said, F.lit(1))["text"])
    rest = F.filter(turns, lambda t: (t["role"] != "system") & ~((t["role"] == "user") & F.contains(F.lower(t["text"]), F.lit("roleplay mode"))))
    return text, rest


def render_card(turns: Column) -> Column:
    """A card with its conversation; null without system text or turns."""
    system, rest = system_and_turns(turns)
    for head in ("Roleplaying Instructions:", "Roleplay Instructions:"):
        system = F.when(F.instr(system, head) > 1, F.regexp_replace(F.substring(system, F.lit(1), F.instr(system, head) - 1), r"[ .\n]+$", "")).otherwise(system)
    name = T.persona_name(system)
    lines = F.transform(rest, lambda t: F.concat(F.when(t["role"] == "assistant", name).otherwise("Player"), F.lit(": "), T.strip(t["text"])))
    return F.when((F.coalesce(system, F.lit("")) != "") & (F.size(rest) > 0), F.concat(name, F.lit("'s Description: "), system, F.lit("\n<START>\n"), F.array_join(lines, "\n")))


def render_roles(turns: Column) -> Column:
    """### System, ### Player and ### NPC blocks, closed by a line end."""
    system, rest = system_and_turns(turns)
    head = F.when(system.isNotNull(), F.concat(F.lit("### System:\n"), T.strip(system)))
    body = F.transform(rest, lambda t: F.concat(F.when(t["role"] == "assistant", "### NPC:\n").otherwise("### Player:\n"), T.strip(t["text"])))
    return F.concat(F.concat_ws("\n", head, F.array_join(body, "\n")), F.lit("\n"))


def flatten(turns: Column) -> Column:
    """role: text lines, and the assistant's turn to speak."""
    return F.concat(F.array_join(F.transform(turns, lambda t: F.concat(F.coalesce(t["role"], F.lit("user")), F.lit(": "), t["text"])), "\n"), F.lit("\nassistant:"))


def block_text(content: Column) -> Column:
    """The text of a message whose content is a list of blocks (type, text): their texts with spaces between, null as empty."""
    return F.array_join(F.transform(F.coalesce(content, F.array().cast("array<struct<type:string,text:string>>")), lambda b: F.coalesce(b["text"], F.lit(""))), " ")


def lead_in(turns: DataFrame, before: int = 3, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Adds lead_in: up to ``before`` turns before each."""
    frame = Window.partitionBy(key).orderBy(order).rowsBetween(-before, -1)
    return turns.withColumn("lead_in", F.array_join(F.transform(F.collect_list(F.struct("role", "text")).over(frame), lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n"))


def history(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Adds history, all turns before each (quadratic in a conversation by nature), and the text before."""
    w = Window.partitionBy(key).orderBy(order)
    past = F.collect_list(F.struct("role", "text")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return turns.withColumn("history", F.array_join(F.transform(past, lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")).withColumn("seen", F.lag("text").over(w))


def questions(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Assistant turns with the turn before as their question."""
    return turns.withColumn("question", F.lag("text").over(Window.partitionBy(key).orderBy(order))).where("role = 'assistant' AND question IS NOT NULL")


def left_truncate(words: Column, budget: int) -> Column:
    """The last ``budget`` of a prompt's tokens."""
    return F.slice(words, F.greatest(F.lit(1), F.size(words) - budget + 1), budget)


def keep_instruction(first: Column, rest: Column, budget: int) -> Column:
    """The instruction whole and as much of the end as fits; of a longer instruction its own end."""
    room = F.greatest(F.lit(budget) - F.size(first), F.lit(0))
    tail = F.slice(rest, F.greatest(F.lit(1), F.size(rest) - room + 1), room)
    return F.when(F.size(first) >= budget, left_truncate(first, budget)).otherwise(F.concat(first, tail))


def game_cards(turns: DataFrame, description: Column, scenario: Column, speaker: str = "speaker", text: str = "text", key: str = "game", order: str = "turn", limit: int = 400, least: int = 16, trim=T.strip, trim_end=T.strip_right) -> DataFrame:
    """A card for each turn of a game in language, with up to three turns before it as they were trimmed.

    Turns are trimmed by ``trim`` and cut at a sentence, or closed after ``trim_end``; shorter ones than ``least`` make no card but still lead in to later ones. Turns
    without text or speaker are no turns.
    """
    said = turns.where((F.col(text) != "") & (F.col(speaker) != "")).withColumn("line_", F.concat(F.col(speaker), F.lit(": "), T.truncate_at_sentence(trim(F.col(text)), limit, trim_end)))
    before = F.collect_list("line_").over(Window.partitionBy(key).orderBy(order).rowsBetween(-3, -1))
    head = [F.concat(F.lit("Description: "), description), F.concat(F.lit("Scenario: "), scenario), F.lit("<START>")]
    card = F.concat(F.array_join(F.concat(F.array(*head), F.col("before_"), F.array("line_")), "\n"), F.lit("\n"))
    long = F.length("line_") - F.length(F.col(speaker)) - 2 >= least
    return said.withColumn("before_", before).where(long).withColumn("card", card).drop("before_", "line_")


def move_lines(moves: DataFrame, title: Column, move: Column, least: int = 3) -> DataFrame:
    """Adds line, the continuation of a move log; moves shorter than ``least`` are left out."""
    return moves.where(F.length(move) >= least).withColumn("line", F.concat(title, F.lit(": the position calls for "), move, F.lit(".\n")))
