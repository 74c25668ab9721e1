"""Recorded games as nested JSON: steps of agents' actions, some of which are chat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values. Where a prompt names the role of the one who speaks, and the role of those whose prompt doesn't.
ROLE, NO_ROLE = r'"your_role_name":\s*"([^"]+)"', "Villager"


def chat_turns(games: DataFrame, value: str = "value", action_type: str = "ChatAction") -> DataFrame:
    """The columns of ``games`` but its variant, and step, agent, speaker, role and text of each chat action.

    An agent's step whose action is no object, is of another type, or lacks message or speaker is no turn. Turns are in
    the order of (step, agent). Texts are as they were said, white space included.
    """
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    own = [c for c in games.columns if c != value]
    steps = games.select(*own, F.posexplode(get(value, "$.steps", "array<variant>")).alias("step", "agents_"))
    acts = steps.select(*own, "step", F.posexplode(get("agents_", "$", "array<variant>")).alias("agent", "a_"))
    found = acts.where(get("a_", "$.action.action_type", "string") == action_type)
    prompt = F.coalesce(get("a_", "$.action.kwargs.raw_prompt", "string"), F.lit(""))
    named = F.regexp_extract(prompt, ROLE, 1)
    role = F.when(named != "", named).otherwise(NO_ROLE)
    said = found.select(*own, "step", "agent", get("a_", "$.action.kwargs.actor_id", "string").alias("speaker"), role.alias("role"), get("a_", "$.action.kwargs.message", "string").alias("text"))
    return said.where("speaker <> '' AND text <> ''")
