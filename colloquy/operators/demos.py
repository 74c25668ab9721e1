"""Demonstrations: rows of played episodes as message lists, prompts and texts that fit a context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import conversations as C

# Fixed value. What an observation says about an action that wasn't valid, and about the one taken in its place.
INVALID = r"Your previous output did not contain a valid action\. Defaulted to action: (.*?)\n"
#: Instructions are a small table of rules, collected by environment into one array each.
RULES = "env string, part string, exact boolean, rank int, prompt string"


def instructed(episodes: DataFrame, rules: DataFrame, env: str = "env", task: str = "task", first: str = "first") -> DataFrame:
    """Adds instruction, by the first rule of the environment that the task meets, else its first rule.

    Rules (``RULES``) hold for a part of the lower-cased task (empty: any), or for exactly the task. ``{mission}`` in a
    prompt stands for the mission that the first observation names. An environment without rules is an error.
    """
    one = F.struct("rank", "part", "exact", "prompt")
    dim = rules.groupBy(F.col("env").alias("env_")).agg(F.array_sort(F.collect_list(one)).alias("rules_"))
    fits = lambda r: F.when(r["exact"], r["part"] == F.col(task)).otherwise(F.contains(F.lower(F.coalesce(F.col(task), F.lit(""))), r["part"]))
    found = F.coalesce(F.try_element_at(F.filter("rules_", fits), F.lit(1)), F.try_element_at(F.col("rules_"), F.lit(1)))["prompt"]
    unknown = F.raise_error(F.concat(F.lit("unknown environment "), F.coalesce(F.col(env), F.lit("null"))))
    text = F.replace(found, F.lit("{mission}"), F.coalesce(F.col(first), F.lit("")))
    joined = episodes.join(F.broadcast(dim), F.col(env) == F.col("env_"), "left")
    return joined.withColumn("instruction", F.when(F.col("rules_").isNull(), unknown).otherwise(text)).drop("env_", "rules_")


def observation_text(observation: Column) -> tuple[Column, Column]:
    """The long and the short text of an observation in JSON; empty where they, or the object around them, are missing."""
    get = lambda field: F.coalesce(F.get_json_object(observation, f"$.text.{field}"), F.lit(""))
    return get("long_term_context"), get("short_term_context")


def messages(instruction: Column, past: Column, long: Column, short: Column) -> Column:
    """The message list before an action: the instruction, each past observation with its action, the current one.

    ``past`` is an array of (seen, action).
    """
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    turns = F.transform(past, lambda h: F.array(say("user", F.concat(F.lit("Observation:\n"), h["seen"])), say("assistant", h["action"])))
    parts = F.concat_ws("\n", F.lit("Current Observation:"), F.when(short != "", short), F.when(long != "", long))
    return F.concat(F.array(say("user", instruction)), F.flatten(turns), F.array(say("user", parts)))


def replayed(steps: DataFrame, key: str, order: str, long: str = "long", short: str = "short", action: str = "action", done: str = "done") -> DataFrame:
    """Each action of an episode with its past (seen, action) and the observation before it, up to the first that is done.

    The first step of an episode is its first observation only: its action and its end don't count. A history holds all
    steps before by nature; an episode is a group of steps, not a key that grows with the data.
    """
    w = Window.partitionBy(key).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = steps.withColumn("n_", F.row_number().over(w)).withColumn("long_", F.lag(long).over(w)).withColumn("short_", F.lag(short).over(w))
    rows = rows.withColumn("over_", F.coalesce(F.max(F.col(done) & (F.col("n_") > 1)).over(before), F.lit(False)))
    past = F.collect_list(F.when(F.col("n_") > 1, F.struct(F.col("long_").alias("seen"), F.col(action).cast("string").alias("action")))).over(before)
    rows = rows.withColumn("past", past).where("n_ > 1 AND NOT over_")
    return rows.drop(long, short).withColumnsRenamed({"long_": "long", "short_": "short"}).drop("n_", "over_")


def recovered(observation: Column, action: Column) -> tuple[Column, Column]:
    """Whether an action was valid, and the action that was taken: the one its own observation names if it wasn't."""
    invalid = observation.rlike(INVALID)
    return ~F.coalesce(invalid, F.lit(False)), F.when(invalid, F.regexp_extract(observation, INVALID, 1)).otherwise(action)


def selfplay(steps: DataFrame, key: str, order: str, observation: str = "observation", action: str = "action") -> DataFrame:
    """Valid actions of logged runs, with what was seen and done before.

    A log's row holds the action and the observation after it; before the first row, its own observation stands for
    what was seen. Invalid actions are no targets, but later rows see the action that was taken in their place.
    """
    w = Window.partitionBy(key).orderBy(order)
    valid, used = recovered(F.col(observation), F.col(action))
    seen = F.coalesce(F.lag(observation).over(w), F.col(observation))
    rows = steps.withColumn("valid_", valid).withColumn("used_", used).withColumn("seen", seen)
    past = F.collect_list(F.struct("seen", F.col("used_").alias("action"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("past", past).where("valid_").drop("valid_", "used_")


def fitter(path: str, length: int):
    """A function of a prompt and an action: their text if it fits into ``length`` tokens of a tokenizer, else None.

    An action of ``length`` tokens or more, or a text that is still too long, doesn't fit. Of a longer prompt the last
    tokens stay, and its cue is put back where the cut lost it.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)

    def fit(prompt: str, action: str) -> str | None:
        tail = " " + action.strip()
        room = length - count(tail)
        if room <= 0:
            return None
        ids = tokenizer.encode(prompt, add_special_tokens=False).ids
        if len(ids) > room:
            prompt = tokenizer.decode(ids[-room:], skip_special_tokens=False)
            if not prompt.rstrip().endswith("assistant:"):
                prompt = prompt.rstrip() + "\nassistant:"
        return prompt + tail if count(prompt + tail) <= length else None

    return fit


def row_fitter(path: str, length: int):
    """A function over Arrow batches of (id, prompt, action): text and kept, as ``fitter`` fits them."""

    def run(batches):
        import pyarrow as pa

        fit = fitter(path, length)
        for b in batches:
            texts = [fit(p or "", a or "") for p, a in zip(b.column("prompt").to_pylist(), b.column("action").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string()), pa.array([t is not None for t in texts])], ["id", "text", "kept"])

    return run


def fit_rows(rows: DataFrame, path: str, length: int, key: str = "id", prompt: str = "prompt", action: str = "action") -> DataFrame:
    """id, text and kept of each prompt with its action; rows that don't fit stay, without text, to be counted."""
    return rows.select(F.col(key).cast("string").alias("id"), F.col(prompt).alias("prompt"), F.col(action).alias("action")).mapInArrow(row_fitter(path, length), "id string, text string, kept boolean")


def context_fit(df: DataFrame, instruction: str, observation: str, count, length: int, filler: str = "wait") -> DataFrame:
    """Adds tokens of the instruction and of prompts of one and two turns, and which of them fit into ``length``.

    ``count`` makes a column of a text's number of tokens.
    """
    none = F.array().cast("array<struct<seen:string,action:string>>")
    again = F.array(F.struct(F.col(observation).alias("seen"), F.lit(filler).alias("action")))
    prompt = lambda past: C.flatten(messages(F.col(instruction), past, F.col(observation), F.lit("")))
    out = df.withColumn("n_instruction", count(F.col(instruction))).withColumn("n_one", count(prompt(none))).withColumn("n_two", count(prompt(again)))
    return out.withColumn("fits_one", F.col("n_one") <= length).withColumn("fits_two", F.col("n_two") <= length)
