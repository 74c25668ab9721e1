"""Prompts within a token budget: each step of an episode gathers the turns that its budget can hold, not all before.

The whole prefix before each action is quadratic in an episode. Here each turn's tokens are counted once; a step's
window of turns is then a range of a running sum of tokens, as long as the budget at most. Episodes are dealt out in
blocks of steps, with the last steps of the block before beside them, so one very long episode is read by many tasks.

The tokenizer must begin a token at each line end that starts a message, whatever stands before it, as byte-level
ones do: then the last tokens of a prompt are those of its last turns. Steps of an episode are numbered without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEEN, DID, NOW = "\nuser: Observation:\n", "\nassistant: ", "\nuser: "


def _counted(rows: DataFrame, path: str) -> DataFrame:
    """Adds o_ and a_: tokens of the observation and of the action of a step, as they stand in a history."""
    names = rows.columns

    def run(batches):
        import pyarrow as pa
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        count = lambda lead, texts: pa.array([len(e.ids) for e in tokenizer.encode_batch([lead + (t or "") for t in texts.to_pylist()], add_special_tokens=False)], pa.int64())
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, count(SEEN, b.column("long")), count(DID, b.column("action"))], [*names, "o_", "a_"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", o_ long, a_ long")


def gathered(steps: DataFrame, path: str, length: int, key: str, order: str, instruction: Column, long: str = "long", short: str = "short", action: str = "action", done: str = "done", start: int = 0, block: int | None = None) -> DataFrame:
    """A row for each action up to the first that is done: key, step, instruction, past, whole, long, short, action.

    ``past`` holds (seen, action) of the last turns before, at least ``length`` tokens of them if there are so many;
    ``whole`` says that it holds all turns. As in ``demos.replayed``, the first step (``start``) is an observation only.
    Null texts count as empty, a null end as not done. Steps without key are left out.
    """
    block = block or max(4096, 8 * length)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = steps.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), (F.col(order).cast("long") - start).alias("step"), text(long).alias("long"), text(short).alias("short"), text(action).alias("action"), F.coalesce(done, F.lit(False)).alias("done"), F.coalesce(instruction, F.lit("")).alias("instruction"))
    own = F.floor(F.col("step") / block)
    # Where an episode has ended by a block: a row for each block, dealt out as the steps are.
    ended = rows.groupBy("key", own.alias("block_")).agg(F.min(F.when(F.col("done") & (F.col("step") > 0), F.col("step"))).alias("end_"))
    ended = ended.select("key", "block_", F.min("end_").over(Window.partitionBy("key").orderBy("block_").rowsBetween(Window.unboundedPreceding, 0)).alias("end_"))
    # The last steps of a block also go to the next: as many as a budget of single tokens could reach.
    reach = length + 2
    near = F.col("step") % block >= block - reach
    dealt = _counted(rows, path).withColumn("block_", F.explode(F.when(near, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("key", "block_").orderBy("step")
    seen = dealt.withColumns({"seen_": F.lag("long").over(w), "before_": F.lag("short").over(w), "size_": F.lag("o_").over(w) + F.col("a_")})
    # What is seen before a step, with its action, is the turn that later steps remember.
    turns = seen.withColumn("turn_", F.when(F.col("seen_").isNotNull(), F.struct(F.col("seen_").alias("seen"), F.col("action").alias("action"))))
    summed = turns.withColumns({"last_": F.lag("turn_").over(w), "tokens_": F.coalesce(F.sum("size_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    frame = Window.partitionBy("key", "block_").orderBy("tokens_").rangeBetween(-(length - 1), 0)
    held = summed.withColumn("past", F.collect_list("last_").over(frame)).where((F.col("block_") == own) & (F.col("step") > 0))
    held = held.withColumn("whole", F.size("past") >= F.col("step") - 1)
    kept = held.join(ended, ["key", "block_"]).where(F.col("end_").isNull() | (F.col("step") <= F.col("end_")))
    return kept.select("key", (F.col("step") + start).alias("step"), "instruction", "past", "whole", F.col("seen_").alias("long"), F.col("before_").alias("short"), "action")


def _texts(batch):
    """instruction, text of the turns, whether they are all, the current message with its cue, and the action, of each row."""
    for instruction, past, whole, long, short, action in zip(*(batch.column(c).to_pylist() for c in ("instruction", "past", "whole", "long", "short", "action"))):
        turns = "".join(f"{SEEN}{t['seen']}{DID}{t['action']}" for t in past)
        yield instruction, turns, whole, NOW + "\n".join(["Current Observation:", *[x for x in (short, long) if x]]) + "\nassistant:", action


def fitted(rows: DataFrame, path: str, length: int) -> DataFrame:
    """key, step, text and kept: prompt and action of gathered rows cut to ``length`` tokens, as ``demos.fit_rows`` does."""
    from .demos import fitter

    def run(batches):
        import pyarrow as pa

        fit = fitter(path, length)
        for b in batches:
            texts = [fit((f"user: {instruction}" if whole else "") + turns + now, action) for instruction, turns, whole, now, action in _texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("step"), pa.array(texts, pa.string()), pa.array([t is not None for t in texts])], ["key", "step", "text", "kept"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, step long, text string, kept boolean")


def with_instruction(rows: DataFrame, path: str, length: int) -> DataFrame:
    """key, step and ids: the instruction's tokens, and of the rest as many of the last as still fit into ``length``.

    An instruction of ``length`` tokens or more leaves only its own last ones.
    """

    def run(batches):
        import pyarrow as pa
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
        known: dict = {}
        for b in batches:
            out = []
            for instruction, turns, _, now, _ in _texts(b):
                if instruction not in known:
                    known = {instruction: encode(f"user: {instruction}")}
                head = known[instruction]
                room = length - len(head)
                out.append(head + encode((turns + now)[1:])[-room:] if room > 0 else head[-length:])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("step"), pa.array(out, pa.list_(pa.int32()))], ["key", "step", "ids"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, step long, ids array<int>")
