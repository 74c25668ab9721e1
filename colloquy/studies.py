"""Queries of demonstrations, prompts, scenarios and results, each over whole tables, with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .functions import keyed, values
from .functions import text as T
from .operators import conversations as C
from .operators import cards, demos, dialogue, experiments, grading, numeric, prompts, scenarios, tokens
from .queries import _REST, _SYSTEM, _TURNS, _WORDS, _list, _sql_any, _t, query

# Demonstrations

_RULES = [
    ("maze", "corridor", False, 0, "Reach the stairs."),
    ("maze", "quest", False, 1, "Fight and explore."),
    ("maze", "", False, 2, "Go as far as you can."),
    ("house", "COPPER", True, 0, "Find the copper."),
    ("house", "TIN", True, 1, "Find the tin."),
    ("grid", "", False, 0, "Your mission: {mission}."),
]


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN contains(lower(t), 'corridor') THEN 'Reach the stairs.' WHEN contains(lower(t), 'quest') THEN 'Fight and explore.' ELSE 'Go as far as you can.' END
    WHEN 1 THEN CASE WHEN t = 'TIN' THEN 'Find the tin.' ELSE 'Find the copper.' END ELSE 'Your mission: ' || p_name || '.' END AS instruction
    FROM (SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 1 THEN string_split(p_type, ' ')[-1] ELSE ['Corridor-R2', 'KeyQuest', 'Room', 'corridor quest'][1 + p_size % 4] END AS t FROM part)""")
def instruction_dispatch(spark, sf):
    """Instructions by environment and task."""
    k = F.col("p_partkey") % 3
    task = F.when(k == 1, F.substring_index("p_type", " ", -1)).otherwise(F.element_at(T.strings(["Corridor-R2", "KeyQuest", "Room", "corridor quest"]), (F.col("p_size") % 4 + 1).cast("int")))
    env = F.element_at(T.strings(["maze", "house", "grid"]), (k + 1).cast("int"))
    rows = _t(spark, sf, "part").select("p_partkey", env.alias("env"), task.alias("task"), F.col("p_name").alias("first"))
    return demos.instructed(rows, spark.createDataFrame(_RULES, demos.RULES)).select("p_partkey", "instruction")


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text ELSE '' END AS long, CASE turn % 4 WHEN 0 THEN role WHEN 1 THEN role ELSE '' END AS short FROM conversations""")
def observation_text(spark, sf):
    """Observations in full, with the short text only, with no object of texts, and missing."""
    full = F.to_json(F.struct(F.struct(F.col("text").alias("long_term_context"), F.col("role").alias("short_term_context")).alias("text")))
    part = F.to_json(F.struct(F.struct(F.col("role").alias("short_term_context")).alias("text")))
    k = F.col("turn") % 4
    long, short = demos.observation_text(F.when(k == 0, full).when(k == 1, part).when(k == 2, F.to_json(F.struct("text"))))
    return _t(spark, sf, "conversations").select("conv_id", "turn", long.alias("long"), short.alias("short"))


def _steps(spark, sf):
    cols = ["conv_id", "turn", "text AS long", "CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS short", "concat('step ', turn) AS action", "length(text) % 5 = 0 AS done"]
    return _t(spark, sf, "conversations").selectExpr(*cols)


_STEPS = """s AS (SELECT conv_id, turn, text AS long, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS short, 'step ' || turn AS action, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, length(text) % 5 = 0 AS done FROM conversations),
    r AS (SELECT *, lag(long) OVER (PARTITION BY conv_id ORDER BY turn) AS l, lag(short) OVER (PARTITION BY conv_id ORDER BY turn) AS sh, coalesce(sum((done AND n > 1)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM s),
    p AS (SELECT *, coalesce(list('user: Observation:' || chr(10) || l || chr(10) || 'assistant: ' || action) FILTER (n > 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS past FROM r),
    d AS (SELECT conv_id, turn, action, array_to_string(list_concat(['user: Play well.'], past, ['user: Current Observation:' || CASE WHEN sh <> '' THEN chr(10) || sh ELSE '' END || CASE WHEN l <> '' THEN chr(10) || l ELSE '' END, 'assistant:']), chr(10)) AS prompt FROM p WHERE n > 1 AND over_ = 0)"""


def _demos(spark, sf):
    rows = demos.replayed(_steps(spark, sf), "conv_id", "turn")
    return rows.select("conv_id", "turn", "action", C.flatten(demos.messages(F.lit("Play well."), F.col("past"), F.col("long"), F.col("short"))).alias("prompt"))


@query(f"WITH {_STEPS} SELECT conv_id, turn, action, prompt FROM d")
def demo_prompts(spark, sf):
    """Conversations replayed as episodes; the prompt before each action."""
    return _demos(spark, sf)


@query(rf"""WITH o AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'Your previous output did not contain a valid action. Defaulted to action: wait ' || turn || chr(10) || text ELSE text END AS obs, 'go ' || role AS act FROM conversations),
    r AS (SELECT *, turn % 3 = 1 AS bad, coalesce(lag(obs) OVER (PARTITION BY conv_id ORDER BY turn), obs) AS seen FROM o),
    p AS (SELECT *, coalesce(list(seen || ' -> ' || CASE WHEN bad THEN 'wait ' || turn ELSE act END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS past FROM r)
    SELECT conv_id, turn, act, seen, past FROM p WHERE NOT bad""")
def selfplay_history(spark, sf):
    """Rows whose observation marks the action as invalid are no targets; the action taken stands in later histories."""
    marked = F.concat(F.lit("Your previous output did not contain a valid action. Defaulted to action: wait "), F.col("turn").cast("string"), F.lit("\n"), "text")
    rows = _t(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, marked).otherwise(F.col("text")).alias("obs"), F.concat(F.lit("go "), "role").alias("act"))
    return demos.selfplay(rows, "conv_id", "turn", "obs", "act").select("conv_id", "turn", "act", "seen", F.transform("past", lambda h: F.concat(h["seen"], F.lit(" -> "), h["action"])).alias("past"))


@query()
def demo_rows(spark, sf):
    """Prompts and actions that fit into 256 tokens of a tokenizer; held against it in the tests."""
    import public_tokenizers

    return demos.fit_rows(_demos(spark, sf).withColumn("id", F.concat_ws("|", "conv_id", "turn")), public_tokenizers.path("byte_bpe_50k.json"), 256)


_N = "len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda x: x <> ''))::BIGINT"


@query(f"""WITH p AS (SELECT conv_id, turn, 'user: Play well.' || chr(10) AS i, 'user: Current Observation:' || CASE WHEN text <> '' THEN chr(10) || text ELSE '' END || chr(10) || 'assistant:' AS c,
    'user: Observation:' || chr(10) || text || chr(10) || 'assistant: wait' || chr(10) AS h FROM conversations),
    n AS (SELECT conv_id, turn, 2::BIGINT AS n_instruction, {_N.format(t='i || c')} AS n_one, {_N.format(t='i || h || c')} AS n_two FROM p)
    SELECT *, n_one <= 40 AS fits_one, n_two <= 40 AS fits_two FROM n""")
def context_fit(spark, sf):
    """G11, by words."""
    rows = _t(spark, sf, "conversations").select("conv_id", "turn", "text", F.lit("Play well.").alias("i"))
    return demos.context_fit(rows, "i", "text", lambda c: F.size(T.words(c)).cast("bigint"), 40).drop("text", "i")


# Prompts

_CARDS = rf"""c AS ({_TURNS}), cs AS (SELECT conv_id, {_SYSTEM}[-1].text AS s, {_REST} AS r FROM c), nm AS (
    SELECT *, coalesce(nullif(regexp_extract(s, 'You are ([A-Z][^.,]{{1,40}}?)[.,]', 1), ''), nullif(regexp_extract(s, 'Background: ([A-Z][^.,]{{1,40}}?) (?:is|was)', 1), ''), 'NPC') AS name FROM cs),
    cards AS (SELECT conv_id, name, name || '''s Description: ' || s || chr(10) AS header, list_transform(r, lambda t: CASE WHEN t.role = 'assistant' THEN name ELSE 'Player' END || ': ' || trim(t.text)) AS body FROM nm WHERE coalesce(s, '') <> '' AND len(r) > 0)"""


def _cards(spark, sf):
    """Cards made once each: a generator isn't folded into what uses them."""
    return C.gather(_t(spark, sf, "conversations")).select("conv_id", F.explode(F.array_compact(F.array(C.render_card(F.col("turns"))))).alias("card"))


_ASKED = list(values.QUESTIONS)


@query(f"""WITH {_CARDS}, q AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{q}')" for i, q in enumerate(_ASKED))}) AS v(i, question)),
    d AS (SELECT *, string_split(array_to_string(body, chr(10)), ':')[1] AS first_name, string_split(array_to_string(body, chr(10)), chr(10))[1] AS first_line FROM cards, q QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY {keyed.sql_digest("conv_id || '|' || i", 13)}, question) <= 2)
    SELECT conv_id, question, header || chr(10) || '<START>' || chr(10) || first_line || chr(10) || 'Player: ' || question || chr(10) || first_name || ':' AS prompt, header || chr(10) || first_name AS known FROM d""")
def card_prompts(spark, sf):
    """Two questions for each card."""
    return prompts.card_prompts(_cards(spark, sf), _ASKED, "conv_id").select("conv_id", "question", "prompt", "known")


@query(f"""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'You are an NPC. ' ELSE '' END || s_name || ' trades here.' AS prompt, question FROM supplier, (VALUES {", ".join(f"('{q}')" for q in _ASKED)}) AS v(question)""")
def persona_questions(spark, sf):
    """Personas and questions; the questions are a short list, so nothing is joined."""
    rows = _t(spark, sf, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" trades here.")).alias("bio"))
    return prompts.persona_questions(rows, _ASKED, unseen=F.col("s_suppkey") % 4 == 0).select("s_suppkey", "prompt", "question")


@query(rf"""WITH c AS ({_TURNS}), p AS (SELECT conv_id, {_SYSTEM}[-1].text AS s, {_REST} AS r FROM c), t AS (
    SELECT conv_id, CASE WHEN s IS NULL THEN '' ELSE '### System:' || chr(10) || trim(s) || chr(10) END || array_to_string([CASE WHEN t.role = 'assistant' THEN '### NPC:' ELSE '### Player:' END || chr(10) || trim(t.text) FOR t IN r], chr(10)) || chr(10) AS text FROM p),
    d AS (SELECT *, strpos(text, '### Player:') AS place_ FROM t WHERE contains(text, '### Player:') ORDER BY {keyed.sql_digest('conv_id', 11)}, conv_id LIMIT 40)
    SELECT conv_id, substr(text, 1, place_ - 1) || CASE WHEN ends_with(substr(text, 1, place_ - 1), chr(10)) THEN '' ELSE '### System:' || chr(10) END AS prompt,
    regexp_replace(string_split(substr(text, place_ + 11), '### NPC:')[1], '^\s+|\s+$', '', 'g') AS question FROM d""")
def role_prompts(spark, sf):
    """Forty texts in role blocks, drawn by key; the number is the operator's."""
    rows = C.gather(_t(spark, sf, "conversations")).select("conv_id", C.render_roles(F.col("turns")).alias("text"))
    return prompts.role_prompts(rows, "conv_id", n=40).select("conv_id", "prompt", "question")


_ACTED = f"""{_CARDS}, a AS (SELECT conv_id, header, list_concat(list_concat(body, CASE WHEN conv_id % 3 = 0 THEN ['[DEAL: Rope ' || conv_id || ']'] ELSE [] END), ['Player: Farewell.', string_split(body[1], chr(10))[1]]) AS l0 FROM cards),
    l AS (SELECT conv_id, header, string_split(array_to_string(CASE WHEN conv_id % 2 = 0 THEN l0[: len(l0) - 2] ELSE list_append(l0, '[GOTO: Karhold]') END, chr(10)), chr(10)) AS l FROM a),
    x AS (SELECT *, string_split(array_to_string(l, chr(10)), ':')[1] AS keeper, list_max(list_filter(range(2, len(l) + 1), lambda i: starts_with(l[i], 'Player:'))) AS place_ FROM l)"""


def _acted(spark, sf):
    """Cards that go on with an action, a player's farewell, or both."""
    opening = F.substring_index(F.substring_index("card", "<START>\n", -1), "\n", 1)
    rows = _cards(spark, sf)
    body = F.concat("card", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("\n[DEAL: Rope "), F.col("conv_id").cast("string"), F.lit("]"))).otherwise(""))
    long = F.concat(body, F.lit("\nPlayer: Farewell.\n"), opening, F.lit("\n[GOTO: Karhold]"))
    return rows.select("conv_id", F.when(F.col("conv_id") % 2 == 0, body).otherwise(long).alias("text"))


@query(f"""WITH {_ACTED} SELECT conv_id, header || '<START>' || chr(10) || l[1] || chr(10) || array_to_string(l[2 : place_], chr(10)) || chr(10) || keeper || ':' AS prompt, list_filter(l[place_ :], lambda y: starts_with(y, '['))[1] AS oracle, keeper FROM x WHERE place_ IS NOT NULL""")
def scenario_cut(spark, sf):
    """Cards as scenarios, some with an action after their last player's line."""
    return prompts.scenarios(_acted(spark, sf))


_SCENES = f"""{_ACTED}, sc AS (SELECT conv_id, header || '<START>' || chr(10) || l[1] || chr(10) || array_to_string(l[2 : place_], chr(10)) || chr(10) || keeper || ':' AS prompt, list_filter(l[place_ :], lambda y: starts_with(y, '['))[1] AS oracle, keeper,
    header || chr(10) || keeper AS bio, trim(substr(l[place_], 8)) AS q, substr(l[place_], 9) AS question FROM x WHERE place_ IS NOT NULL)"""


@query(f"WITH {_SCENES} SELECT conv_id, prompt, question, bio, oracle FROM sc ORDER BY conv_id LIMIT 200")
def scenario_prompts(spark, sf):
    """P25: the first 200 scenarios, which is the operator's number."""
    rows = prompts.scenarios(_acted(spark, sf))
    return prompts.scenario_prompts(rows, "conv_id", 200).select("conv_id", "prompt", "question", "bio", "oracle")


_POOL = f"""{_SCENES}, pq AS (SELECT 0 AS part, CASE WHEN s_suppkey % 4 = 0 THEN 'You are an NPC. ' ELSE '' END || s_name || ' trades here.' AS prompt, question, s_name || ' trades here.' AS bio, NULL AS oracle, s_suppkey AS k FROM supplier, (VALUES {", ".join(f"('{q}')" for q in _ASKED)}) AS v(question)),
    pool AS (SELECT *, row_number() OVER (ORDER BY part, k, question) - 1 AS place FROM (SELECT * FROM pq UNION ALL SELECT 1, prompt, question, bio, oracle, conv_id FROM (SELECT * FROM sc ORDER BY conv_id LIMIT 200)) ORDER BY part, k, question LIMIT 900)"""


def _pool(spark, sf):
    rows = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.concat("s_name", F.lit(" trades here.")).alias("bio"))
    personas = prompts.persona_questions(rows, _ASKED, unseen=F.col("k") % 4 == 0)
    cut = prompts.scenarios(_acted(spark, sf)).withColumnRenamed("conv_id", "k")
    return prompts.pool(personas, prompts.scenario_prompts(cut, "k", 200), "k", 900)


@query(f"WITH {_POOL} SELECT place, prompt, question, bio, oracle FROM pool")
def prompt_pool(spark, sf):
    """U8: prompts of personas, then of scenarios; the first 900, which is the pool's number."""
    return _pool(spark, sf).select(F.col("place").cast("bigint").alias("place"), "prompt", "question", "bio", "oracle")


@query(f"""WITH {_POOL}, pr AS (SELECT place, oracle, place % 9 AS attempts, place % 4 AS passes FROM pool), kinds AS (
    SELECT 'all' AS kind, place FROM pr UNION ALL SELECT 'zone', place FROM pr WHERE attempts < 2 OR passes / attempts BETWEEN 0.15 AND 0.85 UNION ALL SELECT 'oracle', place FROM pr WHERE oracle IS NOT NULL),
    li AS (SELECT kind, place, row_number() OVER (PARTITION BY kind ORDER BY place) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM kinds),
    st AS (SELECT event_id AS step, CASE WHEN event_id % 3 = 0 AND EXISTS (SELECT 1 FROM kinds WHERE kind = 'oracle') THEN 'oracle' WHEN EXISTS (SELECT 1 FROM kinds WHERE kind = 'zone') THEN 'zone' ELSE 'all' END AS kind FROM events)
    SELECT step, kind, place FROM st JOIN li USING (kind) WHERE i = {keyed.sql_choice('step', 7, 'n')}""")
def curriculum(spark, sf):
    """A prompt for each step (of events) from the learning zone, and every third from those with an oracle."""
    pool = _pool(spark, sf).select(F.col("place").cast("bigint").alias("place"), "oracle").withColumn("attempts", F.col("place") % 9).withColumn("passes", F.col("place") % 4)
    return prompts.curriculum(_t(spark, sf, "events").select(F.col("event_id").alias("step")), pool)


@query(rf"""WITH {_CARDS}, l AS (SELECT conv_id, string_split(array_to_string(body, chr(10)), chr(10)) AS l FROM cards), p AS (SELECT conv_id, l, list_filter(range(1, len(l)), lambda i: starts_with(l[i], 'Player:') AND NOT starts_with(l[i + 1], 'Player:')) AS place_ FROM l),
    s AS (SELECT conv_id, l[place_[1]] AS q, l[place_[1] + 1] AS g, l[place_[2] + 1] AS o FROM p)
    SELECT conv_id, {", ".join(rf"regexp_replace(regexp_replace({c}, '^[^:]*:', ''), '^\s+|\s+$', '', 'g') AS {n}" for c, n in (("q", "question"), ("g", "gold"), ("o", "other")))} FROM s""")
def asked_lines(spark, sf):
    """The first question with its answer, and the next answer as a wrong one."""
    return _cards(spark, sf).select("conv_id", prompts.asked_lines(F.col("card")).alias("a")).select("conv_id", "a.*")


# Scenarios

_ROLLS = """ro AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, CASE l_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '[GOTO: Karhold]' WHEN 2 THEN '[DEAL: ' || p_name || ' ' || price || ']' ELSE '[BUY: ' || p_name || ' ' || price || ']' END AS oracle, l_orderkey % 4 AS k,
    price, quote, act, CASE WHEN l_partkey % 5 = 0 THEN '*nods* ' ELSE '' END || CASE WHEN l_partkey % 3 = 0 THEN 'It costs ' || quote || ' gold today.' ELSE 'No.' END AS said,
    CASE act WHEN 0 THEN NULL WHEN 1 THEN 'GOTO' WHEN 2 THEN 'DEAL' WHEN 3 THEN 'BUY' ELSE '?' END AS verb, CASE act WHEN 1 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'Karhold' ELSE 'Nowhere' END WHEN 0 THEN NULL ELSE p_name END AS arg
    FROM (SELECT *, floor(l_extendedprice)::BIGINT AS price, floor(l_extendedprice * (0.5 + (l_suppkey % 10) / 10.0))::BIGINT AS quote, (l_orderkey + l_linenumber) % 5 AS act FROM lineitem JOIN part ON l_partkey = p_partkey)),
    tx AS (SELECT *, said || CASE act WHEN 0 THEN '' WHEN 1 THEN chr(10) || '[GOTO: ' || arg || ']' WHEN 2 THEN chr(10) || '[DEAL: ' || arg || ' ' || quote || ']' WHEN 3 THEN chr(10) || '[BUY: ' || arg || ' ' || quote || ']' ELSE chr(10) || '[SING: ' || arg || ']' || CASE WHEN l_suppkey % 3 = 0 THEN chr(10) || '[WAIT:]' ELSE '' END END AS said2 FROM ro),
    gr AS (SELECT *, CASE k WHEN 0 THEN 'none' WHEN 1 THEN 'GOTO' WHEN 2 THEN 'DEAL' ELSE 'BUY' END AS kind, act IN (1, 2, 3) AS parses, CASE WHEN act = 4 AND l_suppkey % 3 = 0 THEN 2 WHEN act = 0 THEN 0 ELSE 1 END AS n_actions,
    CASE WHEN k = 0 THEN act IN (0, 4) WHEN k = 1 THEN act = 1 AND arg = 'Karhold' WHEN k = 2 THEN act = 2 AND abs(quote - price) <= 0.3 * price ELSE act = 3 AND abs(quote - price) <= 0.3 * price END AS ok, l_partkey % 3 = 0 AS gold FROM tx),
    ev AS (SELECT g.*, n_actions <= 1 AND (n_actions = 0 OR parses) AS formatted, l_partkey % 5 = 0 AS beats, act <> 0 AS acts, act = 4 OR (act = 1 AND arg <> 'Karhold') OR (act IN (2, 3) AND p_name NOT IN (SELECT p_name FROM part WHERE p_size <= 40)) AS invalid,
    k = 2 AND gold AS quoted, k = 2 AND gold AND abs(quote - price) <= 0.3 * price AS near FROM gr g)"""


def _graded(spark, sf):
    """Scenarios joined with their rollouts by order; an item is the scenario's, a line the rollout's."""
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    part = _t(spark, sf, "part")
    price, quote = F.floor("l_extendedprice").cast("bigint").cast("string"), F.floor(F.col("l_extendedprice") * (0.5 + F.col("l_suppkey") % 10 / 10.0)).cast("bigint").cast("string")
    k, act = F.col("l_orderkey") % 4, (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    tagged = lambda verb, price: F.concat(F.lit(f"[{verb}: "), "p_name", F.lit(" "), price, F.lit("]"))
    oracle = F.when(k == 1, "[GOTO: Karhold]").when(k == 2, tagged("DEAL", price)).when(k == 3, tagged("BUY", price))
    place = F.when(F.col("l_suppkey") % 2 == 0, "\n[GOTO: Karhold]").otherwise("\n[GOTO: Nowhere]")
    sung = F.concat(F.lit("\n[SING: "), "p_name", F.lit("]"), F.when(F.col("l_suppkey") % 3 == 0, "\n[WAIT:]").otherwise(""))
    done = F.when(act == 0, "").when(act == 1, place).when(act == 2, F.concat(F.lit("\n"), tagged("DEAL", quote))).when(act == 3, F.concat(F.lit("\n"), tagged("BUY", quote))).otherwise(sung)
    said = F.concat(F.when(F.col("l_partkey") % 5 == 0, "*nods* ").otherwise(""), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("It costs "), quote, F.lit(" gold today."))).otherwise("No."))
    rolls = li.join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    rolls = rolls.select("l_orderkey", "l_linenumber", "p_name", oracle.alias("oracle"), F.concat(said, done, F.lit("\nPlayer: Well? [GOTO: Karhold]")).alias("text"))
    return scenarios.with_items(scenarios.answers(rolls, places=["Karhold"]), part.where("p_size <= 40").select(F.col("p_name").alias("item")))


@query(f"WITH {_ROLLS} SELECT count(*) AS n, {', '.join(f'count_if({c}) AS {a}' for a, c in (('formatted', 'formatted'), ('beats', 'beats'), ('acts', 'acts'), ('invalid', 'invalid'), ('hits', 'ok'), ('quoted', 'quoted'), ('near', 'near')))} FROM ev")
def scenario_report(spark, sf):
    """A6, G7, J12."""
    return scenarios.report(_graded(spark, sf))


@query(f"WITH {_ROLLS} SELECT kind, count_if(ok) AS hits, count(*) AS total FROM ev GROUP BY kind")
def scenario_kinds(spark, sf):
    """All four kinds."""
    return scenarios.report_by_kind(_graded(spark, sf))


_TAKEN = "n_actions <= 1 AND ok AND length(said) >= 16"


@query(f"WITH {_ROLLS} SELECT l_orderkey, l_linenumber, p_name || ':' || ' ' || said2 || chr(10) || 'Player:' || chr(10) AS text FROM ev WHERE {_TAKEN}")
def accepted_answers(spark, sf):
    """answers to learn from, as conversations."""
    rows = _graded(spark, sf).where(scenarios.accepted()).withColumn("prompt", F.concat("p_name", F.lit(":")))
    return rows.select("l_orderkey", "l_linenumber", scenarios.accepted_text().alias("text"))


@query(f"WITH {_ROLLS} SELECT l_orderkey, oracle, replace(said2, chr(10), ' / ')[1:110] AS said, ok FROM ev ORDER BY l_orderkey, l_linenumber, p_name, said2 LIMIT 6")
def scenario_samples(spark, sf):
    """The first six, as a report shows them."""
    return scenarios.samples(_graded(spark, sf), ["l_orderkey", "l_linenumber", "p_name", "said"]).select("l_orderkey", "oracle", "said", "ok")


@query(rf"""WITH q AS (SELECT * FROM (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS card FROM conversations) WHERE role = 'assistant' AND card IS NOT NULL),
    d AS (SELECT conv_id, turn, text, len([w FOR w IN flatten([[regexp_replace(x, '^[",*#()'']+|[",*#()'']+$', '', 'g') FOR x IN regexp_split_to_array(s, '\s+') IF x <> ''] FOR s IN regexp_split_to_array(text, '[.!?\n]')])
        IF regexp_full_match(w, '[A-Z][a-z]{{2,}}') AND NOT list_contains({_list(values.COMMON)}, w) AND NOT contains(card, w)]) > 0 AS drift FROM q)
    SELECT count(*) AS n, round(avg(drift::INT), 6) AS drift, round(avg((conv_id % 2 = 0 OR {_sql_any("lower(text)", values.INTENTS["sale"])})::INT), 6) AS intent, round(avg((turn % 2 = 0)::INT), 6) AS clean FROM d""")
def probe_rates(spark, sf):
    """A question without keywords meets its intent in any case."""
    rows = C.questions(_t(spark, sf, "conversations"))
    return scenarios.probe_rates(rows, "text", "question", F.when(F.col("conv_id") % 2 != 0, T.has_intent("sale", F.col("text"))), F.col("turn") % 2 == 0)


@query("SELECT DISTINCT p_name AS item, p_type AS trade FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size > 45)")
def item_holders(spark, sf):
    """J2."""
    items = _t(spark, sf, "part").select(F.col("p_name").alias("item"), F.col("p_type").alias("trade"), "p_size")
    return scenarios.holders(items, items.where("p_size > 45"))


_RUMOURS = ["The bridge is out.", "Wolves came down early.", "A comet was seen.", "The mill has a new owner.", "Salt is dear this year.", "The bell rang by itself."]


@query(f"""SELECT user_id, CASE WHEN latest IS NOT NULL AND {keyed.sql_uniform('user_id', 31)} < 0.7 THEN latest ELSE {_list(_RUMOURS)}[1 + {keyed.sql_choice('user_id', 31, len(_RUMOURS))}] END AS rumour
    FROM (SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS latest FROM events GROUP BY user_id)""")
def rumour_choice(spark, sf):
    """GN18."""
    rows = _t(spark, sf, "events").groupBy("user_id").agg(F.max_by(F.when(F.col("event_type") != "view", F.col("event_type")), F.when(F.col("event_type") != "view", F.col("event_id"))).alias("latest"))
    return rows.select("user_id", scenarios.rumour(F.col("latest"), F.col("user_id"), _RUMOURS).alias("rumour"))


@query("SELECT event_id, value FROM events WHERE value / 10 < 1.5")
def low_rewards(spark, sf):
    """what goes to the sink of failures."""
    return grading.low(_t(spark, sf, "events").withColumn("reward", F.col("value") / 10), "reward").select("event_id", "value")


@query("""SELECT count(*) AS n, count_if(len(regexp_extract_all(text, '[A-Za-z]{9,}')) = 0) AS dropped FROM conversations""")
def missing_anchors(spark, sf):
    """how many items have no anchor and are dropped."""
    rows = _t(spark, sf, "conversations").withColumn("anchor", F.when(F.size(F.regexp_extract_all("text", F.lit("([A-Za-z]{9,})"), 1)) > 0, T.anchor_word(F.col("text"))))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("anchor").isNull()).alias("dropped"))


@query(rf"""WITH c AS ({_TURNS}), p AS (SELECT conv_id, {_SYSTEM}[-1].text AS s, {_REST} AS r FROM c), t AS (
    SELECT 'chat' AS source, '### System:' || chr(10) || trim(s) || chr(10) || array_to_string([CASE WHEN t.role = 'assistant' THEN '### NPC:' ELSE '### Player:' END || chr(10) || trim(t.text) FOR t IN r], chr(10)) || chr(10) AS text FROM p WHERE coalesce(s, '') <> '' AND len(r) > 0
    UNION ALL SELECT 'synthetic', text FROM documents
    UNION ALL SELECT 'quest', '### System:' || chr(10) || 'You are a quest-giving NPC in a fantasy world. Quest: ' || p_name || '. ' || p_type || chr(10) || '### Player:' || chr(10) || 'Greetings.' || chr(10) || '### NPC:' || chr(10) || p_brand || chr(10) FROM part
    UNION ALL SELECT 'answer', '### System:' || chr(10) || 'You are ' || c_name || '. ' || c_mktsegment || chr(10) || '### Player:' || chr(10) || 'Who are you?' || chr(10) || '### NPC:' || chr(10) || c_name || chr(10) FROM customer)
    SELECT source, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM t WHERE length(text) BETWEEN 1 AND 32000 GROUP BY source""")
def role_mixture(spark, sf):
    """U4: chat, synthetic texts, quests and answers, none empty or beyond 32,000 characters."""
    role = lambda *pairs: F.array(*(F.struct(F.lit(r).alias("role"), t.alias("text")) for r, t in pairs))
    chat = C.gather(_t(spark, sf, "conversations"))
    system, rest = C.system_and_turns(F.col("turns"))
    chat = chat.where((F.coalesce(system, F.lit("")) != "") & (F.size(rest) > 0)).select(F.lit("chat").alias("source"), C.render_roles(F.col("turns")).alias("text"))
    quest = role(("system", F.concat(F.lit("You are a quest-giving NPC in a fantasy world. Quest: "), "p_name", F.lit(". "), "p_type")), ("user", F.lit("Greetings.")), ("assistant", F.col("p_brand")))
    answer = role(("system", F.concat(F.lit("You are "), "c_name", F.lit(". "), "c_mktsegment")), ("user", F.lit("Who are you?")), ("assistant", F.col("c_name")))
    parts = [chat, _t(spark, sf, "documents").select(F.lit("synthetic").alias("source"), "text")]
    parts += [_t(spark, sf, t).select(F.lit(s).alias("source"), C.render_roles(x).alias("text")) for t, s, x in (("part", "quest", quest), ("customer", "answer", answer))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.length("text").between(1, 32000)).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


# Results


@query("""SELECT event_type AS arm, count(*) AS n, avg(value / 100) AS mean, CASE WHEN count(*) > 1 THEN (max(value / 100) - min(value / 100)) / 2 END AS half_spread, exp(avg(value / 100)) AS ppl, list_position(['purchase', 'none', 'view', 'click'], event_type)::BIGINT AS place
    FROM events WHERE event_type IN ('purchase', 'none', 'view', 'click') GROUP BY event_type""")
def arm_report(spark, sf):
    """Arms in a given order, those without runs left out."""
    return experiments.arm_report(_t(spark, sf, "events").withColumn("loss", F.col("value") / 100), "event_type", "loss", ["purchase", "none", "view", "click"]).withColumn("place", F.col("place").cast("bigint"))


@query("""WITH m AS (SELECT event_type AS arm, round(avg(value), 6) AS fp, round(avg(floor(value)), 6) AS q FROM events GROUP BY event_type), g AS (SELECT max(fp) FILTER (arm = 'view') - max(fp) FILTER (arm = 'click') AS f, max(q) FILTER (arm = 'view') - max(q) FILTER (arm = 'click') AS h FROM m)
    SELECT arm, fp, q, round(q - fp, 6) AS degraded, CASE WHEN arm = 'click' AND f <> 0 THEN round(100 * h / f, 3) END AS edge_retained FROM m, g""")
def quantization_report(spark, sf):
    """N4."""
    rows = _t(spark, sf, "events").groupBy(F.col("event_type").alias("arm")).agg(F.round(F.avg("value"), 6).alias("fp"), F.round(F.avg(F.floor("value")), 6).alias("q"))
    return experiments.quantization_report(rows, "view", "click").withColumn("degraded", F.round("degraded", 6)).withColumn("edge_retained", F.round("edge_retained", 3))


@query("SELECT user_id, round(avg(value), 6) AS loss, count(value) AS n FROM events GROUP BY user_id")
def evaluation_loss(spark, sf):
    """A14."""
    return experiments.mean_loss(_t(spark, sf, "events"), "user_id", "value").withColumn("loss", F.round("loss", 6))


@query("""WITH e AS (SELECT user_id AS p, event_type AS b, max(event_id % 7) AS t FROM events GROUP BY user_id, event_type), d AS (SELECT x.b AS a, y.b AS b, round(avg((x.t <> y.t)::INT), 6) AS divergence, count(*) AS n FROM e x JOIN e y USING (p) WHERE x.b < y.b GROUP BY x.b, y.b)
    SELECT *, round(avg(divergence) OVER (), 6) AS mean, avg(divergence) OVER () < 0.05 AS collapsed FROM d""")
def divergence_report(spark, sf):
    """A17, L9."""
    e = _t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max(F.col("event_id") % 7).alias("t"))
    return experiments.divergence_report(experiments.pairwise_divergence(e, "event_type", "user_id", "t")).withColumn("mean", F.round("mean", 6))


@query("""WITH d AS (SELECT conv_id, count(*) AS depth FROM conversations GROUP BY conv_id) SELECT depth, count(*) AS n, round((SELECT avg(depth) FROM d), 6) AS mean FROM d GROUP BY depth""")
def depth_report(spark, sf):
    """A4."""
    rows = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("depth"))
    return experiments.depth_report(rows, "depth").withColumn("mean", F.round("mean", 6))


@query("""SELECT event_type AS file, count(*) AS n_rows, sum(user_id % 30 - 1) FILTER (user_id % 30 >= 8)::BIGINT AS n_tokens, round(exp(sum(value) FILTER (user_id % 30 >= 8) / greatest(sum(user_id % 30 - 1) FILTER (user_id % 30 >= 8), 1)), 6) AS ppl FROM events GROUP BY event_type""")
def holdout_scores(spark, sf):
    """short texts count as rows, but aren't scored."""
    rows = _t(spark, sf, "events").select("event_type", (F.col("user_id") % 30).alias("n"), (-F.col("value")).alias("lp"))
    return experiments.holdout_scores(rows, "event_type", "n", "lp").withColumn("ppl", F.round("ppl", 6))


@query("SELECT p_partkey, 0.001 * (p_size / 32.0::DOUBLE) AS lr FROM part")
def scaled_rate(spark, sf):
    """N10."""
    return _t(spark, sf, "part").select("p_partkey", experiments.scaled_rate(F.col("p_size")).alias("lr"))


_TIERS = "(l * (4 * d * d + 3 * d * f + 2 * d * t) + d * l * t)"


@query(f"""SELECT k, core_bytes, core_bytes <= 327680 AS core_fits, table_bytes <= 15728640 AS table_fits, round(head * 1000, 6) AS head_ms, round(tab * 1000, 6) AS table_ms, round(1 / (head + tab), 4) AS ceiling
    FROM (SELECT k, {_TIERS} * 0.5 AS core_bytes, v * l * t * 0.5 AS table_bytes, v * d * 0.5 / 60e6 AS head, l * t * 0.5 / 60e6 AS tab FROM (SELECT p_partkey AS k, 1024 * p_size::DOUBLE AS v, 32 * (1 + p_partkey % 4)::DOUBLE AS d, 2 + p_partkey % 5 AS l, 64.0::DOUBLE AS t, 128.0::DOUBLE AS f FROM part))""")
def bandwidth_ceiling(spark, sf):
    """N11."""
    k = F.col("p_partkey")
    b = experiments.bandwidth(1024.0 * F.col("p_size"), 32.0 * (1 + k % 4), 2 + k % 5, F.lit(64.0), F.lit(128.0))
    return _t(spark, sf, "part").select(k.alias("k"), b.alias("b")).select("k", "b.core_bytes", "b.core_fits", "b.table_fits", F.round("b.head_ms", 6).alias("head_ms"), F.round("b.table_ms", 6).alias("table_ms"), F.round("b.ceiling", 4).alias("ceiling"))


@query("SELECT tables, count(*) AS n, sum(p_size)::BIGINT AS n_weights FROM (SELECT p_size, p_partkey % 4 AS dims, CASE WHEN p_partkey % 3 = 0 THEN 'ple.table' ELSE 'core.' || p_name END AS name FROM part), (VALUES (true), (false)) AS v(tables) WHERE dims >= 2 AND (tables OR NOT contains(name, 'table')) GROUP BY tables")
def quantizable_parameters(spark, sf):
    """Which of a model's parameters are quantized, with and without its tables."""
    rows = _t(spark, sf, "part").select("p_size", (F.col("p_partkey") % 4).alias("dims"), F.when(F.col("p_partkey") % 3 == 0, "ple.table").otherwise(F.concat(F.lit("core."), "p_name")).alias("name"))
    rows = rows.withColumn("tables", F.explode(F.array(F.lit(True), F.lit(False))))
    taken = F.when(F.col("tables"), numeric.quantizable(F.col("name"), F.col("dims"))).otherwise(numeric.quantizable(F.col("name"), F.col("dims"), tables=False))
    return rows.where(taken).groupBy("tables").agg(F.count("*").alias("n"), F.sum("p_size").alias("n_weights"))


@query()
def quantize_half_scales(spark, sf):
    """N1 with scales of 16 bits; held against NumPy in the tests."""
    return _t(spark, sf, "embeddings").select("vec_id", numeric.quantized(F.col("embedding").cast("array<double>"), 4, 24, fp16=True).alias("dq"))


@query(f"""WITH c AS (SELECT 0 AS part, conv_id * 100 + turn AS k, {_WORDS} AS w FROM conversations), d AS (SELECT doc_id AS k, {_WORDS} AS w FROM documents), o AS (SELECT *, coalesce(sum(len(w)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM d)
    SELECT part, k, w AS ids FROM c UNION ALL SELECT 1, k, w[: (5000 - off)::BIGINT] FROM o WHERE off < 5000""")
def tail_append(spark, sf):
    """The first 5,000 words of documents after all conversations; the number is the operator's."""
    ours = _t(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), T.words(F.col("text")).alias("ids"))
    return tokens.with_prefix_of(ours, _t(spark, sf, "documents").select(F.col("doc_id").alias("k"), T.words(F.col("text")).alias("ids")), "k", "ids", 5000)


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), o AS (SELECT *, coalesce(sum(len(w)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, (SELECT sum(len(w))::BIGINT FROM d) AS total FROM d),
    b AS (SELECT *, greatest(0, least(len(w), total - greatest(1, floor(total * 0.005))::BIGINT - off)) AS place_ FROM o)
    SELECT doc_id, 'train' AS split, w[: place_] AS ids FROM b WHERE place_ > 0 UNION ALL SELECT doc_id, 'val', w[place_ + 1 :] FROM b WHERE place_ < len(w)""")
def token_split(spark, sf):
    """K5: the last half percent of the tokens, counted by the token."""
    rows = _t(spark, sf, "documents").select("doc_id", T.words(F.col("text")).alias("ids"))
    total = rows.agg(F.sum(F.size("ids").cast("bigint"))).first()[0] or 0
    return tokens.split_tail(rows, "doc_id", "ids", total).select("doc_id", "split", "ids")


_HALF = "CASE WHEN s >= 65520 THEN 'inf'::DOUBLE ELSE round_even(s / pow(2, greatest(floor(log2(s)), -14) - 10), 0) * pow(2, greatest(floor(log2(s)), -14) - 10) END"


@query(f"""WITH r AS (SELECT l_orderkey, l_extendedprice AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) - 1 AS i FROM lineitem),
    g AS (SELECT *, i // 4 AS g, greatest(max(abs(x)) OVER (PARTITION BY l_orderkey, i // 4) / 7, 1e-8) AS s FROM r), h AS (SELECT l_orderkey, i, g, x, {_HALF} AS s FROM g),
    c AS (SELECT l_orderkey, list(CASE WHEN s = 0 THEN 0 ELSE greatest(least(round_even(x / s, 0), 7), -7) END::INT + 8 ORDER BY i) AS c, list(s ORDER BY i) FILTER (i % 4 = 0) AS scales FROM h GROUP BY l_orderkey)
    SELECT l_orderkey, len(c)::BIGINT AS n, scales, array_to_string([lower(lpad(printf('%x', c[2 * p + 1] + 16 * coalesce(c[2 * p + 2], 0)), 2, '0')) FOR p IN range(0, (len(c) + 1) // 2)], '') AS packed FROM c""")
def int4_half_scales(spark, sf):
    """Rows of any length, an order's prices, in groups of four with scales of 16 bits; an odd row ends in half a byte."""
    rows = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice"))).alias("x"))
    rows = rows.select("l_orderkey", F.col("x.l_extendedprice").alias("x"))
    return rows.select("l_orderkey", F.size("x").cast("bigint").alias("n"), numeric.scales(F.col("x"), 4, 4, fp16=True).alias("scales"), numeric.packed(numeric.codes(F.col("x"), 4, 4, fp16=True)).alias("packed"))


# Cards of characters

_STRIPPED = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_FIRST = lambda x: "coalesce(" + ", ".join(f"CASE WHEN strpos({x}, '{s} ') - 1 > 30 AND strpos({x}, '{s} ') - 1 < 260 THEN substr({x}, 1, strpos({x}, '{s} ')) END" for s in ".!?") + f", substr({x}, 1, 240))"
_BANK = lambda options, key, seed: f"{_list(options)}[1 + {keyed.sql_choice(key, seed, len(options))}]"


def _cards_sql(kind: str, name: str, source: str, most: int, each: int, seed: str) -> str:
    parts = {"gesture": "", "name": "name", "origin": "CASE WHEN coalesce(source, '') <> '' THEN ' of ' || source ELSE '' END", "about": "about", "scene": "scene", "place": "coalesce(source, 'these parts')"}

    def turn(subject: str) -> str:
        own = parts | {"gesture": _BANK(cards.GESTURES, "who", f"{seed}-{subject}-gesture")}
        options = ["concat(" + ", ".join(own[x] if k % 2 else "'" + x.replace("'", "''") + "'" for k, x in enumerate(re.split(r"{(\w+)}", o))) + ")" for o in cards.SAID[subject]]
        said = f"CASE {keyed.sql_choice('who', f'{seed}-{subject}-said', len(options))} " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + " END"
        return f"'### Player:' || chr(10) || {_BANK(cards.ASKED[subject], 'who', f'{seed}-{subject}-asked')} || chr(10) || '### NPC:' || chr(10) || {_STRIPPED(said)}"

    subjects = ", ".join("{'d': " + keyed.sql_digest(f"who || '|{k}'", seed) + f", 't': {turn(k)}" + "}" for k in cards.SUBJECTS)
    return f"""SELECT '{kind}' AS kind, place, conv_id, variant, '### System:' || chr(10) || {_STRIPPED("'You are ' || name || '. Background: ' || d || ' Current Location: ' || s || ' Speak in character.'")} || chr(10) || {turn("greeting")} || chr(10)
        || array_to_string([x.t FOR x IN list_sort([{subjects}])[: 2 + {keyed.sql_choice("who", f"{seed}-n", 2)}]], chr(10)) || chr(10) || {turn("farewell")} || chr(10) AS text
        FROM (SELECT *, p * {each} + variant AS place, conv_id || '|' || variant AS who, {_FIRST("d")} AS about, CASE WHEN s <> '' THEN {_FIRST("s")} ELSE {_FIRST("d")} END AS scene
            FROM (SELECT conv_id, {name} AS name, {source} AS source, {_STRIPPED("description")} AS d, {_STRIPPED("coalesce(scenario, '')")} AS s, row_number() OVER (ORDER BY {keyed.sql_digest("conv_id", "card-order")}) - 1 AS p
                FROM c WHERE description IS NOT NULL), (SELECT unnest(range({each})) AS variant)) WHERE place < {most}"""


_NAME = lambda seed: f"{_BANK(dialogue.HEADS, 'conv_id', f'{seed}h')} || {_BANK(dialogue.TAILS, 'conv_id', f'{seed}t')}"


@query(f"""WITH c AS (SELECT conv_id, max(text) FILTER (turn = 0) AS description, max(text) FILTER (turn = 2) AS scenario, CASE conv_id % 3 WHEN 1 THEN '' WHEN 2 THEN 'Oster Vale' END AS source FROM conversations GROUP BY conv_id)
    {_cards_sql("card", _NAME("name"), "source", 30_000, 2, "card")} UNION ALL {_cards_sql("renamed", _NAME("card-other"), _BANK(cards.ORIGINS, "conv_id", "card-origin"), 15_000, 1, "card-other")}""")
def card_dialogues(spark, sf):
    """GN6, with the two caps of its outputs: a conversation's first turn is the description, its third the scenario."""
    said = lambda turn: F.max(F.when(F.col("turn") == turn, F.col("text")))
    rows = _t(spark, sf, "conversations").groupBy("conv_id").agg(said(0).alias("description"), said(2).alias("scenario"))
    source = F.when(F.col("conv_id") % 3 == 1, "").when(F.col("conv_id") % 3 == 2, "Oster Vale")
    return cards.legacy(rows.withColumns({"name": dialogue.made_name(F.col("conv_id")), "source": source}), "conv_id")
