"""Dialogues made from tables of items, quests, places and personas: rows drawn by keyed choice, filled into templates.

A draw joins on (group, place in the group), so a large table isn't gathered, and the same key draws the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import keyed, values
from ..functions import text as T

#: Greetings of keepers; one is drawn by key.
GREETINGS = ["Come in, and mind the step.", "Good day to you.", "You look like the road was long."]


#: What keepers say, of which one is drawn by key; {item}, {price}, {floor}, {place}, {rumor} and {detail} are filled in.
SAID = {
    "quote": ["The {item} is {price}. {detail}.", "I can let the {item} go for {price}. {detail}.", "{price} buys the {item}. {detail}."],
    "list": ["On the shelf: {list}.", "Today there is {list}.", "Look around: {list}."],
    "accept": ["Then it is yours.", "Agreed. May it serve you.", "Done, and thank you."],
    "agreed": ["{price}, then. You drive it hard.", "So be it, {price}.", "{price}, and tell nobody."],
    "decline": ["Not below {floor}. It stays {price}.", "No, {price} is the price.", "For less than {floor} I keep it. {price}."],
    "no_stock": ["I have none of that.", "That has run out here.", "None left, I fear."],
    "lead": ["Ask in {place}.", "They keep it in {place}.", "{place} is where I would look."],
    "nowhere": ["I know of nobody who has it.", "No one near here sells that."],
    "ask": ["I need {item} from {place}. Bring it for {price}.", "Fetch me {item}: {place} has it. I pay {price}."],
    "buy": ["I can use that. {price}.", "{price}, and I take it."],
    "pass": ["I have no use for it.", "Not for me, thank you."],
    "turn_in": ["Here is {price}, as I said.", "Well done. {price} is yours."],
    "business": ["{rumor}. That is how trade goes.", "{rumor}, so we wait.", "It could be worse. {rumor}."],
}


#: Rows and items that a task joins.
PER_TASK = 100_000


def numbered(df: DataFrame, by: str, order: str, per_range: int = 200_000) -> DataFrame:
    """Adds i_, each row's place from 0 in its group: in ranges of the order, then by rows of a range.

    Ranges lie between values that are drawn by their hash, at most 255 of them, so a large group is sorted by many tasks;
    where they lie doesn't change the places. Rows without a group get none.
    """
    rows = df.where(F.col(by).isNotNull())
    total = rows.count()
    parts = min(256, -(-total // per_range))
    cuts: list = []
    if parts > 1:
        some = rows.where(F.pmod(F.xxhash64(order), F.lit(max(1, total // (64 * parts)))) == 0).select(order).distinct()
        drawn = sorted(r[0] for r in some.orderBy(F.xxhash64(order)).limit(64 * parts).collect() if r[0] is not None)
        cuts = sorted({drawn[k * len(drawn) // parts] for k in range(1, parts)}) if drawn else []
    kind = df.schema[order].dataType
    below = F.when(F.col(order).isNull(), 0).otherwise(F.size(F.filter(F.array(*(F.lit(c).cast(kind) for c in cuts)), lambda c: c < F.col(order))))
    ranged = rows.withColumn("part_", below if cuts else F.lit(0))
    sizes = ranged.groupBy(by, "part_").agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    sizes = sizes.select(by, "part_", F.coalesce(before, F.lit(0)).alias("before_"))
    place = F.row_number().over(Window.partitionBy(by, "part_").orderBy(order)) - 1
    return ranged.withColumn("i_", place).join(sizes, [by, "part_"]).withColumn("i_", F.col("i_").cast("long") + F.col("before_")).select(*df.columns, "i_")


def draw(rows: DataFrame, dim: DataFrame, by: str, order: str, key: str, seed: str, names: list[str]) -> DataFrame:
    """Adds a struct for each of up to three ``names``: distinct rows of the group, null where it has too few.

    Joins are dealt out by counts of rows: texts of items compress so well that parts of equal bytes would hold too many.
    """
    listed = numbered(dim, by, order)
    parts = max(dim.sparkSession.sparkContext.defaultParallelism, -(-(rows.count() + dim.count()) // PER_TASK))
    n = F.coalesce("n_", F.lit(0))
    pick = lambda k: keyed.choice(F.col(key), f"{seed}{k}", F.when(n > k, n - k))
    first, step = pick(0), 1 + pick(1)
    places = [first, F.pmod(first + step, n), F.pmod(first + 1 + F.pmod(step + pick(2), n - 1), n)]
    out = rows.join(dim.groupBy(by).agg(F.count("*").alias("n_")), by, "left")
    for k, name in enumerate(names):
        nowhere = -1 - F.pmod(F.xxhash64(key), F.lit(1000))  # matches no item, and is dealt out
        out = out.withColumn("i_", F.coalesce(F.when(n > k, places[k]).cast("long"), nowhere)).repartition(parts, by, "i_")
        own = listed.select(by, "i_", F.struct(*(c for c in dim.columns if c != by)).alias(name))
        out = out.join(own.repartition(parts, by, "i_"), [by, "i_"], "left").drop("i_")
    return out.drop("n_")


def bank(options: list[str], key: Column, seed: str) -> Column:
    """One of a bank's sentences."""
    return F.element_at(T.strings(options), (keyed.choice(key, seed, len(options)) + 1).cast("int"))


def says(kind: str, key: Column, seed: str, **parts: Column) -> Column:
    """One of the sentences of ``SAID``, with its parts filled in."""
    text = bank(SAID[kind], key, f"{seed}-{kind}")
    for name, part in parts.items():
        text = F.replace(text, F.lit(f"{{{name}}}"), part)
    return text


def first_up(text: Column) -> Column:
    """The first character in upper case, the others as they are."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2147483647))


def gold(price: Column) -> Column:
    return F.concat(price.cast("string"), F.lit(" gold"))


def _card(keeper: Column, about: Column, *lines: Column) -> Column:
    return F.concat_ws("\n", F.concat(keeper, F.lit("'s Description: "), about), F.lit("<START>"), *lines)


def _says(who: Column | str, *parts: Column | str) -> Column:
    as_column = lambda p: F.lit(p) if isinstance(p, str) else p
    return F.concat(as_column(who), F.lit(": "), *map(as_column, parts))


def shop(rows: DataFrame, items: DataFrame, key: str, seed: str = "shop") -> DataFrame:
    """Adds text: a keeper sells the first of three items; null where the trade has fewer than three.

    Rows: key, trade, keeper; items: trade, item, price, property, provenance.
    """
    out = draw(rows, items, "trade", "item", key, seed, ["star", "second", "third"])
    k, star, second, third = F.col("keeper"), F.col("star"), F.col("second"), F.col("third")
    text = _card(
        k, F.lit("a keeper of a shop."),
        _says("Player", "What do you have for sale?"),
        _says(k, star["item"], " for ", gold(star["price"]), ", ", second["item"], " for ", gold(second["price"]), ", and ", third["item"], " for ", gold(third["price"]), "."),
        _says("Player", "Tell me about the ", star["item"], "."),
        _says(k, T.capitalise(star["property"]), ". ", T.capitalise(star["provenance"]), "."),
    )
    return out.withColumn("text", F.when(third.isNotNull(), text))


def on_the_table(rows: DataFrame, items: DataFrame, key: str, seed: str = "table") -> DataFrame:
    """Adds text: a player asks for the thing on the table."""
    out = draw(rows, items, "trade", "item", key, seed, ["star"])
    star = F.col("star")
    return out.withColumn("text", _card(F.col("keeper"), F.lit("a keeper of a shop."), _says("Player", "Is that thing on your table for sale?"), _says(F.col("keeper"), "The ", star["item"], "? ", T.capitalise(star["property"]), ". ", gold(star["price"]), ".")))


def quest(keeper: Column, title: Column, objective: Column, text: Column) -> Column:
    return _card(keeper, F.lit("one who has work to give."), _says("Player", "Is there work for me?"), _says(keeper, title, ". ", T.strip(text)), _says("Player", "What must I do?"), _says(keeper, objective))


def answer(name: Column, biography: Column, query: Column, response: Column) -> Column:
    """A question to a person with a biography."""
    return _card(name, biography, _says("Player", query), _says(name, response))


def directions(place: Column, about: Column, exits: Column, keeper: Column) -> Column:
    """The way from a place: its first exit, and the second if there is one."""
    more = F.when(F.size(exits) > 1, F.concat(F.lit(" Another leads to "), F.try_element_at(exits, F.lit(2)), F.lit("."))).otherwise("")
    return F.when(F.size(exits) > 0, _card(keeper, F.concat(F.lit("a guide of "), place, F.lit(".")), _says("Player", "Where does the road go?"), _says(keeper, "This is ", place, ", ", about, ". The road leads to ", F.element_at(exits, 1), ".", more)))


def traits(about: Column) -> Column:
    """The first three of the known traits that a description has."""
    w = F.regexp_extract_all(F.lower(about), F.lit("([a-z]+)"), 1)
    return T.let(F.slice(F.filter(T.strings(values.TRAITS), lambda t: F.array_contains(w, t)), 1, 3), lambda t: F.when(F.size(t) > 0, F.array_join(t, ", ")).otherwise(values.NO_TRAITS))


#: What a player asks a persona; two to four are drawn.
QUESTIONS = ["Who are you?", "What do you sell?", "Is there work for me?", "What stories are told here?", "What is this place?", "Where do the roads go?"]


def persona(name: Column, about: Column, key: Column, seed: str = "persona") -> Column:
    """A card with traits and trade, and two to four of the questions in a keyed order."""
    asked = F.slice(F.array_sort(F.transform(T.strings(QUESTIONS), lambda q: F.struct(keyed.digest(F.concat_ws("|", key.cast("string"), q), seed).alias("d"), q.alias("q")))), F.lit(1), (2 + keyed.choice(key, f"{seed}n", 3)).cast("int"))
    return _card(name, T.first_sentence(about), F.concat(F.lit("Personality: "), traits(about)), F.concat(F.lit("Trade: "), T.trade_of(about, key)), F.array_join(F.transform(asked, lambda a: F.concat(F.lit("Player: "), a["q"])), "\n"))


#: Parts of made-up names.
HEADS = "Al Bar Cor Dun El Fen Gar Hal Is Jor Kel Lor Mar Nor Or Per Ros Sel Tor Ul".split()
TAILS = "a ian dor en eth ick in is la len mir na or ra ric ron th us wen wyn".split()


def made_name(key: Column, seed: str = "name") -> Column:
    return F.concat(bank(HEADS, key, f"{seed}h"), bank(TAILS, key, f"{seed}t"))


def item_chain(item: Column, use: Column, provenance: Column, origin: Column) -> Column:
    """Sentences that each take up a word of the one before; null if the property has no long word."""
    anchor = T.anchor_word(use)
    return F.when(anchor.isNotNull(), F.concat(F.lit("This is the "), item, F.lit(". The "), item, F.lit(" is "), use, F.lit(". Of "), anchor, F.lit(", I know: "), provenance, F.lit(". It came from "), origin, F.lit(".")))


def lineage_chain(keeper: Column, lineage: Column, event: Column, consequence: Column) -> Column:
    """A keeper's line, and what it lived through; the event alone where no line is known."""
    line = F.when(lineage.isNotNull(), F.concat(keeper, F.lit(" is "), lineage, F.lit(". That line remembers "), event)).otherwise(F.concat(F.lit("Folk remember "), event))
    return F.concat(line, F.lit(". In "), event, F.lit(" "), consequence, F.lit("."))


def place_chain(place: Column, exit_: Column, event: Column, consequence: Column) -> Column:
    """From a place to an exit, by the last word of its name, to an event."""
    last = F.when(F.contains(exit_, F.lit(",")), exit_).otherwise(F.element_at(F.split(exit_, " "), -1))
    return F.concat(F.lit("From "), place, F.lit(" a road leads to "), exit_, F.lit(". At "), last, F.lit(" they speak of "), event, F.lit(": "), consequence, F.lit("."))


def parse_persona_turns(script: Column) -> Column:
    """npc and user turns of a script with speaker marks; null if a turn is empty or longer than 400 characters."""
    roles = F.regexp_extract_all(script, F.lit(r"\{\{(char|user)\}\}:"), 1)
    said = F.slice(F.transform(F.split(script, r"\{\{char\}\}:|\{\{user\}\}:"), T.collapse), F.lit(2), F.size(roles))
    turns = F.zip_with(roles, said, lambda r, s: F.struct(F.when(r == "char", "npc").otherwise("user").alias("role"), s.alias("text")))
    return T.let(turns, lambda t: F.when(F.forall(t, lambda x: F.length(x["text"]).between(1, 400)), t))


def persona_record(name: Column, greeting: Column, script: Column) -> Column:
    """A card of a persona record; null without a proper name, two user turns and three lines of dialogue."""
    greet = T.collapse(F.coalesce(greeting, F.lit("")))
    about = F.when(greet != "", T.first_sentence(greet, 20, 260, 260)).otherwise(F.concat(name, F.lit(", a character.")))
    opens = lambda x: F.lower(x["text"]).rlike("^(description|scenario):") & (x["role"] == "npc")

    def card(turns):
        # Leading turns of the persona that repeat its card are left out.
        start = F.coalesce(F.array_min(F.filter(F.transform(turns, lambda x, i: F.when(~opens(x), i)), lambda i: i.isNotNull())), F.size(turns))
        lines = F.transform(F.slice(turns, start + 1, F.size(turns)), lambda x: F.concat(F.when(x["role"] == "npc", name).otherwise("Player"), F.lit(": "), x["text"]))
        enough = (F.size(F.filter(turns, lambda x: x["role"] == "user")) >= 2) & (F.size(turns) - start >= 3)
        return F.when(enough, F.concat(F.lit("Description: "), about, F.lit("\nScenario: a meeting with "), name, F.lit(".\n<START>\n"), F.array_join(lines, "\n"), F.lit("\n")))

    return F.when(name.rlike(r"^[A-Z][A-Za-z' .-]{1,39}$"), T.let(parse_persona_turns(script), card))


def sale(rows: DataFrame, items: DataFrame, key: str, seed: str = "sale") -> DataFrame:
    """Adds kind, price, offer, oracle, text: a sale, a haggle or a talk about an item in stock.

    Rows: key, trade, keeper, markup, level, demand; items as for ``shop``, in stock only. An offer is taken if it is
    lucky and not below the floor; the oracle is the action line, null if there is none. Keepers quote the item, or list
    it with another; those of level seven or more decline in words of their own.
    """
    out = draw(rows, items, "trade", "item", key, seed, ["star", "other"]).where("star IS NOT NULL")
    k, base, u = F.col(key), F.col("star.price"), lambda s: keyed.uniform(F.col(key), f"{seed}{s}")
    markup = F.col("markup") * (1 + 0.03 * (F.col("level") - 5))
    out = out.withColumn("price", F.bround(base * F.col("demand") * markup, 0).cast("long"))
    out = out.withColumn("floor_", F.bround(base * F.col("demand") * F.least(F.lit(0.97), values.FLOOR + 0.01 * F.col("level")) * markup, 0).cast("long"))
    out = out.withColumn("kind", F.when(u("k") < 0.45, "buy").when(u("k") < 0.75, "haggle").otherwise("talk"))
    out = out.withColumn("offer", F.when(F.col("kind") == "haggle", F.bround(F.col("price") * (0.5 + 0.3 * u("o")), 0).cast("long")))
    taken = (u("a") < 0.5) & (F.col("offer") >= F.col("floor_"))
    deal = lambda p: F.concat(F.lit("[DEAL: "), F.col("star.item"), F.lit(" "), p.cast("string"), F.lit("]"))
    out = out.withColumn("oracle", F.when(F.col("kind") == "buy", deal(F.col("price"))).when((F.col("kind") == "haggle") & taken, deal(F.col("offer"))))
    keeper, item, price = F.col("keeper"), F.col("star.item"), gold(F.col("price"))
    other = F.bround(F.col("other.price") * F.col("demand") * markup, 0).cast("long")
    both = F.concat(item, F.lit(", "), price, F.lit(" -- "), F.col("star.property"), F.lit(". There is also "), F.col("other.item"), F.lit(" at "), gold(other))
    shown = F.when(F.col("other").isNotNull() & (u("l") < 0.6), says("list", k, seed, list=both)).otherwise(says("quote", k, seed, item=item, price=price, detail=T.capitalise(F.col("star.property"))))
    firm = F.concat(F.lit("I have sold such things longer than you have been on the road. It is "), price, F.lit("."))
    no = F.when(F.col("level") >= 7, firm).otherwise(says("decline", k, seed, floor=gold(F.col("floor_")), price=price))
    kind, agreed = F.col("kind"), F.col("oracle").isNotNull()
    offered = F.when(agreed, F.concat(gold(F.col("offer")), F.lit(", final offer."))).otherwise(F.concat(F.lit("How about "), gold(F.col("offer")), F.lit("?")))
    asked = F.when(kind == "buy", F.concat(F.lit("I'll take the "), item, F.lit("."))).when(kind == "haggle", offered).otherwise(F.concat(F.lit("Tell me about the "), item, F.lit(".")))
    told = F.concat(T.capitalise(F.col("star.provenance")), F.lit(". It is "), price, F.lit("."))
    reply = F.when(kind == "talk", told).when(kind == "buy", says("accept", k, seed)).when(agreed, says("agreed", k, seed, price=gold(F.col("offer")))).otherwise(no)
    text = _card(keeper, F.lit("a keeper of a shop."), _says(keeper, bank(GREETINGS, k, f"{seed}g")), _says("Player", "What do you have for sale?"), _says(keeper, shown), _says("Player", asked), _says(keeper, reply), F.col("oracle"))
    return out.withColumn("text", text).drop("floor_")


def errands(rows: DataFrame, items: DataFrame, key: str, seed: str = "errand") -> DataFrame:
    """Adds kind, wanted, oracle: an item that is missing, to be fetched, brought or sold.

    Rows: key, trade, place; items also have stock and origin. What is missing may be at another keeper's; a restock
    quest leads to the origin; a turn-in pays 1.3 of the base price; a player's offer at 0.6 is taken up to a stock of
    five. Rows whose kind needs an empty item where the trade has none are dropped.
    """
    u = lambda s: keyed.uniform(F.col(key), f"{seed}{s}")
    out = draw(rows, items.where("stock = 0"), "trade", "item", key, seed, ["gone"])
    out = draw(out, items, "trade", "item", key, f"{seed}x", ["own"])
    out = out.withColumn("kind", F.when(u("k") < 0.36, "missing").when(u("k") < 0.56, "restock").when(u("k") < 0.76, "player_sell").when(u("k") < 0.89, "turn_in").otherwise("small_talk"))
    needs = F.col("kind").isin("missing", "restock", "turn_in")
    at = lambda verb, *parts: F.concat(F.lit(f"[{verb}: "), *parts, F.lit("]"))
    pay = lambda item, times: at("BUY", item["item"], F.lit(" "), F.bround(times * item["price"], 0).cast("long").cast("string"))
    oracle = (
        F.when((F.col("kind") == "missing") & (u("p") < 0.8), at("GOTO", F.col("place")))
        .when(F.col("kind") == "restock", at("GOTO", F.col("gone.origin")))
        .when(F.col("kind") == "turn_in", pay(F.col("gone"), F.lit(1.3)))
        .when((F.col("kind") == "player_sell") & (F.col("own.stock") <= 5) & (u("p") < 0.85), pay(F.col("own"), F.lit(0.6)))
    )
    wanted = F.when(needs, F.col("gone.item")).when(F.col("kind") == "player_sell", F.col("own.item"))
    return out.where(~needs | F.col("gone").isNotNull()).withColumn("wanted", wanted).withColumn("oracle", oracle)


def errand_text(errands: DataFrame, key: str, seed: str = "errand") -> DataFrame:
    """Adds text to rows of ``errands``, which also have keeper, and may have reason, rumor and lineage: null where unknown.

    A keeper who knows why an item is gone says so. In small talk a fourth of those of a known line name it.
    """
    k, keeper, kind, oracle = F.col(key), F.col("keeper"), F.col("kind"), F.col("oracle")
    known = lambda c: F.col(c) if c in errands.columns else F.lit(None).cast("string")
    named, place = F.col("wanted"), F.regexp_extract(oracle, r"^\[GOTO: (.*)\]$", 1)
    reward = gold(F.bround(1.3 * F.col("gone.price"), 0).cast("long"))
    offer = gold(F.bround(0.6 * F.col("own.price"), 0).cast("long"))
    out = lambda *lines: F.concat_ws("\n", *lines)
    none = F.coalesce(F.concat(F.lit("That I do not have, not today -- "), known("reason"), F.lit(".")), says("no_stock", k, seed))
    where = out(_says("Player", "Where could I find it?"), _says(keeper, F.when(oracle.isNotNull(), says("lead", k, seed, place=place)).otherwise(says("nowhere", k, seed))))
    greeting = F.when(keyed.uniform(k, f"{seed}-line") < 0.25, F.concat(F.lit("Good day. "), first_up(known("lineage")), F.lit(", for what that is worth.")))
    talk = {
        "missing": out(_says("Player", "Do you have ", named, "?"), _says(keeper, none), where),
        "restock": out(_says("Player", "Do you have a quest for me?"), _says(keeper, says("ask", k, seed, item=named, place=place, price=reward)), _says("Player", "Where do I find it?"), _says(keeper, says("lead", k, seed, place=place))),
        "player_sell": out(_says("Player", "Would you buy this ", named, "?"), _says(keeper, F.when(oracle.isNotNull(), says("buy", k, seed, price=offer)).otherwise(says("pass", k, seed)))),
        "turn_in": out(_says("Player", "I have the ", named, " you asked for."), _says(keeper, says("turn_in", k, seed, price=reward))),
        "small_talk": out(_says("Player", "How's business?"), _says(keeper, says("business", k, seed, rumor=first_up(F.coalesce(known("rumor"), F.lit("the roads are quiet")))))),
    }
    scenes = {"missing": "the day's trade underway.", "restock": "shelves thin this week.", "turn_in": F.concat(F.lit("you carry: "), named, F.lit(".")), "player_sell": F.concat(F.lit("the day's trade underway. You carry: "), named, F.lit(".")), "small_talk": "between customers."}
    choose = lambda options: F.coalesce(*(F.when(kind == name, F.lit(x) if isinstance(x, str) else x) for name, x in options.items()))
    hello = F.when(kind == "small_talk", F.coalesce(greeting, F.lit("Good day. Mind the step."))).when(kind == "turn_in", "Back already?").otherwise(F.lit("Welcome. Mind the step."))
    text = F.concat_ws("\n", F.concat(keeper, F.lit("'s Description: a keeper of a shop.")), F.concat(F.lit("Scenario: "), keeper, F.lit("'s shop, "), choose(scenes)), F.lit("<START>"), _says(keeper, hello), choose(talk), oracle)
    return errands.withColumn("text", F.concat(text, F.lit("\n")))


def action_reward(action: Column, present: Column, oracle: Column, card: Column, places: list[str], mode: str = "off", given: Column | None = None) -> Column:
    """What an answer's first action adds to its reward; ``present`` says whether a line opens with a bracket.

    Without an oracle, or in mode "off", an action that doesn't parse, leads to no known place or trades what the card
    doesn't name costs 1, any other 0.3. With one, the same action gains 1, none costs 0.8, the same verb 0.2, another
    0.6; in mode "gate" an answer without an action line costs 1. ``given`` says whether there is an oracle; one that
    doesn't parse asks for no action.
    """
    unknown = ((action["verb"] == "GOTO") & ~F.coalesce(action["arg"].isin(places), F.lit(False))) | (action["verb"].isin(values.PRICED_VERBS) & ~F.contains(F.lower(card), F.lower(action["arg"])))
    alone = F.when(~present, 0.0).when(action.isNull() | unknown, -1.0).otherwise(-0.3)
    if mode == "off":
        return alone
    against = F.when(T.oracle_ok(oracle, action), 1.0).when(action.isNull(), -0.8).when(action["verb"] == oracle["verb"], -0.2).otherwise(-0.6)
    if mode == "gate":
        against = F.when(~present, -1.0).otherwise(against)
    return F.when(oracle.isNotNull() if given is None else given, against).otherwise(alone)
