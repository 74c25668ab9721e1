"""Text operators as Column expressions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values

_some = lambda c: F.when(c == "", None).otherwise(c)


def strings(items) -> Column:
    return F.array(*(F.lit(x) for x in items))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, even where a lambda uses it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: What Python's strip takes: Unicode's white space, and the separators U+001C to U+001F.
_BLANK = r"[\p{IsWhite_Space}\x1C-\x1F]"
_BLANKS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(_BLANKS))


def strip_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(_BLANKS))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends; F.trim takes spaces only."""
    return F.btrim(text, F.lit(_BLANKS))


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\p{IsWhite_Space}\x1C-\x1F]")


def is_toxic(text: Column) -> Column:
    return F.exists(strings(values.TOXIC), lambda p: F.contains(F.lower(text), p))


def strip_beats(text: Column) -> Column:
    """Takes out *beats*, line by line; card fields keep theirs, and lines of blanks alone stay as they are."""
    plain = lambda x: F.when(is_blank(x), x).otherwise(strip(F.regexp_replace(x, rf"{_BLANK}*{values.BEAT}{_BLANK}*", " ")))
    card = lambda x: F.exists(strings(values.CARD_FIELDS), lambda f: F.startswith(x, f))
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(card(x), x).otherwise(plain(x))), "\n")


def persona_name(system: Column) -> Column:
    return F.coalesce(_some(F.regexp_extract(system, r"You are ([A-Z][^.,]{1,40}?)[.,]", 1)), _some(F.regexp_extract(system, r"Background: ([A-Z][^.,]{1,40}?) (?:is|was)", 1)), F.lit("NPC"))


def first_sentence(text: Column, low: int = 30, high: int = 260, fallback: int = 240) -> Column:
    """Up to the first '. ', else '! ', else '? ' in bounds; else the head."""
    at = lambda sep: F.instr(text, sep) - 1
    return F.coalesce(*(F.when((at(s) > low) & (at(s) < high), F.substring(text, F.lit(1), at(s) + 1)) for s in (". ", "! ", "? ")), F.substring(text, 1, fallback))


def truncate_at_sentence(text: Column, limit: int, trim_end=strip_right) -> Column:
    """Cut to ``limit`` at the last sentence end beyond two fifths of it, or closed with a full stop after ``trim_end``."""
    cut = F.substring(text, 1, limit)
    last = lambda sep: F.when(F.contains(cut, F.lit(sep)), F.length(cut) - F.instr(F.reverse(cut), sep[::-1]) - 1).otherwise(-1)
    best = F.greatest(last(". "), last("! "), last("? "))
    return F.when(F.length(text) <= limit, text).when(best > 0.4 * limit, F.substring(cut, F.lit(1), best + 1)).otherwise(F.concat(trim_end(cut), F.lit(".")))


def clean_name(raw: Column) -> Column:
    """A name with a capital, or null."""
    name = strip(raw)
    blocked = F.exists(strings(values.NAME_BLOCKLIST), lambda p: F.contains(F.lower(name), p))
    return F.when(F.length(name).between(3, 20) & name.rlike("^[A-Za-z' -]+$") & ~blocked, F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 100)))


def clean_title(raw: Column) -> Column:
    return F.coalesce(F.initcap(F.replace(F.regexp_replace(raw, r"(?i)^open spiel:\s*", ""), F.lit("_"), F.lit(" "))), F.lit("a game"))


def game_kind(title: Column, compat: bool = False) -> Column:
    """language or move_log. Underscores count as spaces, unless ``compat``."""
    t = F.lower(title) if compat else F.replace(F.lower(title), F.lit("_"), F.lit(" "))
    found = F.exists(strings([*values.LANGUAGE_GAMES, *(g.replace("-", " ") for g in values.LANGUAGE_GAMES)]), lambda g: F.contains(t, g))
    return F.when(found, "language").otherwise("move_log")


def stop_cut(text: Column, markers: list[str]) -> tuple[Column, Column]:
    """The text before the earliest marker, and whether there was one."""
    at = F.least(*(F.when(F.instr(text, m) > 0, F.instr(text, m)) for m in markers), F.lit(None).cast("int"))
    return F.when(at.isNull(), text).otherwise(F.substring(text, F.lit(1), at - 1)), at.isNotNull()


def last_line_after(text: Column, marker: str) -> Column:
    """The rest of the line after the last marker; empty without one."""
    rest = F.substring_index(F.substring_index(text, marker, -1), "\n", 1)
    return F.when(F.contains(text, F.lit(marker)), rest).otherwise("")


def parse_action(line: Column) -> Column:
    """verb, arg, price of an action line; null if it is none."""
    verbs = "|".join([*values.ARGUMENT_VERBS, *values.PRICED_VERBS])
    pattern, price = rf"^\[({verbs}): ?(.*)\]$", r"^(.*) ([0-9]+)$"
    action = lambda verb, arg, price: F.struct(verb.alias("verb"), arg.alias("arg"), price.alias("price"))

    def parts(p):
        plain = action(p["verb"], let(strip(p["rest"]), _some), F.lit(None).cast("bigint"))
        found = F.struct(F.regexp_extract(p["rest"], price, 1).alias("name"), F.regexp_extract(p["rest"], price, 2).alias("price"))
        priced = let(found, lambda q: F.when(q["price"] != "", action(p["verb"], strip(q["name"]), q["price"].try_cast("bigint"))))
        return F.when(p["verb"].isin(values.ARGUMENT_VERBS), plain).when(p["verb"].isin(values.PRICED_VERBS), priced)

    return let(strip(line), lambda t: let(F.struct(F.regexp_extract(t, pattern, 1).alias("verb"), F.regexp_extract(t, pattern, 2).alias("rest")), parts))


def action_lines(text: Column) -> Column:
    """dialog and actions: non-blank lines, those that start with a bracket apart."""
    lines = F.filter(F.split(strip(text), "\n"), lambda x: ~is_blank(x))
    return F.struct(F.filter(lines, lambda x: ~F.startswith(strip_left(x), F.lit("["))).alias("dialog"), F.filter(lines, lambda x: F.startswith(strip_left(x), F.lit("["))).alias("actions"))


def quoted_prices(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+)\s*gold"), 1), lambda x: x.try_cast("bigint"))


def content_words(text: Column) -> Column:
    return F.array_distinct(F.array_except(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{5,})"), 1), strings(values.STOP_WORDS)))


def capitalise(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2147483647)))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"{_BLANK}+", " "))


def collapsed_head(text: Column, n: int) -> Column:
    """The first ``n`` characters of the collapsed text; the whole of it is collapsed only where its start doesn't hold them."""
    start = F.substring(text, 1, 4 * n)
    return let(collapse(start), lambda s: F.when((F.length(s) >= n) | (F.length(text) <= 4 * n), F.substring(s, 1, n)).otherwise(F.substring(collapse(text), 1, n)))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def repeats_ngram(text: Column, n: int = 3, most: int = 2) -> Column:
    """Whether some n-gram of words as they are occurs more than ``most`` times.

    Grams are sorted by their 64-bit hashes, so equal ones stand together: no pairs, and no strings to sort.
    """
    gram = lambda w, i: F.xxhash64(*(F.element_at(w, i + k) for k in range(n)))
    grams = lambda w: F.array_sort(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: gram(w, i)))
    again = lambda g: F.exists(F.sequence(F.lit(1), F.size(g) - most), lambda i: F.element_at(g, i) == F.element_at(g, i + most))
    return let(words(text), lambda w: F.when(F.size(w) <= n + 2, F.lit(False)).otherwise(let(grams(w), again)))


def chain_depth(card: Column, body: Column) -> Column:
    """How many leading sentences each share a content word with the card or the sentences before; blank ones don't count."""
    sentences = F.filter(F.split(body, r"[.!?]\s"), lambda s: s.rlike(r"\S"))

    def step(acc, s):
        own = content_words(s)
        hit = ~acc["stop"] & F.arrays_overlap(own, acc["seen"])
        return F.struct((acc["depth"] + hit.cast("int")).alias("depth"), (~hit).alias("stop"), F.when(hit, F.array_union(acc["seen"], own)).otherwise(acc["seen"]).alias("seen"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("stop"), content_words(card).alias("seen"))
    return F.aggregate(sentences, start, step, lambda acc: acc["depth"])


def drift_names(text: Column, card: Column, skip_first: bool = False) -> Column:
    """Capitalised words that are neither common nor in the card."""
    own = lambda s: F.transform(words(s), lambda w: F.regexp_replace(w, "^[\",*#()']+|[\",*#()']+$", ""))
    each = lambda s: F.slice(own(s), 2, 1_000_000) if skip_first else own(s)
    found = F.flatten(F.transform(F.split(text, "[.!?\n]"), each))
    return F.array_distinct(F.filter(found, lambda w: w.rlike("^[A-Z][a-z]{2,}$") & ~F.array_contains(strings(values.COMMON), w) & ~F.contains(card, w)))


def has_intent(kind: str, text: Column) -> Column:
    return F.exists(strings(values.INTENTS[kind]), lambda k: F.contains(F.lower(text), k))


def trade_of(text: Column, key: Column, seed: int = 17) -> Column:
    """The first trade with a word in the text; else one by keyed choice."""
    from .keyed import choice

    w = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)
    found = [F.when(F.arrays_overlap(w, strings(keys)), F.lit(trade)) for trade, keys in values.TRADES]
    return F.coalesce(*found, F.element_at(strings([t for t, _ in values.TRADES]), (choice(key, seed, len(values.TRADES)) + 1).cast("int")))


def anchor_word(text: Column) -> Column:
    """The longest word of five letters or more, the first of equals, in lower case."""
    found = F.regexp_extract_all(text, F.lit("([A-Za-z]{5,})"), 1)
    return F.lower(F.aggregate(found, F.lit(None).cast("string"), lambda a, w: F.when(a.isNull() | (F.length(w) > F.length(a)), w).otherwise(a)))


def word_chunks(text: Column, size: int = 350, skip_ends: bool = True) -> Column:
    """Chunks of ``size`` words, without the first chunk and the tail."""
    none = F.array().cast("array<int>")

    def starts(n):
        if skip_ends:
            return F.when(n >= 2 * size + 1, F.sequence(F.lit(size), n - size - 1, F.lit(size))).otherwise(none)
        return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(none)

    return let(words(text), lambda w: F.transform(starts(F.size(w)), lambda i: F.array_join(F.slice(w, i + 1, size), " ")))


def article_chunks(title: Column, body: Column, size: int = 350, least: int = 60) -> Column:
    """One chunk of a short article as it is; chunks of a long one, the title before the first only."""
    head = lambda t: F.concat(title, F.lit("\n\n"), t)

    def split(w):
        n = F.size(w)
        parts = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size)), lambda i: F.struct(i.alias("at"), F.slice(w, i + 1, size).alias("w"))), lambda p: F.size(p["w"]) >= least)
        long = F.transform(parts, lambda p: F.when(p["at"] == 0, head(F.array_join(p["w"], " "))).otherwise(F.array_join(p["w"], " ")))
        return F.when(n < least, F.array().cast("array<string>")).when(n <= size, F.array(head(body))).otherwise(long)

    return let(words(body), split)


def oracle_ok(oracle: Column, action: Column, tolerance: float = 0.3) -> Column:
    """Whether a parsed action is the oracle's: same verb and argument, a price within ``tolerance``."""
    near = F.when(oracle["verb"].isin(values.PRICED_VERBS), F.abs(action["price"] - oracle["price"]) <= tolerance * oracle["price"]).otherwise(F.lit(True))
    same = (oracle["verb"] == action["verb"]) & oracle["arg"].eqNullSafe(action["arg"]) & near
    return F.when(oracle.isNull() | action.isNull(), oracle.isNull() & action.isNull()).otherwise(same)
