"""Text operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import conversations as C
from colloquy.operators import grading


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*(F.col(c) for c in df.columns)).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [("*nods* Hello", "Hello"), ("Hello *nods*", "Hello"), ("a *b* c", "a c"), ("Description: a *b* c", "Description: a *b* c"), ("a * b", "a * b"), ("x\n\n*y*", "x\n\n"), ("", ""), (None, None), ("\t*nods* hi\t", "hi"), ("a\n   \nb", "a\n   \nb"), ("\xa0*waves*\x1f", ""), ("Personality:\t*x* ", "Personality:\t*x* "), ("  two \r", "two")],
)
def test_strip_beats(spark, text, want):
    assert one(spark, T.strip_beats, text) == want


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("[GOTO: Karhold]", ("GOTO", "Karhold", None)), ("[WAIT: ]", ("WAIT", None, None)), ("[WAIT:]", ("WAIT", None, None)), ("[DEAL: old axe 12]", ("DEAL", "old axe", 12)), ("[DEAL: axe]", None),
        ("[BUY: axe -3]", None), ("  [USE: key]  ", ("USE", "key", None)), ("[SING: x]", None), ("GOTO: x", None), ("[TRAVEL: a b]", ("TRAVEL", "a b", None)), ("[TALK: x]", ("TALK", "x", None)), ("[ATTACK: x]", ("ATTACK", "x", None)),
    ],
)
def test_parse_action(spark, line, want):
    got = one(spark, T.parse_action, line)
    assert (got and tuple(got)) == want


def test_truncate(spark):
    cut = lambda t: one(spark, lambda c: T.truncate_at_sentence(c, 20), t)
    assert cut("short") == "short"
    assert cut("x" * 20) == "x" * 20
    assert cut("Twelve char. and then more words") == "Twelve char."
    assert cut("A b. " + "c" * 40) == "A b. " + "c" * 15 + "."


def test_first_sentence_prefers_full_stops(spark):
    text = "x" * 35 + "! then " + "y" * 20 + ". End"
    assert one(spark, T.first_sentence, text) == text[: text.index(". ") + 1]


def test_oracle_needs_both_or_none(spark):
    ok = lambda a, b: one(spark, lambda x, y: T.oracle_ok(T.parse_action(x), T.parse_action(y)), a, b)
    assert ok(None, None) and not ok("[GOTO: x]", None) and not ok(None, "[GOTO: x]")
    assert ok("[DEAL: a 100]", "[DEAL: a 130]") and not ok("[DEAL: a 100]", "[DEAL: a 131]") and not ok("[DEAL: a 100]", "[BUY: a 100]")


@pytest.mark.parametrize(("n", "want"), [(60, 0), (350, 0), (700, 0), (701, 1), (1050, 1), (1051, 2)])
def test_word_chunks(spark, n, want):
    assert len(one(spark, T.word_chunks, " ".join(map(str, range(n))))) == want


@pytest.mark.parametrize(("n", "want"), [(59, 0), (60, 1), (350, 1), (351, 1), (410, 2)])
def test_article_chunks(spark, n, want):
    assert len(one(spark, T.article_chunks, "T", " ".join(map(str, range(n))))) == want


def test_repeats(spark):
    assert one(spark, T.repeats_ngram, "a b c a b c a b c") and not one(spark, T.repeats_ngram, "a b c a b c x y")
    assert one(spark, T.repeats_ngram, "") is False


def test_names(spark):
    assert one(spark, T.clean_name, " mara O'Neil ") == "Mara O'Neil"
    assert one(spark, T.clean_name, "ab") is None and one(spark, T.clean_name, "Spiderling") is None
    assert one(spark, T.capitalise, "hELLO World") == "Hello world"
    assert one(spark, T.anchor_word, "the older stones") == "older" or one(spark, T.anchor_word, "the older stones") == "stones"


def flaws_of(spark, answer, card, kind="identity", name="Mara Venn"):
    return one(spark, lambda a, c, n: grading.flaws(a, c, n, kind), answer, card, name)


def test_flaws_by_hand(spark):
    card = "Mara Venn sells lanterns in Karhold."
    fine = "I am Mara Venn, and my trade is lanterns."
    assert flaws_of(spark, fine, card) == []
    assert flaws_of(spark, "I am Mara Venn. I am Bob, and my trade is lanterns.", card) == ["persona_swap"]
    assert flaws_of(spark, "I'm Bob the smith. Ned is the name, says Mara.", card) == ["persona_swap", "persona_swap"]
    assert flaws_of(spark, "I am Mara, and 3 * 4 is what I sell.", card) == []
    assert flaws_of(spark, "*nods* I am called nothing today", card) == ["action_text"]
    assert flaws_of(spark, "I am mara, a seller of lanterns", card) == ["identity_missed"]
    assert flaws_of(spark, "Player: I am Mara, of the lanterns", card) == ["prefix_leak"]
    assert flaws_of(spark, "I am Mara of Karhold <START> again", card) == ["card_continuation"]
    assert flaws_of(spark, "I am Mara. Personality: warm {{user}}", card) == []
    assert flaws_of(spark, "I am Mara of Karhold ### System now", card) == ["marker_leak"]
    assert flaws_of(spark, "Mara", card) == ["intent_missed", "too_short"]
    assert flaws_of(spark, "I am Mara a b c a b c a b c", card) == ["repetition"] and flaws_of(spark, "I am Mara a b c A b c a b c", card) == []
    assert flaws_of(spark, "That one is not cheap, friend.", card, "object") == ["object_ungrounded"] and flaws_of(spark, "This lanterns lot is fine.", card, "object") == []


def test_white_space_before_marks(spark):
    """Any white space may stand before a mark; a mark inside a line is none."""
    card = "Mara keeps a shop of lanterns."
    for lead in ("", " ", "\n", "\t", "\r\n ", "\xa0", "\x1f\u2003"):
        assert flaws_of(spark, lead + "Player: I am Mara, hello", card)[0] == "prefix_leak" == flaws_of(spark, lead + "### I am Mara, hello", card)[0]
    assert flaws_of(spark, "I am Mara. Player: hello there", card) == []
    assert flaws_of(spark, "\n\t I am Mara 1234 \n\t", card) == ["too_short"] and flaws_of(spark, "I am Mara 123456", card) == []


def test_strip_as_python_does(spark):
    for text in ["\t a \n", "\x1c\x1da\x1e\x1f", "\u2003a b\u3000", "\u200ba", "a\n\n", "\x85\xa0", "", "x"]:
        assert one(spark, T.strip, text) == text.strip() and one(spark, T.strip_left, text) == text.lstrip() and one(spark, T.strip_right, text) == text.rstrip()
        assert one(spark, T.is_blank, text) == (not text.strip()) and one(spark, T.collapse, text) == " ".join(text.split())
    assert one(spark, T.clean_name, "\tmara\n") == "Mara" and one(spark, lambda t: T.truncate_at_sentence(t, 6), "word \t\nmore") == "word."
    got = one(spark, T.action_lines, "\n  Fine.\n\t[GOTO: Karhold]\n \x1f\n ok ")
    assert got.dialog == ["Fine.", " ok"] and got.actions == ["\t[GOTO: Karhold]"]
    assert one(spark, T.parse_action, "\t[DEAL: \tRope 3]\n").asDict() == {"verb": "DEAL", "arg": "Rope", "price": 3}


def reward_of(spark, answer, question, card, stopped=True, oracle=None, mode="off"):
    return one(spark, lambda a, q, c, o: grading.reward(a, q, c, F.lit(stopped), o, mode), answer, question, card, oracle)


def test_rewards_by_hand(spark):
    card, ask = "A seller of lanterns.\nMara", "What do you have for sale?"
    assert reward_of(spark, "I am Bob", ask, card) == -1.0 and reward_of(spark, "Bob is the name", ask, card) == -1.0
    assert reward_of(spark, "Mara here <START>", ask, card) == -0.5 and reward_of(spark, "They say you sell gold", ask, card) == -0.5
    fine = "Fine lanterns, for gold or silver."
    assert reward_of(spark, fine, ask, card) == 1 + 1 + 1 + 0.5 + 0.5
    assert reward_of(spark, fine, ask, card, stopped=False) == 1 + 1 + 1 - 0.5 + 0.5
    assert reward_of(spark, fine + "\nPlayer: so", ask, card, stopped=False) == 4.0
    assert reward_of(spark, "No.", ask, card) == 1 - 0.5 + 0.5
    assert reward_of(spark, "No.", "What is new?", card) == 1 + 1 + 0.5
    assert reward_of(spark, "I am Mara.", "Tell me about yourself.", card) == 1 + 1 + 0.5 + 0.5
    assert reward_of(spark, "I am tired.", "Tell me about yourself.", card) == 1 + 1 - 0.5 + 0.5
    assert reward_of(spark, "No.", "Is that thing on your table for sale?", card) == 1 + 1 - 0.5 + 0.5
    assert reward_of(spark, "*waves* No.", ask, card) == 1 - 0.5 - 0.5 + 0.5
    assert reward_of(spark, "[GOTO: Karhold]", ask, card) == pytest.approx(1 - 0.5 + 0.5 - 0.3) and reward_of(spark, "[GOTO: Nowhere]", ask, card) == 1 - 0.5 + 0.5 - 1
    assert reward_of(spark, "[GOTO: Karhold]", ask, card, oracle="[GOTO: Karhold]", mode="v2") == 1 - 0.5 + 0.5 + 1
    assert reward_of(spark, "No.", ask, card, oracle="[GOTO: Karhold]", mode="gate") == -1.0
    assert reward_of(spark, "No.", ask, card, oracle="[GOTO: Karhold]", mode="v2") == pytest.approx(1 - 0.5 + 0.5 - 0.8)
    # An oracle that doesn't parse is one all the same: it asks for no action.
    assert reward_of(spark, "No.", ask, card, oracle="stay", mode="gate") == -1.0 and reward_of(spark, "No.", ask, card, oracle="stay", mode="v2") == 1 - 0.5 + 0.5 + 1
    assert reward_of(spark, "[GOTO: Karhold]", ask, card, oracle="stay", mode="v2") == pytest.approx(1 - 0.5 + 0.5 - 0.6)
    assert reward_of(spark, "[x]", ask, card, oracle="stay", mode="gate") == 1 - 0.5 + 0.5 + 1
    assert reward_of(spark, "[GOTO: Karhold]", ask, card, oracle="stay") == pytest.approx(1 - 0.5 + 0.5 - 0.3)


def test_repeats_keep_case_and_blank_sentences_dont_count(spark):
    assert not one(spark, T.repeats_ngram, "A b c a b c a B c")
    assert one(spark, T.chain_depth, "lantern seller", " . Lantern light. ! lantern again") == 2


def test_game_cards_by_hand(spark):
    """Short turns make no card but lead in; at most three turns before; turns without text are none."""
    said = ["Good evening to everyone here.", "Yes.", None, "I think it was the miller's son.", "", "Then we should vote before nightfall.", "I agree with what was said before."]
    df = spark.createDataFrame([(1, i, "AB"[i % 2], t) for i, t in enumerate(said)], "game long, turn long, speaker string, text string")
    rows = {r.turn: r.card for r in C.game_cards(df, F.lit("d"), F.lit("s")).collect()}
    head = "Description: d\nScenario: s\n<START>\n"
    assert sorted(rows) == [0, 3, 5, 6]
    assert rows[0] == head + "A: Good evening to everyone here.\n"
    assert rows[3] == head + "A: Good evening to everyone here.\nB: Yes.\nB: I think it was the miller's son.\n"
    assert rows[6] == head + "B: Yes.\nB: I think it was the miller's son.\nB: Then we should vote before nightfall.\nA: I agree with what was said before.\n"


def test_moves_and_markers(spark):
    df = spark.createDataFrame([("chess", "e4"), ("chess", "Nf3"), ("go", None)], "title string, move string")
    assert [r.line for r in C.move_lines(df, F.col("title"), F.col("move")).collect()] == ["chess: the position calls for Nf3.\n"]
    cut = lambda t: one(spark, lambda c: T.last_line_after(c, "Player: "), t)
    assert cut("Player: a\nPlayer: b c\nMara:") == "b c" and cut("none") == "" and cut("Player: ") == ""
