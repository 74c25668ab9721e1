"""Word lists, tables and patterns that results depend on."""

# Fixed values. Phrases of template text that never enter a mixture.
TOXIC = [
    "i deal in what this place provides",
    "say what you need and i will name a price",
    "you are a new friend",
    "they say you ",
    "the user is seeking",
]
# Fixed values. Words too common to show that two texts share a subject.
STOP_WORDS = ["about", "their", "would", "could", "should", "there", "which", "these", "those", "where", "every"]
# Fixed values. Card fields whose lines keep their action beats.
CARD_FIELDS = ["Description:", "Personality:", "Scenario:"]
# Fixed values. Parts of names that never enter a name pool.
NAME_BLOCKLIST = ["romanoff", "widow", "stark", "skywalker", "potter", "gandalf", "frodo", "batman", "superman", "spider", "vader"]
# Fixed values. Games played in language; all others are move logs.
LANGUAGE_GAMES = ["werewolf", "bargaining", "poker-heads-up", "word-association"]
# Fixed values. Capitalised words that are no names.
COMMON = (
    "I The A An He She It You We They But And Or If Ah Oh Yes No Well Good Safe Welcome Greetings Farewell In On At To For Of With "
    "From By As Is Are Was Were Be Been Do Does Did Have Has Had My Your His Her Their Our This That These Those There Here What When Where "
    "Who Why How Please Tell Let Now Then So Very Much Many More Most Some Any All One Two Not Just Only Even Also Still Yet Again Once Ever "
    "Never Always Sometimes Perhaps Maybe Indeed Truly"
).split()
# Fixed values. Keywords that an answer to a kind of question has.
INTENTS = {
    "identity": ["i am", "i'm", "my name", "they call me", "call me", "the name is", "my trade", "my living"],
    "sale": ["sale", "sell", "wares", "buy", "coin", "gold", "price", "offer", "goods", "stock", "deal", "trade"],
    "quest": ["quest", "task", "help", "need", "work", "do that", "want", "bring", "find", "carried", "clear"],
    "lore": ["story", "stories", "heard", "they say", "tale", "legend", "history", "old road", "folk", "mill", "bell", "chapel", "comet", "keep", "winter", "mother swore"],
    "place": ["here", "this place", "you stand", "village", "town", "city", "crossing", "friend"],
    "object": ["sale", "sell", "wares", "buy", "coin", "gold", "price", "offer", "goods", "stock", "deal", "trade", "it is", "this", "that"],
    "greeting": ["welcome", "well met", "greetings", "hello", "friend", "traveler", "visitor"],
    "self": ["i am", "i'm", "my name", "they call me", "call me", "the name is", "i have", "i've", "my life", "my work", "my family", "my trade", "my living"],
}
# Fixed values. Questions whose answers are rewarded for a keyword, and the kind of keyword.
QUESTIONS = {
    "Tell me about yourself.": "self",
    "What do you have for sale?": "sale",
    "Do you have a quest for me?": "quest",
    "Any stories from these parts?": "lore",
    "Where are we?": "place",
    "Hello.": "greeting",
    "Hello there.": "greeting",
}
# Fixed values. Words of a trade, in the order in which trades are tried.
TRADES = [
    ("blacksmith", ["smith", "forge", "anvil", "weapon", "armorer", "metal", "sword"]),
    ("alchemist", ["alchemist", "alchemy", "potion", "elixir", "apothecary", "reagent", "chemist"]),
    ("herbalist", ["herbalist", "herb", "plant", "remedy", "healer", "midwife", "gardener"]),
    ("provisioner", ["innkeeper", "inn", "tavern", "cook", "baker", "brewer", "merchant", "shopkeeper", "grocer"]),
    ("trinket-dealer", ["trinket", "curio", "peddler", "trader", "collector", "antiquities", "jeweler"]),
]
# Fixed values. Verbs of action lines; the last two take a price.
ARGUMENT_VERBS, PRICED_VERBS = ["GOTO", "TRAVEL", "TALK", "ATTACK", "USE", "WAIT"], ["DEAL", "BUY"]
# Fixed values. Roads of the world: from, to, ticks; each holds both ways.
ROADS = [
    ("Karhold", "Emberhold", 2), ("Emberhold", "Brannock", 3), ("Emberhold", "Nighthaven", 2),
    ("Nighthaven", "the Echoing Glade", 1), ("Merrow Point", "Brannock", 2),
]
# Fixed values. Adjectives and what they multiply a price by.
ADJECTIVES = [
    ("Ancient", 1.6), ("Cursed", 0.7), ("Exalted", 2.2), ("Shimmering", 1.3), ("Blood-Bound", 1.8), ("Void-Touched", 2.5),
    ("Celestial", 2.0), ("Runic", 1.5), ("Forgotten", 0.8), ("Gilded", 1.4), ("Oathbound", 1.7), ("Storm-Laid", 1.2),
]
# Fixed values. Largest counts of rows that sources give to a mixture.
CAPS = {"forge": 2500, "action_forge": 1500, "fantasy": 3000, "wiki": 900, "gamearena": 900, "werewolf": 2000, "balrog_demos": 3000, "balrog_selfplay": 1500, "template": 6000}
# Fixed values. Sources in the order in which a mixture appends them, and those whose beats stay.
SOURCE_ORDER = "real authored world sim pippa forge action_forge chains fantasy wiki gamearena werewolf balrog_demos balrog_selfplay template".split()
KEEP_BEATS = ["sim", "action_forge", "fantasy", "wiki", "balrog_demos", "balrog_selfplay"]
# Fixed values. Traits looked for in a description, in the order in which they are named; and what is said if none is found.
TRAITS = ["gruff", "patient", "proud", "gentle", "sharp", "loyal", "stubborn", "curious", "weary", "warm", "stern", "sly"]
NO_TRAITS = "watchful, plainspoken"
# Fixed values. The least share of a price that a keeper of level none takes; levels add a hundredth each.
FLOOR = 0.85
# Fixed values. Places that an action can lead to.
PLACES = ["Karhold", "Emberhold", "Nighthaven", "the Echoing Glade", "Merrow Point", "Brannock"]

# Fixed values. How an answer claims a name, or names someone; what is done rather than said.
CLAIM = "(?:I am|call me|I'm) ([A-Z][a-z]+(?: [A-Z][a-z]+)?)"
NAMED = "([A-Z][a-z]+) is the name"
BEAT = r"\*[^*]+\*"
