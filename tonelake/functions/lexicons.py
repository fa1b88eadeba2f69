"""Word lists, rule tables and limits the operators share.

The values below are fixed: results depend on them being exactly these.
"""

from __future__ import annotations

# --- fixed values: label and score domain -------------------------------
MIN_SCORE = 1
MAX_SCORE = 5
NEUTRAL_SCORE = 3
BINARY_NAMES = ("NEGATIVE", "POSITIVE")
THREE_CLASS_NAMES = ("NEGATIVE", "NEUTRAL", "POSITIVE")

# --- fixed values: request limits ---------------------------------------
MAX_TEXT_CHARS = 5000
MAX_BATCH_ITEMS = 100

# --- fixed values: whitespace as a Unicode string engine sees it ---------
# Goes inside a character class. Java's \s is ASCII only, hence the additions.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

# --- fixed values: strings a CSV reader takes for a missing value --------
MISSING_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- fixed values: words that open a negation scope ----------------------
NEGATORS = tuple(
    """never no nothing nowhere noone none not havent hasnt hadnt cant
    couldnt shouldnt wont wouldnt dont doesnt didnt isnt arent aint""".split()
)

# --- fixed values: English stop words (the purely alphabetic ones; tokens
# never hold an apostrophe by the time stop words are removed) ------------
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself
    yourselves he him his himself she her hers herself it its itself they
    them their theirs themselves what which who whom this that these those
    am is are was were be been being have has had having do does did doing
    a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from
    up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no
    nor not only own same so than too very s t can will just don should now
    d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma
    mightn mustn needn shan shouldn wasn weren won wouldn""".split()
)

# --- fixed values: contractions, any case ---------------------------------
# They are looked for once every apostrophe between two letters is a plain one.
IRREGULAR_CONTRACTIONS = {
    "can't": "cannot", "won't": "will not", "shan't": "shall not", "ain't": "are not",
    "let's": "let us", "y'all": "you all", "ma'am": "madam", "o'clock": "of the clock",
    "cant": "cannot", "wont": "will not",
}
# ends of any word
ENDINGS = {
    "n't": " not", "'re": " are", "'ve": " have", "'ll": " will", "'m": " am", "'d": " would",
}
SLANG = {
    "gonna": "going to", "wanna": "want to", "gotta": "got to", "gimme": "give me",
    "lemme": "let me", "dunno": "do not know", "coulda": "could have", "shoulda": "should have",
    "woulda": "would have", "mighta": "might have", "musta": "must have", "finna": "going to",
    "imma": "I am going to", "outta": "out of", "lotta": "lot of", "kinda": "kind of", "sorta": "sort of",
    "'cause": "because", "'em": "them", "'tis": "it is", "'twas": "it was",
}
# 's stands for "is" only after these; elsewhere it is a possessive.
IS_AFTER = tuple(
    "he she it that this there here what who where when why how".split()
)
# the same negatives typed without an apostrophe
BARE_NOT_STEMS = tuple(
    "do does did is are was were has have had could should would must".split()
)

# --- fixed values: words the tokenizer splits in two ---------------------
SPLIT_WORDS = (
    ("can", "not"), ("gim", "me"), ("gon", "na"),
    ("got", "ta"), ("lem", "me"), ("wan", "na"),
)

# --- fixed values: noun plurals no suffix rule gets right ----------------
IRREGULAR_LEMMAS = {
    "men": "man", "women": "woman", "children": "child", "people": "people",
    "feet": "foot", "teeth": "tooth", "geese": "goose", "mice": "mouse",
    "lice": "louse", "oxen": "ox", "knives": "knife", "wives": "wife",
    "lives": "life", "leaves": "leaf", "loaves": "loaf", "halves": "half",
    "shelves": "shelf", "wolves": "wolf", "thieves": "thief",
    "was": "be", "has": "have", "does": "do", "yes": "yes", "gas": "gas",
    "news": "news", "series": "series", "species": "species",
    "movies": "movie", "cookies": "cookie", "calories": "calorie",
}

# --- fixed values: endings taken off to find a lemma, by word class, in this order ---
DETACHMENTS = {
    "n": (
        ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
        ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
    ),
    "v": (
        ("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""),
        ("ing", "e"), ("ing", ""),
    ),
    "a": (("er", ""), ("est", ""), ("er", "e"), ("est", "e")),
}

# --- fixed values: named character references ----------------------------
NAMED_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
    ("&nbsp;", "\u00A0"), ("&copy;", "\u00A9"), ("&reg;", "\u00AE"),
    ("&trade;", "\u2122"), ("&middot;", "\u00B7"), ("&bull;", "\u2022"),
    ("&hellip;", "\u2026"), ("&ndash;", "\u2013"), ("&mdash;", "\u2014"),
    ("&lsquo;", "\u2018"), ("&rsquo;", "\u2019"), ("&ldquo;", "\u201C"),
    ("&rdquo;", "\u201D"), ("&laquo;", "\u00AB"), ("&raquo;", "\u00BB"),
    ("&euro;", "\u20AC"), ("&pound;", "\u00A3"), ("&deg;", "\u00B0"),
)

# --- fixed values: blocks of emoji, and the tones of skin that may follow one ---
EMOJI_BLOCKS = (
    (0x1F300, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F900, 0x1F9FF), (0x1FA70, 0x1FAFF),
)
SKIN_TONES = {
    "\U0001F3FB": "light_skin_tone", "\U0001F3FC": "medium-light_skin_tone",
    "\U0001F3FD": "medium_skin_tone", "\U0001F3FE": "medium-dark_skin_tone",
    "\U0001F3FF": "dark_skin_tone",
}

# --- fixed values: seed table of common emoji ----------------------------
EMOJI_NAMES = {
    "\U0001F600": "grinning_face",
    "\U0001F601": "beaming_face_with_smiling_eyes",
    "\U0001F602": "face_with_tears_of_joy",
    "\U0001F603": "grinning_face_with_big_eyes",
    "\U0001F604": "grinning_face_with_smiling_eyes",
    "\U0001F605": "grinning_face_with_sweat",
    "\U0001F606": "grinning_squinting_face",
    "\U0001F609": "winking_face",
    "\U0001F60A": "smiling_face_with_smiling_eyes",
    "\U0001F60B": "face_savoring_food",
    "\U0001F60D": "smiling_face_with_heart-eyes",
    "\U0001F60E": "smiling_face_with_sunglasses",
    "\U0001F610": "neutral_face",
    "\U0001F612": "unamused_face",
    "\U0001F618": "face_blowing_a_kiss",
    "\U0001F61E": "disappointed_face",
    "\U0001F620": "angry_face",
    "\U0001F621": "enraged_face",
    "\U0001F622": "crying_face",
    "\U0001F62D": "loudly_crying_face",
    "\U0001F62E": "face_with_open_mouth",
    "\U0001F631": "face_screaming_in_fear",
    "\U0001F642": "slightly_smiling_face",
    "\U0001F644": "face_with_rolling_eyes",
    "\U0001F44D": "thumbs_up",
    "\U0001F44E": "thumbs_down",
    "\U0001F44F": "clapping_hands",
    "\U0001F64F": "folded_hands",
    "\U0001F389": "party_popper",
    "\U0001F525": "fire",
    "\U0001F4AF": "hundred_points",
    "\U0001F494": "broken_heart",
    "\U0001F922": "nauseated_face",
    "\U0001F92E": "face_vomiting",
    "\U0001F970": "smiling_face_with_hearts",
    "\u2764": "red_heart",
    "\u2B50": "star",
    "\u2705": "check_mark_button",
    "\u274C": "cross_mark",
    "\u263A": "smiling_face",
}
