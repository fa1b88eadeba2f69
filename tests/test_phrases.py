import random
import re

import pytest
from pyspark.sql import functions as F

from tonelake.functions import phrases as ph
from tonelake.functions import text as tx

WOMAN, MAN, JOINER = "\U0001F469", "\U0001F468", "\u200D"
DARK = "\U0001F3FF"
LEXICON = {
    WOMAN: "woman", MAN: "man", f"{MAN}{JOINER}{WOMAN}": "couple", f"{MAN}{JOINER}{WOMAN}{JOINER}{MAN}": "three",
    "\U0001F1F8\U0001F1EA": "Sweden", "\U0001F1EA\U0001F1F8": "Spain", "#\u20E3": "keycap_#", "\u2764\uFE0F": "red_heart",
}


def shown(spark, texts, fn):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return [r["out"] for r in df.select("id", fn("t").alias("out")).orderBy("id").collect()]


def longest(text, lexicon):
    """The same by trying every entry, the longest first, at every place."""
    keys, out, i = sorted(lexicon, key=len, reverse=True), "", 0
    while i < len(text):
        key = next((k for k in keys if text.startswith(k, i)), None)
        out += f":{lexicon[key]}:" if key else text[i]
        i += len(key) if key else 1
    return out


def test_longest_sequence_against_plain_search(spark):
    lexicon = {k.replace("\uFE0F", ""): v for k, v in LEXICON.items()}
    rng = random.Random(3)
    parts = [WOMAN, MAN, JOINER, "\U0001F1F8", "\U0001F1EA", "#", "\u20E3", "\u2764", "a", " "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(300)]
    got = shown(spark, texts, lambda c: tx.demojize(c, LEXICON))
    assert got == [longest(t, lexicon) for t in texts]


def test_variants_tones_and_names_by_rule(spark):
    texts = ["I \u2764\uFE0F it \u2764", f"{WOMAN}{DARK} {WOMAN}", "#\uFE0F\u20E3 #1", "\U0001F44D\U0001F3FD!", "\U0001F680 3\u20E3 \U0001F600", None, "plain # 3"]
    assert shown(spark, texts, lambda c: tx.demojize(c, LEXICON))[:3] == [
        "I :red_heart: it :red_heart:", ":woman_dark_skin_tone: :woman:", ":keycap_#: #1",
    ]
    assert shown(spark, texts, tx.demojize)[3:] == [
        ":thumbs_up_medium_skin_tone:!", ":rocket: :keycap_3: :grinning_face:", None, "plain # 3",
    ]
    assert shown(spark, ["x \U0001F600"], lambda c: tx.demojize(c, {})) == ["x \U0001F600"]


def test_lexicon_table(spark):
    table = spark.createDataFrame([("a", "x"), ("a", "b"), (None, "y"), ("", "z"), ("c", None)], "p string, n string")
    assert ph.read_phrases(table, "p", "n") == {"a": "b"}
    with pytest.raises(ValueError, match="at most"):
        ph.read_phrases(spark.range(5).select(F.col("id").cast("string").alias("p"), F.lit("x").alias("n")), "p", "n", 4)


def test_trie_pattern_takes_the_longest():
    rng = random.Random(8)
    for _ in range(200):
        words = {"".join(rng.choices("ab.", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 6))}
        pattern = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), ph.trie_pattern(words))
        text = "".join(rng.choices("ab.", k=8))
        match = re.match(pattern, text)
        want = max((w for w in words if text.startswith(w)), key=len, default=None)
        assert (match[0] if match else None) == want


def test_contractions_in_one_pass(spark):
    cases = {
        "Can't WON'T I'M he's Dogs' John's": "Cannot WILL NOT I AM he is Dogs' John's",
        "I shouldn't've, they'd; y'all GONNA": "I should not have, they would; you all GOING TO",
        "wanna gotta 'cause o'clock scant dont canton": "want to got to because of the clock scant do not canton",
        "rock'em 'em won’t it`s": "rock'em them will not it is",
        "nothing here": "nothing here",
    }
    assert shown(spark, list(cases), tx.expand_contractions) == list(cases.values())
    own = lambda c: tx.expand_contractions(c, {"brb": "be right back", "b": "be"})
    assert shown(spark, ["Brb b can't", None], own) == ["Be right back be can't", None]
    plan = spark.range(1).select(tx.expand_contractions(F.lit("x").cast("string")))
    assert plan.count() == 1
