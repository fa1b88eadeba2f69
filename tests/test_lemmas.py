import random

import pytest

from tonelake.functions.lexicons import DETACHMENTS
from tonelake.operators.lemmas import lemma_table, lemmatize_by_class


def plain(word, word_class, lexicon, exceptions):
    """The same by loops over strings."""
    known = lambda forms: [f for f in forms if (f, word_class) in lexicon]
    off = lambda forms: [
        f[: -len(old)] + new for f in forms for old, new in DETACHMENTS.get(word_class, ()) if f.endswith(old)
    ]
    if (word, word_class) in exceptions:
        found = known([word, *sorted(exceptions[word, word_class])])
        return min(found, key=len) if found else None
    forms = off([word])
    found = known([word, *forms])
    while forms and not found:
        forms = off(forms)
        found = known(forms)
    return min(found, key=len) if found else None


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_loops(spark, seed):
    rng = random.Random(seed)
    stems = ["walk", "box", "church", "lady", "leaf", "wo", "bless", "fine", "hope", "hop", "big", "s", "es"]
    ends = ["", "s", "es", "ed", "ing", "er", "est", "ies", "ses", "xes", "ves", "men", "sses", "eding", "inges"]
    words = sorted({rng.choice(stems) + rng.choice(ends) + rng.choice(ends) for _ in range(300)})
    lexicon = {(rng.choice(stems) + rng.choice(["", "", "e", "s", "y", "man"]), rng.choice("nvar")) for _ in range(60)}
    classes = {w: rng.choice("nvar") for w in words if rng.random() < 0.8}
    exceptions = {(w, c): {rng.choice(stems), rng.choice(stems)} for w, c in classes.items() if rng.random() < 0.1}
    got = lemma_table(
        spark.createDataFrame([(w,) for w in [*words, words[0], None]], "word string"),
        spark.createDataFrame([*lexicon, (None, "n")], "lemma string, word_class string"),
        spark.createDataFrame([*classes.items(), (None, "v")], "word string, word_class string"),
        spark.createDataFrame(
            [(w, c, x) for (w, c), xs in exceptions.items() for x in xs], "word string, word_class string, lemma string"
        ),
    )
    want = {w: plain(w, classes.get(w, "n"), lexicon, exceptions) for w in words}
    assert {r["word"]: r["lemma"] for r in got.collect()} == {w: x for w, x in want.items() if x is not None}


def test_tokens(spark):
    lexicon = spark.createDataFrame([("church", "n"), ("hope", "v"), ("hop", "n")], "lemma string, word_class string")
    df = spark.createDataFrame(
        [(1, ["churches", "hoping", "hops", "hops_NEG", "thing"]), (2, []), (3, None)], "id int, tokens array<string>"
    )
    classes = spark.createDataFrame([("hoping", "v")], "word string, word_class string")
    got = {r["id"]: r["tokens"] for r in lemmatize_by_class(df, "tokens", lexicon, classes).collect()}
    assert got == {1: ["church", "hope", "hop", "hops_NEG", "thing"], 2: [], 3: None}
    assert lemma_table(df.limit(0).selectExpr("'' AS word"), lexicon).count() == 0
