import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tonelake.llm.decontam import drop_contaminated, find_contamination, winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(text, items):
    words, hit, found = words_of(text), set(), set()
    for name, item in items:
        own = words_of(item)
        n = min(10, len(own))
        for p in range(len(own) - n + 1) if n else ():
            for q in range(len(words) - n + 1):
                if words[q : q + n] == own[p : p + n]:
                    hit.update(range(q, q + n))
                    found.add("" if name is None else str(name))
    return len(words), hit, sorted(found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 7))
def test_winnow(values, window):
    grams = np.array(values, np.uint64)
    want = set()
    for i in range(max(1, len(values) - window + 1) if values else 0):
        part = values[i : i + window]
        want.add(i + max(j for j, v in enumerate(part) if v == min(part)))
    assert winnow(grams, window).tolist() == sorted(want)


def test_against_brute_force(spark):
    rng = random.Random(4)
    alphabet = ["aa", "bb", "Cc"]  # few words, so spans overlap and repeat
    items = [(i, " ".join(rng.choices(alphabet, k=rng.choice([0, 1, 4, 9, 10, 11, 14, 25])) )) for i in range(24)]
    items = [(i, t if i % 3 else f"it{i}, {t}.") for i, t in items] + [(None, "q w e r t y u i o p"), (3, None)]
    items = [(i, t) for i, t in items if len(words_of(t)) != 1 and len(words_of(t)) != 4]
    docs = []
    for d in range(60):
        parts = rng.choices(alphabet, k=rng.randint(0, 30))
        if d % 4 == 0:
            parts += ["--", rng.choice(items)[1] or ""]
        docs.append((d, " ".join(parts)))
    docs.append((100, "x q w e r t y u i o p; q w e r t y u i o"))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (1 << 22, 40):
        got = {r["doc_id"]: r for r in find_contamination(df, bench, block_words=block_words).collect()}
        for key, text in docs:
            n, hit, found = brute(text, items)
            row = got[key]
            places = {p for h in row["hits"] for p in range(h["start"], h["end"])}
            assert (row["n_words"], places, row["items"]) == (n, hit, found), (key, text)
            assert row["contaminated"] == bool(hit)
        kept = {r["doc_id"] for r in drop_contaminated(df, bench, block_words=block_words).collect()}
        assert kept == {key for key, text in docs if not brute(text, items)[1]}


def test_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "words stand here"), (2, None)], "item_id long, text string")
    df = odd.withColumnRenamed("lang", "items")
    got = find_contamination(df, bench).collect()
    assert sorted(r["doc_id"] for r in got if r["contaminated"]) == [1, 1]
    assert drop_contaminated(df, bench).count() == 6
    assert drop_contaminated(df, bench).columns == df.columns
    assert find_contamination(df, bench.limit(0)).filter("contaminated").count() == 0
    assert find_contamination(df.limit(0), bench).count() == 0


def test_three_hundred_blocks(spark, odd):
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    items = [(i, say(14)) for i in range(297)] + [(297, "only five words go here"), (298, "two words"), (299, say(9))]
    docs = [(d, f"{say(20)} {items[rng.randrange(300)][1]} {say(5)}" if d % 2 else say(30)) for d in range(80)]
    docs += [(None, items[5][1]), (200, None), (201, ""), (202, items[7][1] + " " + items[7][1]), (202, items[298][1])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, row string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(df, bench, block_words=14).collect()
    shown = lambda key, n, hit, found: (str(key), n, sorted(hit), found)
    want = [shown(key, *brute(text, items)) for key, text in docs]
    places = lambda r: {p for h in r["hits"] for p in range(h["start"], h["end"])}
    assert sorted(shown(r["doc_id"], r["n_words"], places(r), r["items"]) for r in got) == sorted(want)
    kept = drop_contaminated(df, bench, block_words=14)
    assert kept.columns == df.columns and kept.count() == sum(not hit for _, _, hit, _ in want)
    assert find_contamination(odd, bench, block_words=14).count() == 8
    assert find_contamination(odd.limit(0), bench, block_words=14).count() == 0
