import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tonelake.llm.spelling import Tiles, near_words, spelling_variants, word_counts

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(
        long[:i] + long[i + 1 :] == short for i in range(len(long))
    )


def brute(counts, ratio=2):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-counts[v], v))
            if counts[best] >= ratio * counts[w]:
                form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def brute_counts(docs, every=97):
    out = Counter()
    for key, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 3}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé\U0001F600", min_size=1, max_size=7), max_size=40), st.integers(2, 8))
def test_tiles_against_plain_comparison(words, longest):
    """All words as one group; pairs whose longer length is another aren't asked for."""
    words = sorted(w for w in words if len(w) in (longest, longest - 1))
    if len(words) < 2:
        return
    rows = [(0, w, 1, 0) for w in words]
    p, q = Tiles(rows, longest, False).near(np.zeros(len(rows), bool))
    want = {
        (a, b) for a in words for b in words
        if a < b and max(len(a), len(b)) == longest and one_edit(a, b)
    }
    assert {(words[i], words[j]) for i, j in zip(p, q, strict=True)} == want and len(p) == len(want)


@pytest.mark.parametrize("block", [4096, 9])
def test_near_words_whole_and_in_blocks(spark, block):
    rng = np.random.default_rng(2)
    words = {"".join(rng.choice(list("abc"), rng.integers(1, 8))) for _ in range(500)} | {"", "é", "x" * 300, "x" * 299}
    counts = {w: int(rng.integers(1, 50)) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in near_words(df, block).collect()}
    want = {}
    for w in words:
        others = [v for v in words if w and v and one_edit(w, v)]
        if others:
            best = min(others, key=lambda v: (-counts[v], v))
            want[w] = (len(others), counts[best], best)
    assert got == want


def test_forms_and_roots(spark):
    counts = {
        "tonnes": 3, "tones": 7, "stones": 14, "stone": 60, "store": 120, "shore": 120, "chore": 300,
        "there": 5, "theré": 5, "lonely": 9, "aaaaa": 4, "aaaaaa": 8, "aaaaaaa": 16,
    }
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = found(spelling_variants(df))
    assert got == brute(counts)
    # counts of a repeated word add up, null words go, a clashing column stays out
    again = df.union(df).withColumn("form", df["word"]).union(
        spark.createDataFrame([(None, 5, "x")], "word string, n long, form string")
    )
    assert found(spelling_variants(again)) == brute({w: 2 * n for w, n in counts.items()})
    assert spelling_variants(df.limit(0)).collect() == []


def test_documents_to_variants(spark, odd):
    rng = np.random.default_rng(9)
    base = ["Garten", "Gärten", "Garden", "harden", "ÀÉÎ×÷ÿ", "wonder", "wander", "WANDERS", "the", "İstanbul"]
    docs = [(i, " ".join(rng.choice(base, 40)) + "_x1") for i in range(120)]
    docs += [(None, "wonder wonder wonder"), (5, None), (6, ""), (7, "longword" * 4000)] + docs[:3]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n long")
    counts = brute_counts(docs, 7)
    words = word_counts(df, damage_every=7)
    assert {r["word"]: r["n"] for r in words.collect()} == counts
    assert found(spelling_variants(words)) == brute(counts)
    plain = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert {r["word"]: r["n"] for r in word_counts(odd, 97).collect()} == brute_counts(plain)
    assert word_counts(odd.limit(0)).count() == 0


def test_whole_small_table(spark, sf):
    from tonelake.llm.queries import op13_spelling

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(op13_spelling(spark, sf)) == brute(brute_counts(docs))
