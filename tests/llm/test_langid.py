import random
import zlib

import numpy as np

from tonelake.llm.langid import (
    HashTable,
    LanguageModel,
    detect_language,
    held_out,
    keep_known_languages,
    letter_codes,
    train_language_model,
)


def plain_kneser_ney(counts, order):
    """Probability of a character after others, straight from the definition."""
    levels = {order: counts}
    for n in range(order - 1, 0, -1):
        kinds = {}
        for gram in levels[n + 1]:
            kinds[gram[1:]] = kinds.get(gram[1:], 0) + 1
        levels[n] = kinds
    letters = len(levels[1]) + 1

    def prob(gram):
        if not gram:
            return 1 / letters
        own = levels[len(gram)]
        ones, twos = (sum(c == k for c in own.values()) for k in (1, 2))
        cut = ones / (ones + 2 * twos) if ones and twos else 0.5
        after = {g: c for g, c in own.items() if g[:-1] == gram[:-1]}
        total = sum(after.values())
        if not total:
            return prob(gram[1:])
        return max(own.get(gram, 0) - cut, 0) / total + cut * len(after) / total * prob(gram[1:])

    return prob


def test_model_equals_the_definition():
    rng = random.Random(3)
    text = "".join(rng.choices("abc ", [5, 3, 1, 2], k=300))
    counts = {}
    for i in range(3, len(text)):
        counts[text[i - 3 : i + 1]] = counts.get(text[i - 3 : i + 1], 0) + 1
    pack = lambda g: sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(g))
    keys = np.array([pack(g) for g in counts], np.uint64)
    order = np.argsort(keys)
    model = LanguageModel.fit(["x"], [(keys[order], np.array(list(counts.values()))[order])])
    prob = plain_kneser_ney(counts, 4)
    grams = list(counts) + ["".join(rng.choices("abcz ", k=4)) for _ in range(200)]
    got = model.surprise(np.array([pack(g) for g in grams], np.uint64))[:, 0]
    assert np.allclose(got, [np.log2(prob(g)) for g in grams], atol=1e-4)
    # over all characters and the unknown one, probabilities add up to one
    assert abs(sum(prob("ab" + a + b) for a in "a" for b in "abc z") - 1) < 1e-9


def test_hash_table_finds_all():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64))
    table = HashTable(keys)
    place = table.find(np.concatenate([keys, keys + np.uint64(1)]))
    assert (table.order[place[: len(keys)]] == np.arange(len(keys))).all()
    assert set(np.flatnonzero(place[len(keys) :] >= 0)) == set(np.flatnonzero(np.isin(keys + np.uint64(1), keys)))


def test_letter_codes():
    codes, at = letter_codes(["A  b!c", None, "", "1 2", "\U0001F600ß", "\0x"])
    parts = ["".join(map(chr, codes[a:b].tolist())) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert parts == ["a b c", "", "", "", "ß", "x"]


def test_pieces_of_a_long_text_add_up():
    rng = random.Random(1)
    long = "".join(rng.choices("abcd ", k=700_000))
    codes, at = letter_codes([long])
    keys = np.unique(np.array([1, 2, 3], np.uint64))
    model = LanguageModel.fit(["x"], [(keys, np.ones(3, int))])
    assert model.entropies([long, "ab"])[1].tolist() == [len(codes), 2]


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train_language_model(docs)
    rows = detect_language(docs, model).join(docs.select("doc_id", "lang", held_out().alias("h")), "doc_id").collect()
    tested = [r for r in rows if r["h"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["h"] for r in rows)
    assert len(tested) > 150 and sum(r["lang"] == r["lang_pred"] for r in tested) >= 0.98 * len(tested)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in rows) <= 2
    foreign = [(1, "Привет, как дела? Это совсем другой язык."), (2, "zqxj vkwq " * 30), (3, "The and for with that of")]
    got = detect_language(spark.createDataFrame(foreign, "doc_id long, text string"), model).collect()
    assert [r["rejected"] for r in sorted(got, key=lambda r: r["doc_id"])] == [True, True, False]


def test_odd_rows(spark, odd):
    df = odd.withColumnRenamed("source", "score")
    model = train_language_model(df)
    got = detect_language(df, model).collect()
    assert len(got) == 8
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {2, 3, 4}
    assert all(r["score"] == 0 and r["rejected"] for r in got if r["doc_id"] in (2, 3, 4))
    assert keep_known_languages(df, model).columns == df.columns
    empty = train_language_model(df.limit(0))
    assert empty.languages == [] and detect_language(df, empty).filter("rejected").count() == 3
    assert detect_language(df.limit(0), model).count() == 0


def test_thirty_languages_of_very_different_sizes(spark, monkeypatch):
    from tonelake.llm import langid

    # 30 languages share 27,000 n-grams; ranked together, the large one would take them all
    monkeypatch.setattr(langid, "MAX_CELLS", 900 * 30 * 30)
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrst"
    syllables = {f"l{n:02d}": ["".join(rng.choices(letters, k=3)) for _ in range(25)] for n in range(30)}
    say = lambda lang: " ".join("".join(rng.choices(syllables[lang], k=2)) for _ in range(60))
    rows = [(i, say(lang), lang) for i, lang in enumerate([*syllables] * 25 + ["l07"] * 900)]
    rows += [(10_000 + i, rows[3][1], "l03") for i in range(3000)]  # copies
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = train_language_model(docs, sample_texts=200)
    assert len(model.languages) == 30
    got = detect_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("doc_id < 750").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
