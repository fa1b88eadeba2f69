import math
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tonelake.operators import features as ft

TEXTS = [
    "the kettle boils and whistles", "slow delivery and broken lid",
    "lovely kettle, lovely handle", "broken broken kettle", "sturdy lid and handle",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def by_hand(texts, k):
    words = [[w for w in t.lower().replace(",", "").split() if len(w) > 1] for t in texts]
    total = Counter(w for ws in words for w in ws)
    df = Counter(w for ws in words for w in set(ws))
    vocab = sorted(sorted(total, key=lambda w: (-total[w], w))[:k])
    idf = {w: math.log((1 + len(texts)) / (1 + df[w])) + 1 for w in vocab}
    out = {}
    for i, ws in enumerate(words):
        tf = Counter(w for w in ws if w in idf)
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in tf.items()))
        out |= {(i, w): n * idf[w] / norm for w, n in tf.items()}
    return vocab, out


@pytest.mark.parametrize("k", [3, 100])
def test_long_and_vector_forms(spark, docs, k):
    vocab, want = by_hand(TEXTS, k)
    long = {(r["id"], r["term"]): r["tfidf"] for r in ft.tfidf(docs, "id", "text", k).collect()}
    assert long == pytest.approx(want)
    model = ft.fit_tfidf(docs, "text", "features", k)
    names = [r["term"] for r in ft.feature_names(spark, model).orderBy("term_index").collect()]
    assert names == vocab
    rows = ft.transform_tfidf(model, docs).select(
        "id", F.posexplode(vector_to_array("features"))
    ).filter("col != 0").collect()
    assert {(r["id"], names[r["pos"]]): r["col"] for r in rows} == pytest.approx(want)


def test_vocabulary_cap_and_ngrams(spark, docs):
    words = spark.createDataFrame(
        [(i, " ".join(f"word{j}" for j in range(5 * i + 1, 5 * i + 6))) for i in range(3)],
        "id int, text string",
    )
    assert ft.vocabulary(ft.term_table(words, "id", "text"), 5).count() == 5
    ones = ft.fit_tfidf(docs, "text").stages[1].vocabulary
    twos = ft.fit_tfidf(docs, "text", ngram_range=(1, 2)).stages[1].vocabulary
    assert len(twos) > len(ones)
    assert "lovely kettle" in twos


def test_unseen_terms_and_repeats(spark, docs):
    model = ft.fit_tfidf(docs, "text")
    new = spark.createDataFrame([("zebra crossing",), ("lovely zebra",)], "text string")
    out = [r["features"] for r in ft.transform_tfidf(model, new).collect()]
    assert out[0].numNonzeros() == 0 and out[1].numNonzeros() == 1
    again = [r["features"] for r in ft.transform_tfidf(model, new).collect()]
    assert out == again


def test_vectorizer_survives_saving(spark, docs, folder):
    from pyspark.ml import PipelineModel

    model = ft.fit_tfidf(docs, "text", ngram_range=(1, 2))
    model.write().save(f"{folder}/v")
    again = PipelineModel.load(f"{folder}/v")
    a = ft.transform_tfidf(model, docs).select("features").collect()
    assert a == ft.transform_tfidf(again, docs).select("features").collect()


def test_guards(spark, docs):
    for bad in (0, -5):
        with pytest.raises(ValueError, match="terms is empty"):
            ft.fit_tfidf(docs, "text", max_features=bad)
    for bad in ([1, 2], (1,)):
        with pytest.raises(ValueError, match="ngram_range is a pair"):
            ft.fit_tfidf(docs, "text", ngram_range=bad)
    with pytest.raises(ValueError, match="no texts to learn"):
        ft.fit_tfidf(docs.filter("id < 0"), "text")
    with pytest.raises(RuntimeError, match="must be fitted"):
        ft.transform_tfidf(None, docs)


def test_salted_lookup_gives_the_same(spark, docs, monkeypatch):
    want = ft.tfidf(docs, "id", "text", 50).orderBy("id", "term").collect()
    monkeypatch.setattr("tonelake.operators.skew.BROADCAST_ROWS", 1)
    got = ft.tfidf(docs, "id", "text", 50).orderBy("id", "term").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_rows_that_share_a_key_have_norms_of_their_own(spark):
    df = spark.createDataFrame([(1, "aa bb"), (1, "aa"), (None, "bb bb")], "id int, text string")
    rows = ft.tfidf(df, "id", "text").collect()
    assert sum(r["tfidf"] ** 2 for r in rows) == pytest.approx(3)
    assert sum(r["tfidf"] == pytest.approx(1) for r in rows) == 2


def test_sketch_leaves_rare_terms_out(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    terms = ft.term_table(docs, "doc_id", "text", (1, 3))
    plain = {tuple(r) for r in ft.vocabulary(terms, 300).collect()}
    assert {tuple(r) for r in ft.vocabulary(terms, 300, sketch=True).collect()} == plain
    every, counted = terms.select("term").distinct().count(), ft.frequent_terms(terms, 300).count()
    assert counted < every / 20
    # full cells give bounds that are too high at first, and more candidates, not other terms
    monkeypatch.setattr(ft, "SKETCH_CELLS", 64)
    assert {tuple(r) for r in ft.vocabulary(terms, 300, sketch=True).collect()} == plain
    few = ft.term_table(docs.limit(1), "doc_id", "text")
    assert {tuple(r) for r in ft.vocabulary(few, 10**4, sketch=True).collect()} == {
        tuple(r) for r in ft.vocabulary(few, 10**4).collect()
    }


def test_numbered_and_large_vocabulary(spark, sf, monkeypatch):
    terms = ft.term_table(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    plain = {tuple(r) for r in ft.vocabulary(terms, 700).collect()}
    monkeypatch.setattr(ft, "SORTED_TERMS", 10)
    assert {tuple(r) for r in ft.vocabulary(terms, 700).collect()} == plain
    places = ft.numbered(spark.range(1000).repartition(7), [F.desc("id")], "place").collect()
    assert all(r["place"] == 999 - r["id"] for r in places)
    assert ft.numbered(spark.range(0), ["id"], "place").count() == 0


def test_vectorize_as_the_fitted_stages(spark, docs):
    vocab = ft.fit_vocabulary(docs, "text", 8, (1, 2))
    odd = docs.union(spark.createDataFrame([(0, TEXTS[1]), (7, None), (8, "")], docs.schema))
    got = ft.vectorize(odd, "text", vocab, "features", (1, 2)).collect()
    model = ft.fit_tfidf(docs, "text", "features", 8, (1, 2))
    want = ft.transform_tfidf(model, odd.na.fill("")).collect()
    key = lambda r: (r["id"], r["text"] or "", str(r["features"].indices))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert key(a) == key(b) and a["features"].size == b["features"].size == 8
        assert a["features"].values.tolist() == pytest.approx(b["features"].values.tolist())


def test_training_on_joined_vectors(spark):
    from tonelake.operators.training import fit_sentiment, predict

    texts = [("great love it", 1), ("dreadful awful thing", 0)] * 8
    df = spark.createDataFrame(texts, "text string, label int")
    vocab = ft.fit_vocabulary(df, "text", 10)
    vectors = ft.vectorize(df, "text", vocab)
    out = predict(fit_sentiment(vectors, "features"), vectors)
    assert out.filter("prediction = label").count() == 16


def test_ngrams_counted_as_numbers(spark, monkeypatch):
    """Against a loop over words, whatever documents are counted together; shorter and empty ones too."""
    texts = ["ab cd ab cd ab", "", None, "ab", "cd ab cd", "ef " * 40, "ab cd", "été ab été ab"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    for low, high in ((1, 2), (2, 2), (1, 4)):
        want = Counter()
        for i, text in enumerate(texts):
            words = (text or "").split()
            want.update(
                (i, " ".join(words[j : j + n])) for n in range(low, high + 1) for j in range(len(words) - n + 1)
            )
        for size in (1, 7, 1000):
            monkeypatch.setattr(ft, "COUNTED_WORDS", size)
            batches = docs.select("id", ft.tx.analyze("text").alias("w")).toArrow().to_batches()
            rows = [r for b in ft._count_words(low, high)(batches) for r in b.to_pylist()]
            assert len(rows) == len(want) and {(r["id"], r["term"]): r["tf"] for r in rows} == want
        rows = ft.term_table(docs, "id", "text", (low, high)).collect()
        assert len(rows) == len(want) and {(r["id"], r["term"]): r["tf"] for r in rows} == want
        counted = ft._corpus_counts(docs, ft.tx.analyze("text"), (low, high)).collect()
        uses, owners = Counter(), Counter(term for _, term in want)
        for (_, term), n in want.items():
            uses[term] += n
        assert {r["term"]: (r["total_tf"], r["doc_freq"]) for r in counted} == {t: (uses[t], owners[t]) for t in uses}


def test_only_terms_that_reach_the_cut_are_sorted(spark):
    counted = spark.range(1, 1001).selectExpr("cast(id as string) as term", "id div 10 as total_tf", "1L as doc_freq")
    # 1, 11 and 21 terms are used more than 97 times, and all ten of 97 tie with the 25th
    assert ft._above_cut(counted, 25).agg(F.min("total_tf"), F.count(F.lit(1))).first() == (97, 31)
    assert ft._above_cut(counted, 5000).count() == 1000
    assert ft._above_cut(counted.limit(0), 5).count() == 0


def test_terms_of_a_document_stay_in_its_task(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = ft.tfidf(docs, "doc_id", "text", 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
