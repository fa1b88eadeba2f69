import json
import warnings

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tonelake.operators import scoring as sc
from tonelake.operators import training as tr
from tonelake.operators.sampling import sample_fraction
from tonelake.operators.splits import with_split
from tonelake.plans import train as plans
from tonelake.plans.prepare import prepare_reviews
from tonelake.sources import models as md
from tonelake.sources import registry as rg
from tonelake.sources.reviews import read_reviews
from tonelake.streaming.score import score_stream

GOOD = ["great kettle", "splendid finish", "adore this", "superb bargain", "truly good"]
BAD = ["dreadful kettle", "shoddy finish", "loathe this", "rotten bargain", "truly poor"]


@pytest.fixture(scope="module")
def data(spark):
    rows = [(t, y) for pair in zip(GOOD, BAD) for t, y in zip(pair, (1, 0))]
    return spark.createDataFrame(rows, "cleaned_text string, label int")


@pytest.fixture(scope="module")
def model(data):
    return tr.fit_sentiment(data)


def test_weights(spark):
    df = spark.createDataFrame([(0,), (1,), (1,), (1,)], "label int")
    got = {r["label"]: r["weight"] for r in tr.balanced_weights(df).collect()}
    assert got == pytest.approx({0: 2.0, 1: 4 / 6})


def test_fit_and_predict(spark, model, data):
    out = tr.predict(model, data).collect()
    assert sum(r["label"] == r["prediction"] for r in out) >= 9
    for r in tr.predict_proba(model, data).collect():
        assert sum(r["probabilities"]) == pytest.approx(1.0)
    with pytest.raises(RuntimeError, match="fitted"):
        tr.predict(tr.SentimentModel(), data)
    with pytest.raises(ValueError, match="at least 2 classes"):
        tr.fit_sentiment(data.filter("label = 1"))


@pytest.mark.parametrize("C, weighting", [(1.0, "balanced"), (0.3, None), (2.0, {0: 3.0})])
def test_gradient_vanishes(spark, data, C, weighting):
    """At the optimum of |w|^2 / 2 + C * sum(weight * loss)."""
    rows = data.union(data.filter("label = 1"))
    model = tr.fit_sentiment(rows, C=C, class_weight=weighting, tol=1e-12)
    fitted = model.stages.stages[-1]
    weights = weighting or {}
    if weighting == "balanced":
        weights = {r["label"]: r["weight"] for r in tr.balanced(tr.class_sizes(rows, "label")).collect()}
    out = model.transform(rows).select(
        (tr.weight_column("label", weights)
         * (vector_to_array("probability")[1] - F.col("label"))).alias("pull"),
        vector_to_array("features").alias("x"),
    ).collect()
    for j, w in enumerate(fitted.coefficients):
        assert w + C * sum(r["pull"] * r["x"][j] for r in out) == pytest.approx(0, abs=1e-4)
    assert sum(r["pull"] for r in out) == pytest.approx(0, abs=1e-4)


def test_three_classes(spark):
    texts = [("great", 2), ("awful", 0), ("okay", 1)] * 3
    df = spark.createDataFrame(texts, "cleaned_text string, label int")
    model = tr.fit_sentiment(df)
    raw = spark.createDataFrame([("<b>Great!</b>",), ("awful",), ("okay",)], "text string")
    out = sc.predict_with_labels(model, raw).collect()
    assert [r["label"] for r in out] == ["POSITIVE", "NEGATIVE", "NEUTRAL"]
    ranked = sc.predict_with_probabilities(model, raw).first()["predictions"]
    assert [p["label"] for p in ranked][0] == "POSITIVE" and len(ranked) == 3
    assert ranked[0]["score"] >= ranked[1]["score"] >= ranked[2]["score"]


def test_vectors_in(spark):
    df = spark.createDataFrame(
        [([float(i), 1.0], int(i > 4)) for i in range(10)], "a array<double>, label int"
    ).select(array_to_vector("a").alias("vector"), "label")
    model = tr.fit_sentiment(df, "vector")
    assert model.mode is None
    assert tr.predict(model, df).filter("label = prediction").count() == 10


def test_raw_text_keeps_its_columns(spark, model):
    raw = spark.createDataFrame(
        [(1, "I LOVE it <br/>", "x"), (2, "", "y")], "id int, text string, features string"
    )
    out = sc.predict_with_labels(model, raw)
    assert out.columns == ["id", "text", "features", "label", "score"]
    rows = out.collect()
    assert rows[0]["text"] == "I LOVE it <br/>" and rows[0]["label"] == "POSITIVE"
    assert len(rows) == 2


def test_save_and_load(spark, model, data, folder):
    md.save_model(model, spark, folder)
    again = md.load_model(spark, folder)
    assert again.mode == "classical" and again.label_names == ("NEGATIVE", "POSITIVE")
    a = tr.predict_proba(model, data).collect()
    assert a == tr.predict_proba(again, data).collect()
    assert md.model_info(spark, folder).first()["num_labels"] == 2


def test_external_scorer(spark):
    def load():
        import numpy as np

        return lambda x: np.array([[0.0, 3.0] if "good" in t else [2.0, -1.0] for t in x])

    df = spark.createDataFrame([("good http://x.y",), ("bad",), (None,)], "text string")
    out = sc.score_external(df, load, "text", 2).collect()
    assert [r["label"] for r in out] == ["POSITIVE", "NEGATIVE", "NEGATIVE"]
    assert out[0]["score"] == pytest.approx(0.9525741268)


def test_requests(spark, model):
    rows = [(1, "great"), (1, "dreadful"), (2, "great"), (2, " "), (3, "a" * 6000)]
    rows += [(4, "x")] * 101
    df = spark.createDataFrame(rows, "batch_id int, text string")
    out = sc.score_requests(model, df)
    assert out.predictions.count() == 2
    reasons = {(r["batch_id"], r["reason"]) for r in out.rejects.collect()}
    assert reasons == {(2, "bad_item"), (3, "bad_item"), (4, "too_many_items")}
    report = {r["batch_id"]: (r["total_processed"], r["total_rejected"]) for r in out.report.collect()}
    assert report == {1: (2, 0), 2: (0, 2), 3: (0, 1), 4: (0, 101)}


def test_stream(spark, model, folder):
    rows = [(1, "great"), (2, ""), (3, "dreadful kettle"), (4, "a" * 5001)]
    spark.createDataFrame(rows, "id int, text string").write.parquet(f"{folder}/in")
    for more in (0, 1):
        stream = spark.readStream.schema("id int, text string").parquet(f"{folder}/in")
        score_stream(stream, model, f"{folder}/out", f"{folder}/cp").awaitTermination()
        scored = {r["id"]: r["label"] for r in spark.read.parquet(f"{folder}/out/scored").collect()}
        want = {1: "POSITIVE", 3: "NEGATIVE"} | ({5: "POSITIVE"} if more else {})
        assert scored == want
        spark.createDataFrame([(5, "love it")], "id int, text string").write.mode(
            "append"
        ).parquet(f"{folder}/in")
    rejects = {r["id"]: r["reason"] for r in spark.read.parquet(f"{folder}/out/rejects").collect()}
    assert rejects == {2: "empty", 4: "too_long"}


def test_request_arrays(spark, model, folder):
    rows = [(1, ["great", "dreadful"]), (2, []), (3, ["a", " "]), (4, ["x"] * 101), (5, None)]
    df = spark.createDataFrame(rows, "batch_id int, texts array<string>")
    out = sc.score_request_arrays(model, df)
    got = {(r["batch_id"], r["item"]): r["label"] for r in out.predictions.collect()}
    assert got == {(1, 0): "POSITIVE", (1, 1): "NEGATIVE"}
    reasons = {r["batch_id"]: r["reason"] for r in out.rejects.collect()}
    assert reasons == {2: "empty_batch", 3: "bad_item", 4: "too_many_items", 5: "empty_batch"}
    df.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    score_stream(
        stream, model, f"{folder}/out", f"{folder}/cp", texts_col="texts"
    ).awaitTermination()
    assert spark.read.parquet(f"{folder}/out/scored").count() == 2
    assert spark.read.parquet(f"{folder}/out/rejects").count() == 4


CSV = '''Id,Score,Text,Other
1,5,"Great ""stuff"",
two lines",x
2,1,NA,x
3,4,None,x
4,,fine,x
5,2,"",x
6,3,plain,x
'''


def test_csv(spark, folder):
    with open(f"{folder}/r.csv", "w") as f:
        f.write(CSV)
    df = read_reviews(spark, f"{folder}/r.csv", keep=("Id",))
    rows = [tuple(r) for r in df.orderBy("Id").collect()]
    assert rows == [
        ("1", 5.0, 'Great "stuff",\ntwo lines'), ("2", 1.0, None), ("3", 4.0, None),
        ("4", None, "fine"), ("5", 2.0, None), ("6", 3.0, "plain"),
    ]
    with open(f"{folder}/bad.csv", "w") as f:
        f.write("Score,Text\nfive,a\n")
    with pytest.raises(Exception, match="Invalid score, no number: five"):
        read_reviews(spark, f"{folder}/bad.csv").collect()
    with pytest.raises(FileNotFoundError):
        read_reviews(spark, f"{folder}/none.csv")
    with pytest.raises(ValueError, match="the table has Id, Score, Text, Other"):
        read_reviews(spark, f"{folder}/r.csv", text_col="Body")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        with open(f"{folder}/r.txt", "w") as f:
            f.write("Score,Text\n5,a\n")
        read_reviews(spark, f"{folder}/r.txt")
    assert any("may not be a CSV" in str(w.message) for w in seen)


def test_prepare(spark, folder):
    with open(f"{folder}/r.csv", "w") as f:
        f.write("Score,Text\n")
        for i in range(40):
            f.write(f"{i % 5 + 1},Nice text number {i}\n")
    out = prepare_reviews(f"{folder}/r.csv", spark, sample_frac=1.0)
    assert out.columns == ["review_id", "Score", "Text", "cleaned_text", "label"]
    assert out.count() == 32
    raw = prepare_reviews(
        f"{folder}/r.csv", spark, sample_frac=0.5, problem_type="3-class",
        skip_preprocessing=True,
    )
    assert raw.count() == 20 and "cleaned_text" not in raw.columns
    with pytest.raises(ValueError, match="too few rows"):
        prepare_reviews(f"{folder}/r.csv", spark, sample_frac=0.1)
    with pytest.raises(ValueError, match="sample fraction"):
        prepare_reviews(f"{folder}/r.csv", spark, sample_frac=0)
    with pytest.raises(ValueError, match="mode"):
        prepare_reviews(f"{folder}/r.csv", spark, mode="x")


def test_registry(spark, folder):
    path = f"{folder}/sub/registry"
    assert rg.read_registry(spark, path).count() == 0
    rg.register_model(spark, path, "Model 1", "/p/1", "classical")
    rg.register_model(spark, path, "Model 2", "/p/2", "transformer")
    rg.register_model(spark, path, "Model 1", "p/1b", "transformer")
    rows = rg.read_registry(spark, path, root="/srv").orderBy("position").collect()
    assert [(r["name"], r["path"], r["type"]) for r in rows] == [
        ("Model 1", "/srv/p/1b", "transformer"), ("Model 2", "/p/2", "transformer"),
    ]
    assert rows[0]["registered_at"]
    for text in ("invalid json {{{", '{"name": "x"}', ""):
        with open(f"{folder}/broken.json", "w") as f:
            f.write(text)
        assert rg.read_registry(spark, f"{folder}/broken.json").count() == 0
    with open(f"{folder}/list.json", "w") as f:
        json.dump([{"name": "a", "path": "x", "type": "t"}, {"name": "b", "path": "y", "type": "t"}], f, indent=2)
    got = rg.read_registry(spark, f"{folder}/list.json").orderBy("position").collect()
    assert [r["name"] for r in got] == ["a", "b"]
    known = [("here", folder, "classical"), ("gone", f"{folder}/none", "classical")]
    made = rg.read_registry(spark, f"{folder}/nothing", known=known).collect()
    assert [r["name"] for r in made] == ["here"]


def test_training_job(spark, folder):
    rows = [(i, 5, f"{GOOD[i % 5]} number") for i in range(60)]
    rows += [(100 + i, 1, f"{BAD[i % 5]} number") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, Score int, Text string")
    done = plans.train_model(
        df, spark, f"{folder}/model", f"{folder}/registry", sample_frac=1.0, key="id"
    )
    metrics = done.metrics.first()["metrics"]
    assert metrics["accuracy"] > 0.9
    assert done.data.groupBy("split").count().count() == 2
    assert done.data.filter("split = 'test'").count() == 20
    entry = rg.read_registry(spark, f"{folder}/registry").first()
    assert entry["path"] == f"{folder}/model"
    again = md.load_model(spark, entry["path"])
    both = plans.holdout(
        df.withColumnRenamed("id", "review_id"), {"a": done.model, "b": again},
        test_size=0.2, output_path=f"{folder}/cmp",
    ).collect()
    assert len(both) == 2 and both[0]["accuracy"] == both[1]["accuracy"]
    assert spark.read.json(f"{folder}/cmp").count() == 2
    test_ids = {r["id"] for r in done.data.filter("split = 'test'").select("id").collect()}
    assert len(test_ids) == 20


def test_long_csv_records_are_an_error(spark, folder):
    path = f"{folder}/long.csv"
    with open(path, "w") as out:
        out.write("Score,Text\n5,fine\n4,bad,extra,columns\n")
    with pytest.raises(Exception, match="MALFORMED"):
        read_reviews(spark, path).collect()
    kept = read_reviews(spark, path, csv_options={"mode": "DROPMALFORMED"}).collect()
    assert [r["Text"] for r in kept] == ["fine"]


def test_holdout_shares_no_row_with_training(spark):
    rows = [(i, 1.0 + i % 5, f"word{i % 7} kettle {'good' if i % 5 > 2 else 'bad'}") for i in range(400)]
    reviews = spark.createDataFrame(rows, "review_id long, Score double, Text string")
    trained = plans.train_model(reviews, spark, key="review_id")
    held = {r["review_id"] for r in plans.holdout_rows(reviews, split=trained.data).collect()}
    seen = {r["review_id"] for r in trained.data.filter("split = 'train'").collect()}
    assert held and seen and not held & seen
    # a sample and a split of the same seed are independent
    sample = {r["review_id"] for r in sample_fraction(reviews, 0.2, 42, "review_id").collect()}
    test = {r["review_id"] for r in with_split(reviews, 0.2, stratify=None).filter("split = 'test'").collect()}
    assert len(sample & test) < 40


def test_cleaning_options_stay_with_the_model(spark, folder):
    rows = [(i, 1.0 + 4 * (i % 2), f"it is not {'good' if i % 2 else 'bad'}") for i in range(60)]
    reviews = spark.createDataFrame(rows, "review_id long, Score double, Text string")
    trained = plans.train_model(
        reviews, spark, f"{folder}/m", key="review_id", cleaning={"use_negation": False}
    )
    again = md.load_model(spark, f"{folder}/m")
    assert again.cleaning == trained.model.cleaning == {"use_negation": False}
    text = spark.createDataFrame([("it is not good",)], "Text string")
    assert text.select(again.clean("Text")).first()[0] == "good"
    assert sc.predict_with_labels(again, text, "Text").first()["label"] == "POSITIVE"
    with pytest.raises(ValueError, match="has no options"):
        prepare_reviews(reviews, spark, mode="transformer", cleaning={"use_negation": False})
