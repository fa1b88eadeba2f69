import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tonelake.functions import labels as lb
from tonelake.operators import rows as rw
from tonelake.operators import sampling
from tonelake.operators import splits as sp
from tonelake.operators import training as tr
from tonelake.operators import validation as vl
from tonelake.operators.sampling import order_hash, sample_fraction
from tonelake.operators.skew import attach_group_facts


def scores(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "s double")


def test_labels(spark):
    df = scores(spark, [1, 2, 3, 4, 5, 4.9, None])
    two = [r[0] for r in df.select(lb.score_to_label("s")).collect()]
    three = [r[0] for r in df.select(lb.score_to_label("s", "3-class")).collect()]
    assert two == [0, 0, 0, 1, 1, 1, None]
    assert three == [0, 0, 1, 2, 2, 2, None]


@pytest.mark.parametrize("value", ["0", "6", "-1", "x"])
def test_bad_scores(spark, value):
    df = spark.createDataFrame([(value,)], "s string")
    assert df.select(lb.score_to_label("s", strict=False)).first()[0] is None
    with pytest.raises(Exception, match="Invalid score"):
        df.select(lb.score_to_label("s")).collect()


def test_problem_type_and_names(spark):
    with pytest.raises(ValueError, match="problem type"):
        lb.score_to_label("s", "4-class")
    assert lb.names_for(2) == ("NEGATIVE", "POSITIVE")
    assert lb.names_for(3) == ("NEGATIVE", "NEUTRAL", "POSITIVE")
    assert lb.names_for(4)[3] == "LABEL_3"
    rows = lb.label_names(spark, 10).collect()
    assert [r["label_name"] for r in rows] == [f"LABEL_{i}" for i in range(10)]


def test_row_filters(spark):
    df = spark.createDataFrame(
        [(1, "a"), (3, "b"), (None, "c"), (5, None), (4, " ")], "Score int, Text string"
    )
    assert rw.drop_null_rows(df).count() == 3
    assert rw.drop_neutral(df).count() == 3
    seen = Observation()
    assert rw.drop_empty_text(df, "Text", seen).count() == 3
    assert seen.get == {"rows": 5, "removed": 2}
    with pytest.raises(ValueError, match="too few rows: at least 6 needed, 5 given"):
        rw.require_min_rows(df, 6)
    with pytest.raises(ValueError, match="the table has Score, Text"):
        rw.require_columns(df, ["Body"])


@pytest.mark.parametrize("n, frac", [(1000, 0.1), (7, 0.5), (25, 0.5), (10, 0.01)])
def test_sample_size_and_order(spark, n, frac):
    df = spark.range(n).withColumnRenamed("id", "k")
    got = {r["k"] for r in sample_fraction(df, frac, 42, "k").collect()}
    ranked = df.orderBy(order_hash("k", "42|sample")).limit(round(n * frac)).collect()
    assert got == {r["k"] for r in ranked}


def test_copies_of_a_key_stay_together(spark):
    """A third of all rows under one key."""
    key = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id"))
    df = spark.range(3000).select(key.alias("k"), F.col("id"))
    out = sample_fraction(df, 0.5, 42, "k").groupBy("k").count().collect()
    sizes = {r["k"]: r["count"] for r in out}
    assert sizes.get(-1, 1000) == 1000
    assert 1500 <= sum(sizes.values()) < 2500


def test_sample_guards(spark):
    df = spark.range(10)
    assert sample_fraction(df, 1.0, 1, "id") is df
    for bad in (0, -0.1, 1.5):
        with pytest.raises(ValueError, match="sample fraction"):
            sample_fraction(df, bad, 1, "id")
    other = sample_fraction(spark.range(1000), 0.1, 7, "id").collect()
    assert other != sample_fraction(spark.range(1000), 0.1, 8, "id").collect()


def labelled(spark, n, heavy=0.9):
    label = F.when(F.col("id") < n * heavy, 1).otherwise(0)
    return spark.range(n).select(F.col("id").alias("review_id"), label.alias("label"))


def test_split_sizes(spark):
    df = labelled(spark, 100, 0.5)
    train, test = sp.split_train_test(df, 0.2)
    assert (train.count(), test.count()) == (80, 20)
    parts = sp.split_train_val_test(df, 0.2, 0.1)
    assert [p.count() for p in parts] == [72, 8, 20]
    keys = [{r["review_id"] for r in p.collect()} for p in parts]
    assert len(set.union(*keys)) == 100


def test_split_is_stratified_and_repeatable(spark):
    df = labelled(spark, 997, 0.83)
    out = sp.with_split(df, 0.2, 0.1, seed=3).collect()
    assert sorted(out) == sorted(
        sp.with_split(df.repartition(5), 0.2, 0.1, seed=3).collect()
    )
    for name in ("train", "val", "test"):
        rows = [r for r in out if r["split"] == name]
        share = sum(r["label"] for r in rows) / len(rows)
        assert abs(share - 0.83) < 0.01
    two = {r["review_id"] for r in sp.with_split(df, 0.2, seed=3).collect() if r["split"] == "test"}
    assert two == {r["review_id"] for r in out if r["split"] == "test"}


def test_split_does_not_shuffle_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out = sp.with_split(df, 0.2, stratify="lang", key="doc_id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    top = plan.split("BroadcastExchange")[0]
    assert "Exchange" not in top.replace("BroadcastExchange", "")


def test_quotas(spark):
    rng = random.Random(1)
    for _ in range(6):
        sizes = {i: rng.randint(1, 50) for i in range(rng.randint(1, 6))}
        n = sum(sizes.values())
        total = rng.randint(0, n)
        df = spark.createDataFrame(list(sizes.items()), "class int, n long")
        got = {r["class"]: r["quota"] for r in sp.quotas(df, total).collect()}
        assert sum(got.values()) == total
        assert all(abs(got[c] - sizes[c] * total / n) < 1 for c in sizes)


def test_very_many_classes(spark):
    df = spark.range(100_000).select(
        F.col("id").alias("review_id"), (F.col("id") % 50_000).alias("label")
    )
    out = sp.with_split(df, 0.5).groupBy("label").agg(
        F.count_if(F.col("split") == "test").alias("test"), F.count("*").alias("n")
    )
    assert out.filter("test <> 1 or n <> 2").count() == 0
    weighted = tr.balanced_weights(df)
    assert weighted.count() == 100_000 and weighted.filter("weight <> 1.0").count() == 0


def test_cut_points_need_more_digits(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 1)
    df = spark.range(30_000).withColumnRenamed("id", "k")
    want = {
        r["k"] for r in df.orderBy(order_hash("k", "42|sample")).limit(10_000).collect()
    }
    got = sample_fraction(df, 1 / 3, 42, "k").collect()
    assert {r["k"] for r in got} == want


def test_split_guards(spark):
    with pytest.raises(ValueError, match="at least 10 needed, 1 given"):
        sp.split_train_test(labelled(spark, 1))
    with pytest.raises(ValueError, match="at least 20 needed, 15 given"):
        sp.split_train_val_test(labelled(spark, 15, 0.5))
    for bad in (0, 1, 1.2):
        with pytest.raises(ValueError, match="test_size is a share"):
            sp.split_train_test(labelled(spark, 50), bad)
    with pytest.raises(ValueError, match="leave nothing to train on"):
        sp.split_train_val_test(labelled(spark, 50), 0.6, 0.5)
    with pytest.raises(ValueError, match="too few rows"):
        sp.split_train_test(labelled(spark, 15, 0.5), 0.1)
    with pytest.raises(ValueError, match="at least 2 rows"):
        sp.split_train_test(labelled(spark, 50, 0.97))


def test_check_split_finds_shared_keys(spark):
    df = spark.createDataFrame(
        [(1, 0, "train"), (1, 0, "test"), (2, 1, "train")],
        "review_id int, label int, split string",
    )
    assert sp.check_split(df).first()["shared_keys"] == 1


def test_text_reasons(spark):
    df = spark.createDataFrame(
        [("fine",), ("",), (None,), (" \t ",), ("a" * 5000,), ("a" * 5001,)], "t string"
    )
    got = [r["reason"] for r in vl.validate_text(df, "t").collect()]
    assert got == [None, "empty", "empty", "whitespace_only", None, "too_long"]


def test_batch_arrays(spark):
    rows = [(["a", "b"],), ([],), (None,), (["a"] * 101,), (["a"] * 100,), (["a", " "],)]
    df = spark.createDataFrame(rows, "t array<string>")
    got = [r[0] for r in df.select(vl.batch_reason("t")).collect()]
    assert got == [None, "empty_batch", "empty_batch", "too_many_items", None, "bad_item"]


@pytest.mark.parametrize("hot_rows, few", [(1, 0), (50, 0), (10_000, 0), (50, None)])
def test_batches_with_one_huge_batch(spark, hot_rows, few):
    """A third of all rows in one batch, with and without the hot path."""
    rows = [("huge", f"text {i}") for i in range(300)]
    rows += [(f"b{i % 60}", "" if i == 7 else f"t {i}") for i in range(600)]
    rows += [(None, "lost")]
    df = spark.createDataFrame(rows, "batch string, text string")
    out = vl.validate_batch(df, "batch", "text", hot_rows=hot_rows, max_broadcast_rows=few).collect()
    assert len(out) == len(rows)
    for r in out:
        want = {"huge": "too_many_items", "b7": "bad_item", None: "missing_batch"}
        assert r["reason"] == want.get(r["batch"])


def test_hot_rows_are_spread(spark):
    rows = spark.range(1000).select(F.lit(1).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"))
    out = attach_group_facts(rows, facts, "k", "n", F.col("id"), hot_rows=10)
    assert out.filter("n = 1000").count() == 1000


def test_scores_are_marked(spark):
    df = spark.createDataFrame([("5",), ("5.9",), ("6",), ("x",), (None,)], "Score string")
    got = [r["reason"] for r in vl.validate_score(df).collect()]
    assert got == [None, None, "invalid_score", "invalid_score", "invalid_score"]


def test_stage_counts(spark):
    out = rw.stage_counts(
        spark.range(10), [("big", F.col("id") > 3), ("even", F.col("id") % 2 == 0)]
    )
    assert [(r["stage"], r["rows"]) for r in out.orderBy("stage_no").collect()] == [
        ("load", 10), ("big", 6), ("even", 3),
    ]
