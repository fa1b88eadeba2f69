import datetime as dt
import random

import pandas as pd
import pytest

from tonelake.operators import profiling as pr


def percentiles(spark, values, size=pr.SKETCH_SIZE, max_inside=pr.MAX_INSIDE):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    probs = (0.25, 0.5, 0.75, 0.9)
    got = pr.exact_percentiles(df, ["x"], probs, size, max_inside).collect()
    return {r["prob"]: r["value"] for r in got}, probs


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 10, 101, 2000])
@pytest.mark.parametrize("size", [100, 10_000])
def test_percentiles(spark, n, size):
    rng = random.Random(n)
    values = [rng.choice([7.0, rng.random() * 10, float(rng.randint(0, 5))]) for _ in range(n)]
    got, probs = percentiles(spark, values, size)
    want = pd.Series(values).quantile(list(probs))
    assert got == pytest.approx(dict(want))


@pytest.mark.parametrize("repeat", [1, 30])
def test_brackets_are_narrowed(spark, repeat):
    rng = random.Random(5)
    values = [float(rng.randint(0, 3000 // repeat)) for _ in range(5000)]
    got, probs = percentiles(spark, values, 100, 20)
    assert got == pytest.approx(dict(pd.Series(values).quantile(list(probs))))


def test_percentile_between_two_heavy_values(spark):
    values = [1.0] * 500 + [2.0] * 500
    got, probs = percentiles(spark, values, 20, 5)
    assert got == pytest.approx(dict(pd.Series(values).quantile(list(probs))))


def test_one_value_holds_most_rows(spark):
    values = [5.0] * 900 + [float(i) for i in range(100)]
    got, probs = percentiles(spark, values, 50)
    assert got == pytest.approx(dict(pd.Series(values).quantile(list(probs))))


def test_describe_against_pandas(spark):
    rows = [
        (i, float(i % 7) if i % 9 else None, f"v{i % 3}", dt.datetime(2024, 1, 1 + i % 20))
        for i in range(50)
    ]
    df = spark.createDataFrame(rows, "i int, x double, s string, t timestamp")
    got = {r["column_name"]: r for r in pr.describe_all(df).collect()}
    pdf = pd.DataFrame(rows, columns=["i", "x", "s", "t"])
    for c in ("i", "x"):
        want = pdf[c].describe()
        names = {"mean": "mean", "std": "std", "min": "min", "p25": "25%", "p50": "50%",
                 "p75": "75%", "max": "max", "count": "count"}
        for ours, theirs in names.items():
            assert got[c][ours] == pytest.approx(want[theirs])
    assert (got["s"]["unique"], got["s"]["top"], got["s"]["freq"]) == (3, "v1", 17) or (
        got["s"]["freq"] == 17 and got["s"]["top"] in ("v0", "v1")
    )
    assert got["t"]["kind"] == "date" and got["t"]["unique"] == 20


def test_small_profiles(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (2, None, None), (3, "b", 1.5)], "id int, s string, x double"
    )
    nulls = {r["column_name"]: r["nulls"] for r in pr.null_counts(df).collect()}
    assert nulls == {"id": 0, "s": 1, "x": 2}
    info = {r["column_name"]: (r["kind"], r["non_null"]) for r in pr.column_info(df).collect()}
    assert info == {"id": ("numeric", 3), "s": ("categorical", 2), "x": ("numeric", 1)}
    assert tuple(pr.shape(df).first()) == (3, 3)
    assert [r["record"] for r in pr.head_records(df, 1, "id").collect()] == ['{"id":1,"s":"a"}']


def test_label_and_split_profiles(spark):
    df = spark.createDataFrame(
        [(1, "train"), (1, "train"), (0, "test")], "label int, split string"
    )
    top = pr.label_distribution(df).first()
    assert (top["label"], top["n"]) == (1, 2)
    rolled = {(r["split"], r["label"]): r["n"] for r in pr.split_profile(df).collect()}
    assert rolled[(None, None)] == 3 and rolled[("train", None)] == 2
