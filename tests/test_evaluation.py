import json

import pytest
from pyspark.sql import functions as F

from tonelake.operators import evaluation as ev
from tonelake.sources.metrics import nested_metrics, write_metrics

# Published confusion counts of two models and the scalars they give.
GOLDEN = {
    "logistic": (
        ((737, 71), (444, 4006)),
        (0.9020540129326741, 0.8403397648011642, 0.9090957426827666,
         0.8033163258418543, 0.9061767159862053),
    ),
    "transformer": (
        ((707, 101), (107, 4343)),
        (0.9604412324077596, 0.9241883512541325, 0.9605010556439867,
         0.922911547911548, 0.9254775280898877),
    ),
}


def expanded(spark):
    cells = [
        (model, y, p, n)
        for model, (counts, _) in GOLDEN.items()
        for y, row in enumerate(counts)
        for p, n in enumerate(row)
    ]
    df = spark.createDataFrame(cells, "model string, y int, p int, n int")
    return df.select("model", "y", "p", F.explode(F.sequence(F.lit(1), "n")).alias("i"))


def pairs(spark, y, p):
    return spark.createDataFrame(list(zip(y, p)), "y int, p int")


def test_golden_metrics(spark):
    got = {r["model"]: r for r in ev.summarize(expanded(spark), "y", "p", "model").collect()}
    for model, (_, want) in GOLDEN.items():
        for metric, value in zip(ev.METRICS, want):
            assert got[model][metric] == pytest.approx(value, abs=1e-12)


def test_golden_report(spark):
    report = ev.classification_report(
        expanded(spark), "y", "p", "model", names=("NEGATIVE", "POSITIVE")
    )
    rows = {(r["model"], r["class"]): r for r in report.collect()}
    line = rows["logistic", "NEGATIVE"]
    assert line["precision"] == pytest.approx(0.6240474174428451, abs=1e-12)
    assert line["recall"] == pytest.approx(0.9121287128712872, abs=1e-12)
    assert line["f1"] == pytest.approx(0.7410759175465058, abs=1e-12)
    assert line["support"] == 808
    assert rows["logistic", "weighted avg"]["precision"] == pytest.approx(
        0.9274885138200192, abs=1e-12
    )


def test_perfect_and_all_wrong(spark):
    good = ev.summarize(pairs(spark, [0, 1, 1, 0, 1], [0, 1, 1, 0, 1]), "y", "p").first()
    assert all(good[m] == 1.0 for m in ev.METRICS)
    bad = ev.summarize(pairs(spark, [0] * 5, [1] * 5), "y", "p").first()
    assert all(bad[m] == 0.0 for m in ev.METRICS)


def test_confusion_has_zeros(spark):
    df = pairs(spark, [0, 0, 2], [0, 1, 2])
    got = {(r[1], r[2]): r[3] for r in ev.confusion_matrix(df, "y", "p").collect()}
    assert len(got) == 9
    assert {k: v for k, v in got.items() if v} == {(0, 0): 1, (0, 1): 1, (2, 2): 1}


def test_compare_matches_by_key(spark):
    truth = spark.createDataFrame([(i, i % 2) for i in range(6)], "id int, y int")
    flipped = truth.select("id", (1 - F.col("y")).alias("prediction")).orderBy(F.desc("id"))
    right = truth.select("id", F.col("y").alias("prediction")).orderBy(F.desc("id"))
    long = ev.long_predictions({"right": right, "flipped": flipped}, "id")
    got = {r["model"]: r["accuracy"] for r in ev.compare_models(long, truth, "y", "id").collect()}
    assert got == {"right": 1.0, "flipped": 0.0}


def test_nested_json(spark, folder):
    metrics = nested_metrics(
        expanded(spark), "y", "p", "model", names=("NEGATIVE", "POSITIVE")
    )
    write_metrics(metrics, f"{folder}/m")
    lines = [json.loads(r[0]) for r in spark.read.text(f"{folder}/m").collect()]
    by_name = {x["model"]: x["metrics"] for x in lines}
    assert by_name["logistic"]["confusion_matrix"] == [[737, 71], [444, 4006]]
    report = by_name["transformer"]["classification_report"]
    assert report["POSITIVE"]["support"] == 4450
    assert set(report) == {"NEGATIVE", "POSITIVE", "accuracy", "macro avg", "weighted avg"}


def test_num_labels(spark):
    assert ev.infer_num_labels(pairs(spark, [0, 1, 2, 2], [0] * 4), "y").first()[0] == 3
