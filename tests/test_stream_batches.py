from datetime import datetime, timedelta

import pytest

from tonelake.operators.training import fit_sentiment
from tonelake.streaming.batches import open_rows, score_batch_stream

BASE = datetime(2024, 1, 1)
SCHEMA = "batch_id int, item int, text string, ts timestamp"


@pytest.fixture(scope="module")
def model(spark):
    rows = [("great love", 1), ("dreadful awful", 0)] * 6
    df = spark.createDataFrame(rows, "cleaned_text string, label int")
    return fit_sentiment(df)


def row(batch, item, minute, text="great"):
    return batch, item, text, None if minute is None else BASE + timedelta(minutes=minute)


# each list is a micro-batch
ARRIVALS = [
    [row(1, 1, 0), row(2, 1, 1), row(3, 1, 2), row(None, 1, 2), row(9, 1, None)],
    [row(1, 2, 3), row(2, 2, 4, ""), row(3, 2, 5), row(3, 3, 5), row(3, 4, 6)],
    [row(4, 1, 40), row(1, 3, 7)],  # still in time for request 1: the watermark is at 1 minute
    [row(1, 4, 8), row(5, 1, 41), row(1, 5, 44)],  # late; and a new request of the same name
    [row(6, 1, 90)],
]
SCORED = {(1, 1), (1, 2), (1, 3), (4, 1), (5, 1), (1, 5)}
REJECTS = {
    (None, 1): "missing_batch", (9, 1): "missing_time", (1, 4): "late", (2, 1): "bad_item", (2, 2): "bad_item",
    (3, 1): "too_many_items", (3, 2): "too_many_items", (3, 3): "too_many_items", (3, 4): "too_many_items",
}


def start(spark, model, folder):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    score_batch_stream(
        stream, model, f"{folder}/out", f"{folder}/cp", "ts", gap="10 minutes", delay="5 minutes", max_items=3
    ).awaitTermination()


def arrive(spark, folder, arrivals, first=0):
    for n, rows in enumerate(arrivals, first):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{n}")


def check(spark, folder):
    scored = spark.read.parquet(f"{folder}/out/scored").collect()
    assert sorted((r["batch_id"], r["item"]) for r in scored) == sorted(SCORED)
    assert {r["label"] for r in scored} == {"POSITIVE"}
    rejects = spark.read.parquet(f"{folder}/out/rejects").collect()
    assert len(rejects) == len(REJECTS)
    assert {(r["batch_id"], r["item"]): r["reason"] for r in rejects} == REJECTS
    assert [(r["batch_id"], r["item"]) for r in open_rows(spark, f"{folder}/out").collect()] == [(6, 1)]


def test_batches_over_several_micro_batches(spark, model, folder):
    with pytest.raises(FileNotFoundError):
        open_rows(spark, f"{folder}/out")
    arrive(spark, folder, ARRIVALS)
    start(spark, model, folder)
    check(spark, folder)


@pytest.mark.parametrize("stop", [1, 3])
def test_same_rows_after_a_restart(spark, model, folder, stop):
    arrive(spark, folder, ARRIVALS[:stop])
    start(spark, model, folder)
    arrive(spark, folder, ARRIVALS[stop:], stop)
    start(spark, model, folder)
    check(spark, folder)


def test_a_failed_micro_batch_is_run_again(spark, model, folder, monkeypatch):
    import tonelake.streaming.batches as module

    arrive(spark, folder, ARRIVALS)
    calls, real = [], module.predict_with_labels

    def failing(model, df, text_col):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("lost")
        return real(model, df, text_col)

    monkeypatch.setattr(module, "predict_with_labels", failing)
    with pytest.raises(Exception, match="lost"):
        start(spark, model, folder)
    start(spark, model, folder)
    check(spark, folder)


def test_spans_of_time():
    from tonelake.streaming.batches import _seconds

    assert _seconds("10 minutes") == 600 and _seconds("1 day") == 86400
    with pytest.raises(ValueError):
        _seconds("soon")
