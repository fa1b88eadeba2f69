"""Scoring of raw text: cleaning, prediction, names and reject handling."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import label_name
from ..functions.text import bind, cleaner
from .training import SentimentModel
from .validation import batch_reason, validate_batch


def _scored(model: SentimentModel, df: DataFrame, text_col: str) -> DataFrame:
    """Input columns plus ``prediction`` and ``probabilities``.

    The model reads a cleaned copy; the text itself is handed through.
    """
    text = model.clean(text_col)
    ready = df.select(F.struct(*df.columns).alias("row"), text.alias(model.text_col))
    return model.transform(ready).select(
        "row.*",
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability").alias("probabilities"),
    )


def predict_ids(
    model: SentimentModel, df: DataFrame, text_col: str = "text"
) -> DataFrame:
    return _scored(model, df, text_col).drop("probabilities")


def predict_with_labels(
    model: SentimentModel, df: DataFrame, text_col: str = "text"
) -> DataFrame:
    """Add ``label``, the class name, and ``score``, its probability."""
    out = _scored(model, df, text_col)
    return out.select(
        *df.columns,
        label_name("prediction", model.num_labels, model.label_names).alias("label"),
        F.get("probabilities", F.col("prediction")).alias("score"),
    )


def ranked_labels(
    probabilities: Column, num_labels: int, names: tuple[str, ...] | None = None
) -> Column:
    """``array<struct<label, score>>``, most probable first."""
    pairs = F.transform(
        probabilities,
        lambda p, i: F.struct(
            (-p).alias("order"),
            i.alias("id"),
            label_name(i, num_labels, names).alias("label"),
            p.alias("score"),
        ),
    )
    return F.transform(
        F.array_sort(pairs),
        lambda s: F.struct(s["label"].alias("label"), s["score"].alias("score")),
    )


def predict_with_probabilities(
    model: SentimentModel, df: DataFrame, text_col: str = "text"
) -> DataFrame:
    """Add ``predictions``, every class with its probability."""
    out = _scored(model, df, text_col)
    return out.select(
        *df.columns,
        ranked_labels(
            F.col("probabilities"), model.num_labels, model.label_names
        ).alias("predictions"),
    )


def softmax(logits: Column) -> Column:
    """Class scores to probabilities."""
    return bind(
        F.transform(
            logits, lambda x: F.exp(x - F.array_max(logits))
        ),
        lambda e: bind(
            F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x),
            lambda total: F.transform(e, lambda x: x / total),
        ),
    )


def score_external(
    df: DataFrame,
    make_predict: Callable[[], Callable],
    text_col: str,
    num_labels: int,
    names: tuple[str, ...] | None = None,
    logits: bool = True,
    batch_size: int = 256,
    mode: str | None = "transformer",
) -> DataFrame:
    """Score with a model of the caller's that gives one value per class.

    ``make_predict`` loads the model and runs once per Python worker; texts
    reach it in Arrow batches. Softmax and naming are done in the JVM.
    """
    text = cleaner(mode)(text_col) if mode else F.col(text_col)
    call = predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
    )
    raw = df.withColumn("raw_scores", call(F.coalesce(text, F.lit(""))))
    probabilities = softmax(F.col("raw_scores")) if logits else F.col("raw_scores")
    scored = raw.withColumn("probabilities", probabilities).withColumn(
        "prediction",
        F.array_position("probabilities", F.array_max("probabilities")).cast("int") - 1,
    )
    return scored.select(
        *df.columns,
        "prediction",
        label_name("prediction", num_labels, names).alias("label"),
        F.array_max("probabilities").alias("score"),
    )


class ScoredRequests(NamedTuple):
    predictions: DataFrame
    rejects: DataFrame
    report: DataFrame


def score_requests(
    model: SentimentModel,
    df: DataFrame,
    batch_col: str = "batch_id",
    text_col: str = "text",
) -> ScoredRequests:
    """Score the batches that pass as a whole; keep the others with a reason."""
    checked = validate_batch(df, batch_col, text_col)
    good = checked.filter(F.col("reason").isNull()).drop("reason")
    bad = checked.filter(F.col("reason").isNotNull())
    report = checked.groupBy(batch_col).agg(
        F.count_if(F.col("reason").isNull()).alias("total_processed"),
        F.count_if(F.col("reason").isNotNull()).alias("total_rejected"),
        F.max("reason").alias("reason"),
    )
    return ScoredRequests(predict_with_labels(model, good, text_col), bad, report)


def score_request_arrays(
    model: SentimentModel,
    df: DataFrame,
    batch_col: str = "batch_id",
    texts_col: str = "texts",
) -> ScoredRequests:
    """The same for requests that hold their texts in one array column.

    A request is judged within its row, so this needs no shuffle and no state;
    predictions carry the place of each text as ``item``.
    """
    checked = df.withColumn("reason", batch_reason(texts_col))
    passed = F.col("reason").isNull()
    good = checked.filter(passed).select(
        batch_col, F.posexplode(texts_col).alias("item", "text")
    )
    size = F.coalesce(F.size(texts_col), F.lit(0)).cast("bigint")
    none = F.lit(0).cast("bigint")
    report = checked.select(
        batch_col,
        F.when(passed, size).otherwise(none).alias("total_processed"),
        F.when(passed, none).otherwise(size).alias("total_rejected"),
        "reason",
    )
    return ScoredRequests(
        predict_with_labels(model, good, "text"), checked.filter(~passed), report
    )
