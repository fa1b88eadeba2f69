"""Training and hold-out jobs."""

from __future__ import annotations

import json
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import names_for, num_classes, score_to_label
from ..operators import evaluation as ev
from ..operators.features import DEFAULT_MAX_FEATURES
from ..operators.rows import drop_neutral, drop_null_rows, project_review
from ..operators.scoring import predict_ids
from ..operators.skew import narrow_join
from ..operators.splits import part, with_split
from ..operators.training import SentimentModel, fit_sentiment, predict
from ..session import materialize, scratch_path
from ..sources.metrics import nested_metrics, write_metrics
from ..sources.models import save_model
from ..sources.registry import register_model
from .prepare import prepare_reviews

# Fixed value: the name under which the model is listed
MODEL_NAME = "Logistic Regression + TF-IDF"


class Trained(NamedTuple):
    model: SentimentModel
    predictions: DataFrame
    metrics: DataFrame
    data: DataFrame


def store_split(df: DataFrame, name: str = "split") -> DataFrame:
    """Write a split table partitioned by split: each part reads only itself."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy("split").parquet(path)
    return df.sparkSession.read.parquet(path)


def train_model(
    source: DataFrame | str,
    spark: SparkSession | None = None,
    output_dir: str | None = None,
    registry: str | None = None,
    test_size: float = 0.2,
    max_features: int = DEFAULT_MAX_FEATURES,
    ngram_range: tuple[int, int] = (1, 1),
    seed: int = 42,
    sample_frac: float = 1.0,
    problem_type: str = "binary",
    mode: str = "classical",
    key: str | None = None,
    cleaning: dict[str, Any] | None = None,
    reading: dict[str, Any] | None = None,
    **logistic: Any,
) -> Trained:
    """Prepare, split, fit and evaluate; save and register where asked to.

    Texts are cleaned once and stored; split, vectorizer, classifier and
    evaluation read the stored table. ``cleaning`` holds options of ``clean_classical``, which
    the model keeps for scoring; ``reading`` holds ``fmt``, ``multi_line`` and ``csv_options``.
    """
    if registry and not output_dir:
        raise ValueError("a model to be registered needs an output_dir")
    spark = spark or SparkSession.active()
    prepared = prepare_reviews(
        source, spark, sample_frac, problem_type, mode, seed, key=key,
        cleaning=cleaning, **(reading or {}),
    )
    key = key or "review_id"
    slim = materialize(prepared.select(key, "cleaned_text", "label"), "prepared")
    data = store_split(with_split(slim, test_size, None, "label", seed, key))
    names = names_for(num_classes(problem_type))
    model = fit_sentiment(
        part(data, "train"), "cleaned_text", "label", max_features, ngram_range,
        mode, names, **logistic,
    )
    model.cleaning = dict(cleaning or {})
    model.parameters.update(test_size=test_size, random_state=seed)
    # scored once; the metrics and the caller read the stored rows
    predictions = materialize(predict(model, part(data, "test")), "predictions")
    metrics = nested_metrics(
        predictions.withColumn("model", F.lit(MODEL_NAME)),
        "label", "prediction", "model", names=names,
    )
    if output_dir:
        save_model(model, spark, output_dir)
    if registry:
        register_model(spark, registry, MODEL_NAME, output_dir or "", "classical")
    return Trained(model, predictions, metrics, data)


def evaluate_model(
    model: SentimentModel, df: DataFrame, text_col: str, label_col: str = "label"
) -> tuple[DataFrame, DataFrame]:
    """``(predictions, metrics)`` of one model on the labelled rows of raw text.

    Labelled rows are scored once and stored, without their texts.
    """
    rows = predict_ids(model, df.filter(F.col(label_col).isNotNull()), text_col)
    kept = [c for c in rows.columns if c != text_col]
    predictions = materialize(rows.select(*kept), "predictions")
    return predictions, ev.evaluate_classification(predictions, label_col, "prediction")


def holdout_rows(
    reviews: DataFrame,
    key: str = "review_id",
    split: DataFrame | None = None,
    test_size: float = 0.1,
    problem_type: str = "binary",
    seed: int = 42,
) -> DataFrame:
    """Key, text and label of the rows to evaluate on.

    With ``split``, the table that training stored (``Trained.data``), its test rows and
    their labels. Without, the reviews are split anew by key and seed: that suits models
    that were trained elsewhere, as rows one of these has seen can't be told.
    """
    texts = drop_null_rows(project_review(reviews, keep=(key,)), ["Score", "Text"])
    if split is not None:
        test = part(split, "test").select(key, "label")
        return narrow_join(texts.select(key, "Text"), test, key)
    if problem_type == "binary":
        texts = drop_neutral(texts)
    texts = texts.withColumn("label", score_to_label("Score", problem_type))
    return part(with_split(texts, test_size, None, "label", seed, key), "test").select(key, "Text", "label")


def holdout(
    reviews: DataFrame,
    models: dict[str, SentimentModel | DataFrame],
    key: str = "review_id",
    test_size: float = 0.1,
    problem_type: str = "binary",
    seed: int = 42,
    output_path: str | None = None,
    split: DataFrame | None = None,
) -> DataFrame:
    """Compare models on rows that they haven't seen, see ``holdout_rows``.

    A model is a fitted one, or a table of ``key`` and ``prediction`` made by any other
    scorer. Predictions for other rows than the held-out ones are left out.
    """
    rows = holdout_rows(reviews, key, split, test_size, problem_type, seed)
    fitted = {n: m for n, m in models.items() if isinstance(m, SentimentModel)}
    # cleaned once per way of cleaning, however many models share it
    ways = {(m.mode, json.dumps(m.cleaning, sort_keys=True)): m for m in fitted.values()}
    column = {way: f"clean_{i}" for i, way in enumerate(ways)}
    cleaned = [m.clean("Text").alias(column[way]) for way, m in ways.items()]
    test = materialize(rows.select(key, "Text", "label", *cleaned), "holdout")
    scored = {
        name: predict(
            m,
            test.select(
                key, F.col(column[m.mode, json.dumps(m.cleaning, sort_keys=True)]).alias(m.text_col)
            ),
        )
        for name, m in fitted.items()
    }
    for name, table in models.items():
        if name not in fitted:
            scored[name] = table.select(key, "prediction").join(test.select(key), key, "left_semi")
    # scored once for the report and the comparison
    predictions = materialize(ev.long_predictions(scored, key), "predictions")
    truth = test.select(key, "label")
    if output_path:
        joined = predictions.join(truth, key)
        names = names_for(num_classes(problem_type))
        write_metrics(
            nested_metrics(joined, "label", "prediction", "model", names=names),
            output_path,
        )
    return ev.compare_models(predictions, truth, "label", key)
