"""Class-weighted logistic regression on TF-IDF vectors."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import names_for
from ..functions.text import cleaner
from ..session import materialize, scratch_path
from .features import DEFAULT_MAX_FEATURES, fit_tfidf
from .newton import as_model, newton_steps
from .rows import require_columns
from .skew import lookup_join

ROWS_PER_TASK = 20_000
SOLVERS = ("lbfgs", "newton")


def class_sizes(df: DataFrame, label_col: str) -> DataFrame:
    """``(label, n)``, rows per class, stored."""
    return materialize(df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")), "class-sizes")


def balanced(sizes: DataFrame, output_col: str = "weight") -> DataFrame:
    """Class weights under which every class weighs the same in total."""
    n, classes = sizes.agg(F.sum("n"), F.count(F.lit(1))).first()
    weight = F.lit(float(n or 0)) / (F.lit(float(classes)) * F.col("n"))
    return sizes.withColumn(output_col, weight).drop("n")


def weight_column(label_col: str, weights: dict[Any, float]) -> Column:
    """Weight of a row's class from given weights; 1 for a class that has none."""
    if not weights:
        return F.lit(1.0)
    pairs = [F.lit(x) for c, w in weights.items() for x in (c, float(w))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(label_col)), F.lit(1.0))


def balanced_weights(
    df: DataFrame, label_col: str = "label", output_col: str = "weight"
) -> DataFrame:
    """Add the balanced class weight to each row, looked up by class."""
    weights = materialize(balanced(class_sizes(df, label_col), "__weight"), "class-weights")
    spread_by = [c for c in df.columns if c != label_col] or [label_col]
    joined = lookup_join(df, weights, label_col, spread_by)
    kept = [c for c in df.columns if c != output_col]
    return joined.select(*kept, F.coalesce("__weight", F.lit(1.0)).alias(output_col))


def fit_logistic(
    df: DataFrame,
    features_col: str = "features",
    label_col: str = "label",
    C: float = 1.0,
    max_iter: int = 1000,
    class_weight: str | dict | None = "balanced",
    tol: float = 1e-6,
    solver: str = "lbfgs",
    **kwargs: Any,
) -> LogisticRegressionModel:
    """Minimise ``|w|^2 / 2 + C * sum(weight * loss)``, intercept unpenalised.

    The Spark objective is a weighted mean, hence the rescaled penalty. ``solver`` is ``lbfgs``, the
    estimator's own, or ``newton``, fewer passes for two classes and narrow features. Further
    keyword arguments go to the estimator and override what is set here.
    """
    if solver not in SOLVERS:
        raise ValueError(f"solver must be one of {', '.join(SOLVERS)}, got {solver!r}")
    require_columns(df, [features_col, label_col])
    sizes = class_sizes(df, label_col)
    rows, classes = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if classes < 2:
        raise ValueError(f"training needs at least 2 classes, got {classes}")
    if class_weight == "balanced":
        total = float(rows)
        weighted = balanced_weights(df.select(features_col, label_col), label_col)
    else:
        weight = weight_column(label_col, class_weight or {})
        total = sizes.agg(F.sum(F.col("n") * weight)).first()[0]
        weighted = df.select(features_col, label_col, weight.alias("weight"))
    params = {
        "featuresCol": features_col,
        "labelCol": label_col,
        "weightCol": "weight",
        "regParam": 1.0 / (C * total),
        "elasticNetParam": 0.0,
        "standardization": False,
        "maxIter": max_iter,
        "tol": tol,
        "family": "binomial" if classes == 2 else "multinomial",
        # partial sums meet in two steps, so few reach the driver at once
        "aggregationDepth": 2 if rows < 10**8 else 3,
    } | kwargs
    weighted = weighted.withColumn(label_col, F.col(label_col).cast("double"))
    # what makes the features runs on all cores, once; then every iteration aggregates over
    # all partitions, none smaller than a block
    weighted = materialize(weighted, "training-rows")
    tasks = max(1, math.ceil(rows / ROWS_PER_TASK))
    if solver == "newton":
        if classes != 2 or kwargs:
            raise ValueError("newton takes two classes and no options of the estimator")
        labels = [r[0] for r in sizes.select(F.col(label_col).cast("double")).collect()]
        if sorted(labels) != [0.0, 1.0]:
            raise ValueError(f"newton takes the labels 0 and 1, got {sorted(labels)}")
        penalty = params["regParam"]
        point = newton_steps(weighted.coalesce(tasks), features_col, label_col, "weight", penalty, max_iter, tol)
        return as_model(point, features_col, label_col, "weight", df.sparkSession)
    return LogisticRegression(**params).fit(weighted.coalesce(tasks))


def detached(
    model: LogisticRegressionModel, spark: SparkSession
) -> LogisticRegressionModel:
    """The model without its training summary.

    The summary keeps the training rows and the session. It rides along in
    every scoring task, and cannot be sent once a session has observed a query.
    """
    path = scratch_path(spark, "classifier")
    model.write().save(path)
    return LogisticRegressionModel.load(path)


@dataclass
class SentimentModel:
    """Fitted stages plus what is needed to use them on raw text."""

    stages: PipelineModel | None = None
    text_col: str = "cleaned_text"
    mode: str | None = "classical"
    num_labels: int = 2
    label_names: tuple[str, ...] = ()
    parameters: dict[str, Any] = field(default_factory=dict)
    cleaning: dict[str, Any] = field(default_factory=dict)

    def clean(self, text: str | Column) -> Column:
        """Raw text as the model was trained on it."""
        if self.mode is None:
            return F.col(text) if isinstance(text, str) else text
        return cleaner(self.mode, **self.cleaning)(text)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and ``probability`` to already prepared rows."""
        if self.stages is None:
            raise RuntimeError("the model must be fitted before use")
        return self.stages.transform(df)


def fit_sentiment(
    df: DataFrame,
    text_col: str = "cleaned_text",
    label_col: str = "label",
    max_features: int = DEFAULT_MAX_FEATURES,
    ngram_range: tuple[int, int] = (1, 1),
    mode: str | None = "classical",
    label_names: tuple[str, ...] | None = None,
    **logistic: Any,
) -> SentimentModel:
    """Fit vectorizer and classifier on a text column, or on a vector column.

    A ``text_col`` that already holds vectors skips the text stages. The input
    is read once for the terms and once to vectorize; pass a stored table.
    """
    require_columns(df, [text_col, label_col])
    vectors = isinstance(df.schema[text_col].dataType, VectorUDT)
    text_stages = []
    features_col = text_col
    if not vectors:
        features_col = "features"
        vectorizer = fit_tfidf(df, text_col, features_col, max_features, ngram_range)
        text_stages = list(vectorizer.stages)
        df = vectorizer.transform(df)
    fitted = fit_logistic(df, features_col, label_col, **logistic)
    classifier = detached(fitted, df.sparkSession)
    n = classifier.numClasses
    return SentimentModel(
        PipelineModel([*text_stages, classifier]),
        text_col,
        None if vectors else mode,
        n,
        tuple(label_names or names_for(n)),
        {
            "model_type": "logistic_regression",
            "feature_type": "vector" if vectors else "tfidf",
            "max_features": max_features,
            "ngram_range": list(ngram_range),
            **logistic,
        },
    )


def predict(model: SentimentModel, df: DataFrame) -> DataFrame:
    """Add ``prediction``, the most probable class id."""
    out = model.transform(df).withColumn("prediction", F.col("prediction").cast("int"))
    return out.select(*df.columns, "prediction")


def predict_proba(model: SentimentModel, df: DataFrame) -> DataFrame:
    """Add ``probabilities``, one value per class id."""
    out = model.transform(df)
    return out.select(*df.columns, vector_to_array("probability").alias("probabilities"))
