"""Saving and loading fitted models."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..operators.training import SentimentModel


def save_model(model: SentimentModel, spark: SparkSession, path: str) -> None:
    """Stages and a JSON description, both below ``path``."""
    if model.stages is None:
        raise RuntimeError("the model must be fitted before use")
    model.stages.write().overwrite().save(f"{path}/stages")
    spark.createDataFrame([(json.dumps(describe(model)),)], "value string").coalesce(
        1
    ).write.mode("overwrite").text(f"{path}/model_config")


def describe(model: SentimentModel) -> dict:
    return {
        "model_type": model.parameters.get("model_type", "logistic_regression"),
        "feature_type": model.parameters.get("feature_type", "tfidf"),
        "num_labels": model.num_labels,
        "label_names": list(model.label_names),
        "preprocessing": {
            "mode": model.mode, "text_col": model.text_col, "options": model.cleaning,
        },
        "parameters": model.parameters,
    }


def model_info(spark: SparkSession, path: str) -> DataFrame:
    """The stored description as one row."""
    return spark.read.json(f"{path}/model_config")


def load_model(spark: SparkSession, path: str) -> SentimentModel:
    config = json.loads(spark.read.text(f"{path}/model_config").first()[0])
    return SentimentModel(
        PipelineModel.load(f"{path}/stages"),
        config["preprocessing"]["text_col"],
        config["preprocessing"]["mode"],
        config["num_labels"],
        tuple(config["label_names"]),
        config["parameters"],
        config["preprocessing"].get("options") or {},
    )
