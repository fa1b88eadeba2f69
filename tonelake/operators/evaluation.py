"""Classification metrics, all from one table of confusion counts.

Only ``confusion_cells`` touches the rows. It leaves at most
models x classes x classes rows for everything after it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import label_name

CELLS = ("model", "true_label", "pred_label", "n")
METRICS = ("accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro")


def confusion_cells(
    df: DataFrame, y: str, p: str, by: str | None = None
) -> DataFrame:
    """``(model, true_label, pred_label, n)`` for the pairs that occur.

    Rows without a true or predicted label have nothing to compare; ``match_counts``
    tells how many there are. A table that already has these columns comes
    back as it is, so several metrics can share one that is stored.
    """
    if set(CELLS) == set(df.columns):
        return df
    model = F.col(by) if by else F.lit("model")
    paired = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull() & model.isNotNull())
    return paired.groupBy(
        model.alias("model"),
        F.col(y).cast("int").alias("true_label"),
        F.col(p).cast("int").alias("pred_label"),
    ).agg(F.count(F.lit(1)).alias("n"))


def class_counts(cells: DataFrame) -> DataFrame:
    """``(model, label, tp, predicted, support)`` over the union of labels."""
    none = F.lit(0).cast("bigint")
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(none)
    sides = F.array(
        F.struct(
            F.col("true_label").alias("label"), hit.alias("tp"),
            none.alias("predicted"), F.col("n").alias("support"),
        ),
        F.struct(
            F.col("pred_label").alias("label"), none.alias("tp"),
            F.col("n").alias("predicted"), none.alias("support"),
        ),
    )
    return (
        cells.select("model", F.inline(sides))
        .groupBy("model", "label")
        .agg(
            F.sum("tp").alias("tp"),
            F.sum("predicted").alias("predicted"),
            F.sum("support").alias("support"),
        )
    )


def confusion_matrix(
    df: DataFrame, y: str, p: str, by: str | None = None
) -> DataFrame:
    """Counts for every pair of labels a model has seen, zeros included."""
    cells = confusion_cells(df, y, p, by)
    labels = cells.groupBy("model").agg(
        F.array_sort(
            F.array_union(F.collect_set("true_label"), F.collect_set("pred_label"))
        ).alias("labels")
    )
    grid = labels.select(
        "model", "labels", F.explode("labels").alias("true_label")
    ).select("model", "true_label", F.explode("labels").alias("pred_label"))
    return grid.join(cells, ["model", "true_label", "pred_label"], "left").select(
        "model", "true_label", "pred_label", F.coalesce("n", F.lit(0)).alias("n")
    )


def accuracy(df: DataFrame, y: str, p: str, by: str | None = None) -> DataFrame:
    cells = confusion_cells(df, y, p, by)
    hits = F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0))
    return cells.groupBy("model").agg((hits / F.sum("n")).alias("accuracy"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _per_class(counts: DataFrame) -> DataFrame:
    tp, predicted, support = F.col("tp"), F.col("predicted"), F.col("support")
    return counts.select(
        "model", "label", "tp", "support",
        _ratio(tp, predicted).alias("precision"),
        _ratio(tp, support).alias("recall"),
        _ratio(2 * tp, predicted + support).alias("f1"),
    )


def precision_recall_f1(
    df: DataFrame, y: str, p: str, by: str | None = None
) -> DataFrame:
    """Per class; a metric with nothing to divide by is 0."""
    return _per_class(class_counts(confusion_cells(df, y, p, by))).drop("tp")


def _weighted(metric: str) -> Column:
    return _ratio(F.sum(F.col(metric) * F.col("support")), F.sum("support"))


def macro_average(
    df: DataFrame, y: str, p: str, by: str | None = None
) -> DataFrame:
    """Unweighted mean over classes."""
    return precision_recall_f1(df, y, p, by).groupBy("model").agg(
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
    )


def weighted_average(
    df: DataFrame, y: str, p: str, by: str | None = None
) -> DataFrame:
    """Mean over classes by number of true rows."""
    return precision_recall_f1(df, y, p, by).groupBy("model").agg(
        _weighted("precision").alias("precision_weighted"),
        _weighted("recall").alias("recall_weighted"),
        _weighted("f1").alias("f1_weighted"),
    )


def _summary(classes: DataFrame) -> DataFrame:
    return classes.groupBy("model").agg(
        _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        _weighted("f1").alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        _weighted("precision").alias("precision_weighted"),
        _weighted("recall").alias("recall_weighted"),
        F.sum("support").alias("support"),
        F.count(F.lit(1)).alias("labels"),
    )


def classification_report(
    df: DataFrame,
    y: str,
    p: str,
    by: str | None = None,
    num_labels: int | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """One row per class, then accuracy, macro avg and weighted avg.

    ``(model, row_no, class, precision, recall, f1, support)``; the accuracy row
    carries its value in ``f1``. Without names or a class count, classes are
    shown by id.
    """
    classes = _per_class(class_counts(confusion_cells(df, y, p, by)))
    if names is None and num_labels is None:
        name = F.col("label").cast("string")
    else:
        name = label_name(
            "label", num_labels or len(names), tuple(names) if names else None
        )
    lines = classes.select(
        "model", F.col("label").alias("row_no"), name.alias("class"),
        "precision", "recall", "f1", "support",
    )

    def line(place: int, title: str, *values: str | None) -> Column:
        fields = zip(("precision", "recall", "f1"), values)
        return F.struct(
            F.lit(1_000_000 + place).alias("row_no"),
            F.lit(title).alias("class"),
            *[
                (F.col(v) if v else F.lit(None).cast("double")).alias(k)
                for k, v in fields
            ],
            F.col("support").alias("support"),
        )

    totals = _summary(classes).select(
        "model",
        F.inline(
            F.array(
                line(0, "accuracy", None, None, "accuracy"),
                line(1, "macro avg", "precision_macro", "recall_macro", "f1_macro"),
                line(
                    2, "weighted avg",
                    "precision_weighted", "recall_weighted", "f1_weighted",
                ),
            )
        ),
    )
    return lines.unionByName(totals)


def summarize(
    df: DataFrame, y: str, p: str, by: str | None = None
) -> DataFrame:
    """One row per model with the five headline metrics."""
    classes = _per_class(class_counts(confusion_cells(df, y, p, by)))
    return _summary(classes).select("model", *METRICS)


def evaluate_classification(
    df: DataFrame, y: str, p: str, by: str | None = None
) -> DataFrame:
    """The headline metrics in long form: ``(model, metric, value)``."""
    return summarize(df, y, p, by).unpivot("model", list(METRICS), "metric", "value")


def long_predictions(predictions: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Stack ``(key, prediction)`` tables of several models."""
    parts = [
        df.select(key, F.lit(name).alias("model"), F.col("prediction"))
        for name, df in predictions.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def match_counts(predictions: DataFrame, truth: DataFrame, y: str, key: str) -> DataFrame:
    """What a comparison leaves out, one row per model.

    ``(model, rows, matched, unmatched, unlabelled, repeated)``: predictions, those with a
    predicted and a true label, those whose key has no truth, those without a label on
    either side, and those whose key occurs more than once in ``truth``.
    """
    known = truth.groupBy(key).agg(F.count(F.lit(1)).alias("times"), F.first(y).alias("true"))
    joined = predictions.join(known, key, "left")
    missing = F.col("times").isNull()
    no_label = F.col("true").isNull() | F.col("prediction").isNull()
    return joined.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~missing & ~no_label).alias("matched"),
        F.count_if(missing).alias("unmatched"),
        F.count_if(~missing & no_label).alias("unlabelled"),
        F.count_if(F.col("times") > 1).alias("repeated"),
    )


def compare_models(
    predictions: DataFrame, truth: DataFrame, y: str, key: str
) -> DataFrame:
    """Metrics per model, 4 decimals, over rows matched by key.

    A key that ``truth`` has more than once is an error; rows that find no
    truth are counted by ``match_counts``. All models share one aggregation.
    """
    times = F.count(F.lit(1)).alias("times")
    once = truth.groupBy(key).agg(times, F.first(y).alias(y)).select(
        key,
        F.when(F.col("times") > 1, F.raise_error(F.concat(F.lit("truth has a key twice: "), F.col(key).cast("string"))))
        .otherwise(F.col(y))
        .alias(y),
    )
    joined = predictions.join(once, key)
    rounded = [F.round(m, 4).alias(m) for m in METRICS]
    return summarize(joined, y, "prediction", "model").select("model", *rounded)


def infer_num_labels(df: DataFrame, y: str, description: DataFrame | None = None) -> DataFrame:
    """Number of classes: as a stored model description says, else distinct labels.

    ``description`` is what ``model_info`` reads; one without a class count, or
    none at all, leaves it to the data.
    """
    found = df.groupBy(y).count().agg(F.count(y).alias("num_labels"))
    if description is None or "num_labels" not in description.columns:
        return found
    stored = description.agg(F.max(F.col("num_labels").cast("bigint"))).scalar()
    return found.select(F.coalesce(stored, F.col("num_labels")).alias("num_labels"))
