"""Metrics as nested JSON, one document per model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..session import materialize


def nested_metrics(
    df: DataFrame,
    y: str,
    p: str,
    by: str | None = None,
    num_labels: int | None = None,
    names: tuple[str, ...] | None = None,
) -> DataFrame:
    """``(model, metrics)``: scalars, report by class, confusion as rows.

    Everything is made of the confusion counts, which are stored once, so the rows
    are read once and the lists here are as long as there are classes.
    """
    df = materialize(ev.confusion_cells(df, y, p, by), "confusion")
    lines = ev.classification_report(df, y, p, by, num_labels, names)
    line = F.struct("precision", "recall", F.col("f1").alias("f1-score"), "support")
    report = lines.groupBy("model").agg(
        F.map_from_entries(
            F.transform(
                F.sort_array(
                    F.collect_list(
                        F.struct("row_no", "class", line.alias("line"))
                    )
                ),
                lambda r: F.struct(r["class"], r["line"]),
            )
        ).alias("classification_report")
    )
    rows = (
        ev.confusion_matrix(df, y, p, by)
        .groupBy("model", "true_label")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("pred_label", "n"))),
                lambda c: c["n"],
            ).alias("counts")
        )
    )
    matrix = rows.groupBy("model").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("true_label", "counts"))),
            lambda r: r["counts"],
        ).alias("confusion_matrix")
    )
    joined = ev.summarize(df, y, p, by).join(report, "model").join(matrix, "model")
    fields = [*ev.METRICS, "classification_report", "confusion_matrix"]
    return joined.select("model", F.struct(*fields).alias("metrics"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON line per model, predictions left out."""
    metrics.write.mode("overwrite").json(path)
