"""Scores, labels and their names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicons as lx

PROBLEM_TYPES = ("binary", "3-class")


def check_problem_type(problem_type: str) -> None:
    if problem_type not in PROBLEM_TYPES:
        raise ValueError(
            f"problem type must be one of {', '.join(PROBLEM_TYPES)}, "
            f"got {problem_type!r}"
        )


def num_classes(problem_type: str) -> int:
    check_problem_type(problem_type)
    return 2 if problem_type == "binary" else 3


def whole_score(col: Column | str) -> Column:
    """Score cut to a whole number; null where it is no number."""
    col = F.col(col) if isinstance(col, str) else col
    return col.try_cast("double").try_cast("int")


def valid_score(col: Column | str) -> Column:
    return F.coalesce(
        whole_score(col).between(lx.MIN_SCORE, lx.MAX_SCORE), F.lit(False)
    )


def score_to_label(
    col: Column | str, problem_type: str = "binary", strict: bool = True
) -> Column:
    """Class id of a 1..5 score.

    A score that is no number or out of range fails the query, or gives null
    with ``strict=False``. A null score gives null either way.
    """
    check_problem_type(problem_type)
    col = F.col(col) if isinstance(col, str) else col
    score = whole_score(col)
    if problem_type == "binary":
        label = F.when(score <= lx.NEUTRAL_SCORE, 0).otherwise(1)
    else:
        label = (
            F.when(score < lx.NEUTRAL_SCORE, 0)
            .when(score == lx.NEUTRAL_SCORE, 1)
            .otherwise(2)
        )
    bad = (
        F.raise_error(
            F.concat(
                F.lit("Invalid score, expected "),
                F.lit(f"{lx.MIN_SCORE}..{lx.MAX_SCORE}, got "),
                col.cast("string"),
            )
        ).cast("int")
        if strict
        else F.lit(None).cast("int")
    )
    return (
        F.when(col.isNull(), F.lit(None).cast("int"))
        .when(valid_score(col), label)
        .otherwise(bad)
    )


def names_for(num_labels: int) -> tuple[str, ...]:
    if num_labels == 2:
        return lx.BINARY_NAMES
    if num_labels == 3:
        return lx.THREE_CLASS_NAMES
    return tuple(f"LABEL_{i}" for i in range(num_labels))


def label_names(spark: SparkSession, num_labels: int) -> DataFrame:
    """``(label, label_name)`` lookup rows."""
    return spark.range(num_labels).select(
        F.col("id").cast("int").alias("label"),
        label_name(F.col("id"), num_labels).alias("label_name"),
    )


def label_name(
    col: Column | str, num_labels: int, names: tuple[str, ...] | None = None
) -> Column:
    """Name of a class id; ids without a name read ``LABEL_i``."""
    col = F.col(col) if isinstance(col, str) else col
    generic = F.concat(F.lit("LABEL_"), col.cast("int").cast("string"))
    if names is None and num_labels not in (2, 3):
        return generic
    known = F.array(*[F.lit(n) for n in (names or names_for(num_labels))])
    return F.coalesce(F.get(known, col.cast("int")), generic)


def with_label_name(
    df: DataFrame, label_col: str, num_labels: int, output_col: str = "label_name"
) -> DataFrame:
    return df.withColumn(output_col, label_name(label_col, num_labels))


def label_id(col: Column | str) -> Column:
    """``LABEL_i`` back to ``i``; null for any other text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract(col, r"^LABEL_(\d+)$", 1).try_cast("int")
