"""From raw reviews to labelled, cleaned rows."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import check_problem_type, score_to_label
from ..functions.text import cleaner
from ..operators.cleaning import clean_frame
from ..operators.rows import (
    drop_neutral,
    drop_null_rows,
    project_review,
    require_min_rows,
)
from ..operators.sampling import check_fraction, sample_fraction
from ..session import materialize, spread
from ..sources.csvranges import can_split
from ..sources.reviews import read_reviews

MIN_ROWS = 10


def prepare_reviews(
    source: DataFrame | str,
    spark: SparkSession | None = None,
    sample_frac: float = 1.0,
    problem_type: str = "binary",
    mode: str = "classical",
    seed: int = 42,
    skip_preprocessing: bool = False,
    key: str | None = None,
    text_col: str = "Text",
    score_col: str = "Score",
    min_rows: int = MIN_ROWS,
    fmt: str = "csv",
    multi_line: bool = True,
    csv_options: Mapping[str, str | bool] | None = None,
    cleaning: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Key, score, text, ``cleaned_text`` and ``label``.

    Null rows go first, then the sample is drawn, then neutral reviews are
    dropped for binary labels, and only what is left is cleaned. Without a key
    column the rows are numbered as ``review_id`` and stored, so that every
    later pass sees the same numbers. ``cleaning`` holds options of ``clean_classical``.
    """
    check_problem_type(problem_type)
    check_fraction(sample_frac)
    cleaning = dict(cleaning or {})
    cleaner(mode, **cleaning)
    keep = (key,) if key else ()
    if isinstance(source, str):
        spark = spark or SparkSession.active()
        df = read_reviews(
            spark, source, text_col, score_col, fmt, multi_line, keep, csv_options
        )
    else:
        df = project_review(source, score_col, text_col, keep)
    df = drop_null_rows(df, [score_col, text_col])
    stored = key is None
    if stored:
        key = "review_id"
        df = df.select(F.monotonically_increasing_id().alias(key), "*")
    if isinstance(source, str):
        df = spread(df, source, splittable=fmt != "csv" or not multi_line or can_split(csv_options))
    if stored:
        df = materialize(df, "reviews")
    df = sample_fraction(df, sample_frac, seed, key)
    if problem_type == "binary":
        df = drop_neutral(df, score_col)
    require_min_rows(df, min_rows)
    if not skip_preprocessing:
        df = clean_frame(df, mode, text_col, "cleaned_text", **cleaning)
    return df.withColumn("label", score_to_label(score_col, problem_type))
