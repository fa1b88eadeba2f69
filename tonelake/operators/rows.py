"""Row filters, guards and stage counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons as lx
from ..functions.text import is_blank


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(
            f"no column {', '.join(map(repr, missing))}; "
            f"the table has {', '.join(df.columns)}"
        )
    return df


def project_review(
    df: DataFrame, score_col: str = "Score", text_col: str = "Text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Only the score, the text and the named extra columns."""
    require_columns(df, [score_col, text_col])
    return df.select(*keep, score_col, text_col)


def drop_null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null or NaN in ``cols``.

    A condition for each column, so that each is checked where the column comes from.
    """
    for field in df.schema.fields:
        if cols is None or field.name in cols:
            df = df.filter(F.col(field.name).isNotNull())
            if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
                df = df.filter(~F.isnan(field.name))
    return df


def drop_neutral(df: DataFrame, score_col: str = "Score") -> DataFrame:
    return df.filter(F.col(score_col) != lx.NEUTRAL_SCORE)


def drop_empty_text(
    df: DataFrame, col: str, observation: Observation | None = None
) -> DataFrame:
    """Rows with something to read; an observation gets rows and removed."""
    if observation is not None:
        df = df.observe(
            observation,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(is_blank(col)).alias("removed"),
        )
    return df.filter(~is_blank(col))


def require_min_rows(df: DataFrame, n: int) -> DataFrame:
    """Fail on fewer than ``n`` rows; counts no further than ``n``."""
    actual = df.limit(n).count()
    if actual < n:
        raise ValueError(f"too few rows: at least {n} needed, {actual} given")
    return df


def stage_counts(
    df: DataFrame, stages: Sequence[tuple[str, Column]]
) -> DataFrame:
    """``(stage_no, stage, rows)`` after each filter in turn, from one scan."""
    passed = F.lit(True)
    counts = [F.count(F.lit(1)).alias("stage_0")]
    names = ["load"]
    for name, keep in stages:
        passed = passed & F.coalesce(keep, F.lit(False))
        counts.append(F.count_if(passed).alias(f"stage_{len(names)}"))
        names.append(name)
    return df.agg(*counts).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("stage_no"),
                        F.lit(name).alias("stage"),
                        F.col(f"stage_{i}").alias("rows"),
                    )
                    for i, name in enumerate(names)
                ]
            )
        )
    )
