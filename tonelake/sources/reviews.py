"""Reading review tables."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..operators.rows import project_review, require_columns
from .csvranges import can_split, read_csv_ranges

FORMATS = ("csv", "parquet", "json", "orc", "table")


def read_reviews(
    spark: SparkSession,
    path: str,
    text_col: str = "Text",
    score_col: str = "Score",
    fmt: str = "csv",
    multi_line: bool = True,
    keep: tuple[str, ...] = (),
    csv_options: Mapping[str, str | bool] | None = None,
) -> DataFrame:
    """Score and text of a review table, and the extra columns in ``keep``.

    CSV follows the usual reader: header line, doubled quotes, and the usual
    strings for a missing value. Quoted texts may span lines; large files are read in ranges
    all the same (``csvranges``), unless ``csv_options`` change where records end, which
    leaves each file to one task. Where records keep to one line ``multi_line=False``
    saves a pass. A record with more
    fields than the header fails the query; ``csv_options`` (any of Spark's, such as
    ``{"mode": "DROPMALFORMED"}`` or another ``sep``) override what is set here.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}, got {fmt!r}")
    try:
        if fmt == "table":
            return project_review(spark.read.table(path), score_col, text_col, keep)
        if fmt != "csv":
            df = spark.read.format(fmt).load(path)
            return project_review(df, score_col, text_col, keep)
        if not path.rstrip("/").endswith(".csv"):
            warnings.warn(f"{path} may not be a CSV file", stacklevel=2)
        df = (
            spark.read.option("header", True)
            .option("multiLine", multi_line)
            .option("quote", '"')
            .option("escape", '"')
            .option("mode", "FAILFAST")
            # else only the fields that are asked for would be looked at
            .option("columnPruning", False)
            .options(**(csv_options or {}))
            .csv(path)
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no review table at {path}") from error
        raise ValueError(f"unreadable review table {path}: {error}") from error
    require_columns(df, [score_col, text_col, *keep])
    if multi_line and can_split(csv_options):
        df = read_csv_ranges(spark, path, df.columns, csv_options or {})

    def present(name: str):
        return F.when(~F.col(name).isin(*lx.MISSING_STRINGS), F.col(name))

    score = present(score_col)
    number = score.try_cast("double")
    unreadable = F.raise_error(F.concat(F.lit("Invalid score, no number: "), score))
    return df.select(
        *keep,
        F.when(score.isNotNull() & number.isNull(), unreadable.cast("double"))
        .otherwise(number).alias(score_col),
        present(text_col).alias(text_col),
    )
