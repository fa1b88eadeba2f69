"""Request and score checks that mark rows instead of raising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions.labels import valid_score
from ..functions.text import is_blank
from ..session import materialize
from .skew import HOT_ROWS, attach_group_facts, fits_broadcast


def text_reason(col: Column | str, max_chars: int = lx.MAX_TEXT_CHARS) -> Column:
    """Why a text is refused; null for a good one."""
    text = F.col(col) if isinstance(col, str) else col
    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(is_blank(text), "whitespace_only")
        .when(F.length(text) > max_chars, "too_long")
    )


def validate_text(
    df: DataFrame, col: str, max_chars: int = lx.MAX_TEXT_CHARS
) -> DataFrame:
    """Add ``reason``; null marks an accepted row."""
    return df.withColumn("reason", text_reason(col, max_chars))


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reason").isNull()).drop("reason")


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reason").isNotNull())


def batch_reason(
    texts: Column | str,
    max_items: int = lx.MAX_BATCH_ITEMS,
    max_chars: int = lx.MAX_TEXT_CHARS,
) -> Column:
    """Why a batch held in one array column is refused; null for a good one."""
    items = F.col(texts) if isinstance(texts, str) else texts
    return (
        F.when(items.isNull() | (F.size(items) == 0), "empty_batch")
        .when(F.size(items) > max_items, "too_many_items")
        .when(
            F.exists(items, lambda t: text_reason(t, max_chars).isNotNull()),
            "bad_item",
        )
    )


def batch_verdicts(
    df: DataFrame,
    batch_col: str,
    text_col: str,
    max_items: int = lx.MAX_BATCH_ITEMS,
    max_chars: int = lx.MAX_TEXT_CHARS,
) -> DataFrame:
    """One row per batch: ``items``, ``bad_items`` and ``batch_reason``."""
    return (
        df.groupBy(batch_col)
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.count_if(text_reason(text_col, max_chars).isNotNull()).alias("bad_items"),
        )
        .withColumn(
            "batch_reason",
            F.when(F.col("items") > max_items, "too_many_items").when(
                F.col("bad_items") > 0, "bad_item"
            ),
        )
    )


def validate_batch(
    df: DataFrame,
    batch_col: str,
    text_col: str,
    max_items: int = lx.MAX_BATCH_ITEMS,
    max_chars: int = lx.MAX_TEXT_CHARS,
    hot_rows: int = HOT_ROWS,
    max_broadcast_rows: int | None = None,
) -> DataFrame:
    """Add ``reason`` to every row of a batch that is refused as a whole.

    Only refused batches need a verdict. They are stored and, where they are
    few, broadcast, so the texts cross no shuffle. Many of them are joined by
    shuffle, the rows of huge batches apart.
    """
    verdicts = batch_verdicts(df, batch_col, text_col, max_items, max_chars)
    refused = materialize(
        verdicts.filter(F.col("batch_reason").isNotNull()).drop("bad_items"), "refused"
    )
    if fits_broadcast(refused, max_broadcast_rows):
        marked = df.join(F.broadcast(refused), batch_col, "left")
    else:
        marked = attach_group_facts(
            df, refused, batch_col, "items", F.monotonically_increasing_id(), hot_rows
        )
    reason = F.when(F.col(batch_col).isNull(), "missing_batch").otherwise(
        F.col("batch_reason")
    )
    return marked.select(*df.columns, reason.alias("reason"))


def validate_score(df: DataFrame, col: str = "Score") -> DataFrame:
    """Add ``reason`` to rows whose score is no number within 1..5."""
    return df.withColumn("reason", F.when(~valid_score(col), "invalid_score"))
