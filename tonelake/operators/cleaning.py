"""Cleaning of whole tables, by column expression or with a lexicon table."""

from __future__ import annotations

from typing import Any

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as tx
from .rows import drop_empty_text, require_columns
from ..session import materialize
from .skew import lookup_join


def clean_frame(
    df: DataFrame,
    mode: str = "classical",
    text_col: str = "Text",
    output_col: str = "cleaned_text",
    drop_empty: bool = True,
    observation: Observation | None = None,
    **options: Any,
) -> DataFrame:
    """Clean one column, then drop the rows that came out empty.

    ``options`` are those of ``clean_classical``: ``use_negation``,
    ``drop_stopwords``, ``stop_words``.
    """
    clean = tx.cleaner(mode, **options)
    require_columns(df, [text_col])
    if not drop_empty:
        return df.withColumn(output_col, clean(text_col))
    # a plain projection would be pasted into the filter and run twice
    kept = [c for c in df.columns if c != output_col]
    out = df.select(*kept, F.explode(F.array(clean(text_col))).alias(output_col))
    return drop_empty_text(out, output_col, observation)


def lemmatize_with_lexicon(
    df: DataFrame,
    tokens_col: str,
    lexicon: DataFrame,
    max_broadcast_rows: int | None = None,
) -> DataFrame:
    """Replace tokens by the lemma a ``(word, lemma)`` table gives.

    Tokens without an entry and ``_NEG`` tokens stay. Rows are stored with an id of
    their own, by which their tokens are put together again; so rows may share a key
    or have none, and a task holds one row at a time. Only tokens that change are sent back to their row.
    """
    return with_lemmas(numbered_rows(df), tokens_col, lexicon, max_broadcast_rows)


def numbered_rows(df: DataFrame) -> DataFrame:
    """``df`` with an id of each row, stored."""
    return materialize(df.withColumn("__row", F.monotonically_increasing_id()), "lexicon-rows")


def with_lemmas(
    rows: DataFrame, tokens_col: str, lexicon: DataFrame, max_broadcast_rows: int | None = None
) -> DataFrame:
    """The lemmas of :func:`lemmatize_with_lexicon` for ``numbered_rows``; the ids are dropped."""
    words = rows.select("__row", F.posexplode(tokens_col).alias("pos", "word"))
    entries = materialize(
        lexicon.groupBy("word").agg(F.min("lemma").alias("lemma"))
        .filter((F.col("lemma") != F.col("word")) & ~F.col("word").endswith("_NEG")),
        "lexicon",
    )
    found = lookup_join(
        words, entries, "word", ["__row", "pos"], "inner", max_broadcast_rows
    )
    grouped = found.groupBy("__row").agg(
        F.sort_array(F.collect_list(F.struct("pos", "lemma"))).alias("__changed")
    )
    kept = [c for c in rows.columns if c != "__row"]
    new = F.when(F.col("__changed").isNull(), F.col(tokens_col)).otherwise(_patched(F.col(tokens_col), F.col("__changed")))
    return rows.join(grouped, "__row", "left").withColumn(tokens_col, new).select(*kept)


def _patched(tokens: Column, changed: Column) -> Column:
    """Tokens with those at the places of ``changed`` (sorted) replaced; one walk over both."""

    def with_stretch(cell: Column, k: Column) -> Column:
        # what lies behind the change before, then the change
        start = F.when(k == 0, 0).otherwise(F.get(changed, k - 1)["pos"] + 1)
        return F.concat(F.slice(tokens, start + 1, cell["pos"] - start), F.array(cell["lemma"]))

    last = F.element_at(changed, -1)["pos"] + 1
    rest = F.slice(tokens, last + 1, F.size(tokens) - last)
    return F.concat(F.flatten(F.transform(changed, with_stretch)), rest)


class TextCleaner(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """The cleaning expression as a stage that is saved with a model."""

    mode = Param(
        Params._dummy(), "mode", "classical or transformer", TypeConverters.toString
    )

    negation = Param(
        Params._dummy(), "negation", "mark negated words", TypeConverters.toBoolean
    )
    stopwords = Param(
        Params._dummy(), "stopwords", "drop stop words", TypeConverters.toBoolean
    )

    @keyword_only
    def __init__(
        self, *, inputCol="Text", outputCol="cleaned_text", mode="classical",
        negation=True, stopwords=True,
    ):
        super().__init__()
        self._setDefault(
            inputCol="Text", outputCol="cleaned_text", mode="classical",
            negation=True, stopwords=True,
        )
        tx.cleaner(mode)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return clean_frame(
            dataset,
            self.getOrDefault(self.mode),
            self.getInputCol(),
            self.getOutputCol(),
            drop_empty=False,
            **self._options(),
        )

    def _options(self) -> dict[str, bool]:
        if self.getOrDefault(self.mode) != "classical":
            return {}
        return {
            "use_negation": self.getOrDefault(self.negation),
            "drop_stopwords": self.getOrDefault(self.stopwords),
        }
