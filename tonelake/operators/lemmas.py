"""Lemmas by detachment rules and a lexicon, worked out once for each distinct word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..session import materialize
from .cleaning import numbered_rows, with_lemmas
from .skew import lookup_join


def _detached(form: Column, word_class: Column, order: Column) -> Column:
    """Forms with one ending taken off, for the rules of each class, in the order of the rules."""
    rules = [(c, *rule) for c, rules in lx.DETACHMENTS.items() for rule in rules]
    tried = [
        F.when(
            (word_class == c) & form.endswith(old),
            F.struct(
                F.concat(F.substring(form, F.lit(1), F.length(form) - len(old)), F.lit(new)).alias("form"),
                F.concat(order, F.lit(f"{i:02d}")).alias("order"),
            ),
        )
        for i, (c, old, new) in enumerate(rules)
    ]
    return F.array_compact(F.array(*tried))


def lemma_table(
    words: DataFrame,
    lexicon: DataFrame,
    classes: DataFrame | None = None,
    exceptions: DataFrame | None = None,
) -> DataFrame:
    """``word, lemma`` for the distinct words of ``words`` that have a lemma.

    ``lexicon`` holds ``lemma, word_class`` (``n, v, a, r``), ``classes`` gives the ``word_class`` of a
    ``word`` on its own, as a tagger finds it (noun where it gives none), ``exceptions``
    ``word, word_class, lemma``. A word with exceptions has itself and these as candidates. Others have
    themselves and the forms that one detachment gives; where none of them is a lemma of the class,
    forms of further detachments are tried, round after round. The shortest lemma found counts, of
    equally long ones the first by rule.
    Each round is a join of what is still unknown; words that are no lemma run out of endings.
    """
    words = words.filter(F.col("word").isNotNull()).select("word").distinct()
    if classes is not None:
        one = materialize(
            classes.filter(F.col("word").isNotNull()).groupBy("word").agg(F.min("word_class").alias("word_class")),
            "word-classes",
        )
        words = lookup_join(words, one, "word", ["word"])
    else:
        words = words.withColumn("word_class", F.lit(None).cast("string"))
    words = words.withColumn("word_class", F.coalesce("word_class", F.lit("n")))
    if exceptions is not None:
        listed = exceptions.groupBy("word", "word_class").agg(
            F.sort_array(F.collect_set("lemma")).alias("listed")
        )
        words = lookup_join(words, materialize(listed, "exceptions"), ["word", "word_class"], ["word"])
    else:
        words = words.withColumn("listed", F.lit(None).cast("array<string>"))
    known = materialize(
        lexicon.select(F.col("lemma").alias("form"), "word_class").filter("form IS NOT NULL").distinct(), "lemmas"
    )
    itself = F.struct(F.col("word").alias("form"), F.lit("").alias("order"))
    others = F.transform("listed", lambda x, i: F.struct(x.alias("form"), F.lpad(i.cast("string"), 4, "0").alias("order")))
    ruled = _detached(F.col("word"), F.col("word_class"), F.lit(""))
    first = F.concat(F.array(itself), F.when(F.col("listed").isNotNull(), others).otherwise(ruled))
    forms = words.select("word", "word_class", F.col("listed").isNull().alias("open"), F.inline(first))
    found = None
    while True:
        forms = materialize(forms, "lemma-forms")
        hits = lookup_join(forms, known, ["form", "word_class"], ["word"], "inner")
        best = F.min(F.struct(F.length("form").alias("size"), "order", "form")).alias("best")
        hits = materialize(hits.groupBy("word").agg(best).select("word", F.col("best.form").alias("lemma")), "lemmas-found")
        found = hits if found is None else found.unionByName(hits)
        # a word that is an exception, or itself, has no further forms
        left = forms.filter("open").filter(F.col("order") != "").join(hits, "word", "left_anti")
        next_forms = _detached(F.col("form"), F.col("word_class"), F.col("order"))
        forms = left.select(
            "word", "word_class", "open", F.inline(next_forms).alias("next_form", "next_order")
        ).withColumnsRenamed({"next_form": "form", "next_order": "order"})
        if forms.isEmpty():
            return found


def lemmatize_by_class(
    df: DataFrame,
    tokens_col: str,
    lexicon: DataFrame,
    classes: DataFrame | None = None,
    exceptions: DataFrame | None = None,
) -> DataFrame:
    """Replace tokens by their lemmas; ``_NEG`` tokens and words without one stay."""
    rows = numbered_rows(df)
    # a word of a row is counted once; the tokens, stored, are made once
    words = rows.select(F.explode(F.array_distinct(tokens_col)).alias("word"))
    lemmas = lemma_table(words.filter(~F.col("word").endswith("_NEG")), lexicon, classes, exceptions)
    return with_lemmas(rows, tokens_col, lemmas)
