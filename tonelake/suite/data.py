"""Review tables derived from the given parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import fits_broadcast, narrow_join
from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are about to be worked on, on all cores."""
    return spread(table(spark, sf_dir, name), f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews; the two labels give a score of 1..5, or none."""
    labels = table(spark, sf_dir, "labels")
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    score = F.when(good & clean, 4 + F.col("doc_id") % 2).otherwise(
        F.when(good, 3).when(clean, 2).otherwise(1)
    )
    # labels too many for a broadcast: the join itself deals out the texts
    documents = (texts if fits_broadcast(labels) else table)(spark, sf_dir, "documents")
    return (
        narrow_join(documents, labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("review_id"),
            F.col("text").alias("Text"),
            "lang",
            "source",
            F.when(F.col("quality").isNotNull(), score).cast("int").alias("Score"),
        )
    )


# What the generated prose lacks, put in place of frequent words.
NOISE = (
    (" the ", " don't "),
    (" and ", " https://t.example/a?b=1 "),
    (" of ", " <b>it's</b> "),
    (" la ", " \U0001F600 "),
    (" der ", " 42 "),
    (" die ", " <i>they've</i> &amp; "),
    (" le ", " cannot "),
    (" que ", " <br/>wanna "),
    (" und ", " www.x.example "),
    (" is ", " can’t "),
    (" to ", " <!-- note --> boxes "),
    (" in ", " cities "),
)


def noisy(col: Column | str) -> Column:
    """Text with markup, links, emoji, digits and contractions mixed in."""
    text = F.col(col) if isinstance(col, str) else col
    for word, noise in NOISE:
        text = F.replace(text, F.lit(word), F.lit(noise))
    return text
