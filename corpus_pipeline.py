"""A corpus from documents: the stages of training-data preparation, in order.

Every stage takes what the one before kept and returns the columns of documents, but for
the last, which returns packed pieces with their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm.common import table
from tonelake.llm.decontam import drop_contaminated
from tonelake.llm.jaccard import keep_one_of_each
from tonelake.llm.langid import keep_known_languages, train_language_model
from tonelake.llm.linededup import drop_boilerplate
from tonelake.llm.packing import pack_documents
from tonelake.llm.tokens import public_path
from tonelake.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose language no model knows, and those without a letter."""
    return keep_known_languages(docs, train_language_model(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites share stay in one document only, those of one word too.

    ``n_chars`` follows the text. A document that loses all its lines goes.
    """
    cleaned = drop_boilerplate(docs, min_words=1)
    left = (F.col("lines_removed") == 0) | (F.length(F.trim("text")) > 0)
    length = F.when(F.col("lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cleaned.filter(left).withColumn("n_chars", length.cast("long")).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares its word n-grams."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that share a passage with the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens, with their ids."""
    return pack_documents(docs, public_path(), with_ids=True)


STAGES = [
    ("language id", language_id),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

# Language models, recursive splitting and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each on what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
