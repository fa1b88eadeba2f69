"""TF-IDF twice: as long tables for SQL, as vectors for model training.

Both count the terms of a document inside its own row, so the only shuffle of
a fit is by term, after partial aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import text as tx
from ..session import materialize, scratch_path
from .skew import lookup_join

DEFAULT_MAX_FEATURES = 5000
# Terms that one task sorts; larger vocabularies are sorted by range
SORTED_TERMS = 100_000
# The frequency sketch: cells of a line, and lines
SKETCH_CELLS = 1 << 20
SKETCH_LINES = 1
# Words of the documents whose n-grams are counted at once; a longer document comes alone
COUNTED_WORDS = 1 << 18


def check_max_features(max_features: int) -> None:
    if max_features < 1:
        raise ValueError(f"a vocabulary of {max_features} terms is empty")


def term_table(
    df: DataFrame, key: str, text_col: str, ngram_range: tuple[int, int] = (1, 1)
) -> DataFrame:
    """``(key, term, tf)``, one row per distinct term of a document."""
    return _row_terms(df, [key], tx.analyze(text_col), ngram_range)


def _row_terms(
    df: DataFrame, keys: Sequence[str], words: Column, ngram_range: tuple[int, int]
) -> DataFrame:
    """``(*keys, term, tf)``, one row per distinct n-gram of each row's ``words``.

    Single words are counted in the row. N-grams are counted as numbers, some documents at a time, and
    spelled out once for each row made.
    """
    low, high = tx.check_ngram_range(ngram_range)
    if high == 1:
        return df.select(*keys, F.inline(tx.term_counts(words)))
    rows = df.select(*keys, words.alias("__words"))
    kinds = [f for f in rows.schema.fields if f.name != "__words"]
    counts = [StructField("term", StringType()), StructField("tf", LongType())]
    return rows.mapInArrow(_count_words(low, high), StructType([*kinds, *counts]))


def _count_words(low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, lists = batch.columns
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes, dtype=np.int64)
            words = lists.flatten()
            row = start = 0
            while row < len(sizes):
                stop = max(row + 1, int(np.searchsorted(ends, start + COUNTED_WORDS, "right")))
                end = int(ends[stop - 1])
                for doc, terms, tf in _distinct_ngrams(words.slice(start, end - start), sizes[row:stop], low, high):
                    at = pa.array(doc + row)
                    columns = [*(k.take(at) for k in keys), terms, pa.array(tf)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "term", "tf"])
                row, start = stop, end

    return run


def _corpus_counts(df: DataFrame, words: Column, ngram_range: tuple[int, int]) -> DataFrame:
    """``(term, total_tf, doc_freq)`` as ``doc_freq`` gives it, from rows that are added up for some documents first."""
    low, high = tx.check_ngram_range(ngram_range)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _count_words(low, high)(batches):
            added = pa.table(batch).group_by("term").aggregate([("tf", "sum"), ("tf", "count")])
            added = added.select(["term", "tf_sum", "tf_count"]).rename_columns(["term", "total_tf", "doc_freq"])
            yield from added.to_batches()

    parts = df.select(words.alias("__words")).mapInArrow(run, "term string, total_tf long, doc_freq long")
    return parts.groupBy("term").agg(F.sum("total_tf").alias("total_tf"), F.sum("doc_freq").alias("doc_freq"))


def _distinct_ngrams(
    words: pa.Array, sizes: np.ndarray, low: int, high: int
) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """Document, n-gram and count of each distinct n-gram of some documents, a length at a time.

    ``words`` are those of all documents in a row, ``sizes`` how many each has. An n-gram is the
    number of its first n - 1 words and that of its last, so no two are taken for one.
    """
    coded = words.dictionary_encode()
    last, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    doc = np.repeat(np.arange(len(sizes)), sizes)
    # the run of n - 1 words that begins at each place, and how runs are spelled
    runs, spelled = np.zeros(len(last), np.int64), None
    for n in range(1, high + 1):
        places = len(last) - n + 1
        whole = doc[n - 1 :] == doc[: max(places, 0)]
        if not whole.any():
            return
        pairs = runs[:places] * len(names) + last[n - 1 :]
        owner = doc[:places]
        kinds = (1 if spelled is None else len(spelled)) * len(names)
        if n >= low:
            keyed = owner * kinds + pairs
            keyed = np.sort(keyed if n == 1 else keyed[whole])
            first = np.flatnonzero(np.concatenate([[True], keyed[1:] != keyed[:-1]]))
            tf = np.diff(np.append(first, len(keyed)))
            owners, found = np.divmod(keyed[first], kinds)
            yield owners, _spell(found, spelled, names), tf
        if n == high:
            return
        if n == 1:
            runs, spelled = last, names
        else:
            found, number = np.unique(pairs[whole], return_inverse=True)
            spelled = _spell(found, spelled, names)
            runs = np.zeros(len(pairs), np.int64)
            runs[whole] = number


def _spell(pairs: np.ndarray, spelled: pa.Array | None, names: pa.Array) -> pa.Array:
    if spelled is None:
        return names.take(pa.array(pairs))
    runs, last = np.divmod(pairs, len(names))
    return pc.binary_join_element_wise(spelled.take(pa.array(runs)), names.take(pa.array(last)), " ")


def doc_freq(terms: DataFrame) -> DataFrame:
    """``(term, total_tf, doc_freq)`` over the whole corpus."""
    return terms.groupBy("term").agg(
        F.sum("tf").alias("total_tf"), F.count(F.lit(1)).alias("doc_freq")
    )


def _sketch(terms: DataFrame) -> DataFrame:
    """``(line, cell, n)``: occurrences by cell of a term's hash, in ``SKETCH_LINES`` lines.

    A cell's count is an upper bound for each of its terms. A task sends a row for a
    cell it has met, so ``SKETCH_LINES * SKETCH_CELLS`` at most, whatever the number of terms.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("line"), _cell(i).alias("cell")) for i in range(SKETCH_LINES)])
    return terms.select("tf", F.inline(cells)).groupBy("line", "cell").agg(F.sum("tf").alias("n"))


def _cell(line: int) -> Column:
    return F.pmod(F.xxhash64("term", F.lit(line)), F.lit(SKETCH_CELLS)).cast("int")


def frequent_terms(terms: DataFrame, max_features: int) -> DataFrame:
    """``(term, total_tf, doc_freq)`` of terms that can be among the ``max_features`` most used.

    The others are known by the sketch alone, so they are neither shuffled nor
    counted one by one. Half of the count of the ``max_features``-th cell is tried as a bound; as soon as
    so many exact counts reach the bound, no term left out can. Else it is lowered.
    """
    sketch = materialize(_sketch(terms), "term-sketch")
    first = sketch.filter("line = 0").orderBy(F.desc("n")).limit(max_features)
    held, least = first.agg(F.count(F.lit(1)), F.min("n")).first()
    bound = max(1, least // 2) if held == max_features else 1
    while True:
        able = terms
        if bound > 1:
            for i in range(SKETCH_LINES):
                # at most SKETCH_CELLS rows
                high = sketch.filter((F.col("line") == i) & (F.col("n") >= bound)).select("cell")
                able = able.withColumn("cell", _cell(i)).join(F.broadcast(high), "cell", "left_semi").drop("cell")
        counted = materialize(doc_freq(able), "frequent-terms")
        if bound == 1 or counted.filter(F.col("total_tf") >= bound).limit(max_features).count() == max_features:
            return counted
        bound = max(1, bound // 4)


def numbered(df: DataFrame, by: Sequence[str | Column], name: str) -> DataFrame:
    """Rows with their place in the order ``by`` as ``name``, from 0; stored.

    Sorted by range, so no task sees all rows: a row's place is that within its range after the
    sizes of the ranges before.
    """
    place = F.monotonically_increasing_id().alias("__place")
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", place)
    ordered = materialize(ordered, "ordered")
    part = F.shiftright("__place", 33)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("__part")) - F.col("n")
    # a row for each range
    starts = sizes.select("__part", before.alias("__start"))
    within = F.col("__place").bitwiseAND((1 << 33) - 1)
    return ordered.withColumn("__part", part).join(F.broadcast(starts), "__part").select(
        *df.columns, (F.col("__start") + within).alias(name)
    )


def _above_cut(counted: DataFrame, max_features: int) -> DataFrame:
    """Terms used as often as the ``max_features``-th or more, all that tie with it too."""
    uses = counted.groupBy("total_tf").agg(F.count(F.lit(1)).alias("n"))
    # n terms of different counts are n * (n + 1) / 2 uses at least, so few rows for one task
    upto = F.sum("n").over(Window.orderBy(F.desc("total_tf")))
    cut = uses.withColumn("upto", upto).filter(F.col("upto") >= max_features)
    least = cut.agg(F.max("total_tf")).first()[0]
    return counted if least is None else counted.filter(F.col("total_tf") >= least)


def vocabulary(
    terms: DataFrame, max_features: int = DEFAULT_MAX_FEATURES, sketch: bool = False
) -> DataFrame:
    """The most used terms, indexed in alphabetical order.

    Terms used equally often at the cut are taken in alphabetical order. With ``sketch`` only terms
    that can reach the cut are shuffled, for one more pass over ``terms``: worth it where most are rare, as
    n-grams are. More than ``SORTED_TERMS`` are cut and indexed by range sorts, in many tasks.
    """
    check_max_features(max_features)
    return _indexed(frequent_terms(terms, max_features) if sketch else doc_freq(terms), max_features)


def _indexed(counted: DataFrame, max_features: int) -> DataFrame:
    if max_features > SORTED_TERMS:
        top = numbered(_above_cut(materialize(counted, "term-counts"), max_features), [F.desc("total_tf"), "term"], "place").filter(F.col("place") < max_features)
        top = numbered(top.drop("place"), ["term"], "term_index")
        return top.select("term", F.col("term_index").cast("int").alias("term_index"), "total_tf", "doc_freq")
    top = counted.orderBy(F.desc("total_tf"), "term").limit(max_features)
    # at most SORTED_TERMS rows are left for this one-task window
    index = F.row_number().over(Window.orderBy("term")) - 1
    return top.select("term", index.alias("term_index"), "total_tf", "doc_freq")


def with_idf(vocab: DataFrame, docs: DataFrame) -> DataFrame:
    """Add the smooth ``idf`` for a corpus of ``docs``."""
    n = docs.agg(F.count(F.lit(1))).scalar()
    return vocab.withColumn("idf", F.log((n + 1) / (F.col("doc_freq") + 1)) + 1)


def weigh(
    terms: DataFrame, vocab: DataFrame, key: str, row: str | None = None
) -> DataFrame:
    """``(key, term, term_index, tf, idf, tfidf)`` with unit length per document.

    Pass a stored vocabulary: its size is looked at before it is joined. The
    window is by document, which has no more rows than the vocabulary. Documents are told
    apart by ``row``, a column of ``terms``, or by ``key`` where that is unique.
    """
    known = lookup_join(
        terms, vocab.select("term", "term_index", "idf"), "term", [row or key], "inner"
    )
    weight = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(weight * weight).over(Window.partitionBy(row or key)))
    return known.select(
        key, "term", "term_index", "tf", "idf", (weight / norm).alias("tfidf")
    )


def fit_vocabulary(
    df: DataFrame,
    text_col: str,
    max_features: int = DEFAULT_MAX_FEATURES,
    ngram_range: tuple[int, int] = (1, 1),
) -> DataFrame:
    """The stored vocabulary of a corpus with its idf."""
    check_max_features(max_features)
    words = tx.analyze(text_col)
    if ngram_range[1] > 1 and max_features <= SKETCH_CELLS // 8:
        counted = frequent_terms(_row_terms(df, [], words, ngram_range), max_features)
    else:
        counted = _corpus_counts(df, words, ngram_range)
    return materialize(with_idf(_indexed(counted, max_features), df), "vocabulary")


def vectorize(
    df: DataFrame,
    text_col: str,
    vocab: DataFrame,
    output_col: str = "features",
    ngram_range: tuple[int, int] = (1, 1),
) -> DataFrame:
    """``df`` with sparse TF-IDF vectors over a stored vocabulary of any size; stored.

    The vocabulary is joined (by shuffle, salted, where it is large) and never held by the driver or
    a model. Every row is a document of its own; one without known terms has an empty vector.
    """
    size = vocab.agg(F.coalesce(F.max("term_index") + 1, F.lit(0))).first()[0]
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "documents")
    counts = _row_terms(rows, ["__row"], tx.analyze(text_col), ngram_range)
    weights = weigh(counts, vocab, "__row")
    cells = F.sort_array(F.collect_list(F.struct("term_index", "tfidf")))
    held = weights.groupBy("__row").agg(cells.alias("__cells"))
    joined = rows.join(held, "__row", "left").select(
        *df.columns,
        F.struct(
            F.lit(0).cast("tinyint").alias("type"),
            F.lit(int(size)).alias("size"),
            F.coalesce(F.col("__cells.term_index"), F.array().cast("array<int>")).alias("indices"),
            F.coalesce(F.col("__cells.tfidf"), F.array().cast("array<double>")).alias("values"),
        ).alias(output_col),
    )
    # a sparse vector is stored as just this record, and read back as a vector
    path = scratch_path(df.sparkSession, "vectors")
    joined.write.parquet(path)
    schema = StructType([*df.schema.fields, StructField(output_col, VectorUDT())])
    return df.sparkSession.read.schema(schema).parquet(path)


def tfidf(
    df: DataFrame,
    key: str,
    text_col: str,
    max_features: int = DEFAULT_MAX_FEATURES,
    ngram_range: tuple[int, int] = (1, 1),
) -> DataFrame:
    """Fit and weigh the same documents; each row is one, whatever its key."""
    vocab = fit_vocabulary(df, text_col, max_features, ngram_range)
    rows = df.select(F.monotonically_increasing_id().alias("__row"), key, text_col)
    # texts are dealt out by row, so that their terms, which are far more bytes, needn't be
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__row")
    counts = _row_terms(rows, ["__row", key], tx.analyze(text_col), ngram_range)
    return weigh(counts, vocab, key, "__row")


class TermAnalyzer(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Text to its array of terms, n-grams included."""

    low = Param(Params._dummy(), "low", "shortest n-gram", TypeConverters.toInt)
    high = Param(Params._dummy(), "high", "longest n-gram", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="cleaned_text", outputCol="terms", low=1, high=1):
        super().__init__()
        self._setDefault(inputCol="cleaned_text", outputCol="terms", low=1, high=1)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        span = (self.getOrDefault(self.low), self.getOrDefault(self.high))
        terms = tx.ngrams(
            tx.analyze(F.coalesce(F.col(self.getInputCol()), F.lit(""))), span
        )
        return dataset.withColumn(self.getOutputCol(), terms)


def fit_tfidf(
    df: DataFrame,
    text_col: str = "cleaned_text",
    output_col: str = "features",
    max_features: int = DEFAULT_MAX_FEATURES,
    ngram_range: tuple[int, int] = (1, 1),
) -> PipelineModel:
    """Fit the vectorizer: one pass over the text, one shuffle by term.

    N-grams take one more pass and shuffle only those that can reach the vocabulary. Rows are counted apart,
    which is free on a stored table. What reaches the driver is the vocabulary, ``max_features`` rows
    at most; it is part of the model. ``vectorize`` does without that.
    """
    check_max_features(max_features)
    low, high = tx.check_ngram_range(ngram_range)
    terms = _row_terms(df, [], tx.analyze(text_col), ngram_range)
    sketch = high > 1 and max_features <= SKETCH_CELLS // 8
    counted = frequent_terms(terms, max_features) if sketch else doc_freq(terms)
    rows = counted.orderBy(F.desc("total_tf"), "term").limit(max_features).collect()
    n_docs = df.count()
    if not n_docs:
        raise ValueError("no texts to learn terms from")
    if not rows:
        raise ValueError("empty vocabulary; the texts hold no terms")
    rows.sort(key=lambda r: r["term"])
    weights = Vectors.dense(
        [math.log((n_docs + 1) / (r["doc_freq"] + 1)) + 1 for r in rows]
    )
    counts = CountVectorizerModel.from_vocabulary(
        [r["term"] for r in rows], inputCol="terms", outputCol="term_counts"
    )
    return PipelineModel(
        [
            TermAnalyzer(inputCol=text_col, outputCol="terms", low=low, high=high),
            counts,
            ElementwiseProduct(
                scalingVec=weights, inputCol="term_counts", outputCol="raw_weights"
            ),
            Normalizer(p=2.0, inputCol="raw_weights", outputCol=output_col),
        ]
    )


def transform_tfidf(model: PipelineModel | None, df: DataFrame) -> DataFrame:
    """Vectors for new text; terms outside the vocabulary are ignored."""
    if model is None:
        raise RuntimeError("the vectorizer must be fitted before use")
    return model.transform(df).drop("terms", "term_counts", "raw_weights")


def feature_names(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """``(term_index, term)`` of a fitted vectorizer."""
    terms = next(s for s in model.stages if hasattr(s, "vocabulary")).vocabulary
    return spark.createDataFrame(list(enumerate(terms)), "term_index int, term string")
