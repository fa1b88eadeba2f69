"""One query per operator, each over whole tables.

Keys are the operator's id and name. Doubles are rounded to 6 places and
arrays joined to strings, so that results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as lb
from ..functions import phrases as ph
from ..functions import text as tx
from ..functions.sql import register_functions
from ..functions.text import cleaner
from ..operators import cleaning as cl
from ..operators import evaluation as ev
from ..operators import features as ft
from ..operators import lemmas as lm
from ..operators import profiling as pr
from ..operators import rows as rw
from ..operators import scoring as sc
from ..operators import splits as sp
from ..operators import training as tr
from ..operators import validation as vl
from ..operators.sampling import drawn, sample_fraction
from ..plans import train as plans
from ..plans.prepare import prepare_reviews
from ..session import materialize, scratch_path
from ..sources import metrics as mt
from ..sources import models as md
from ..sources import registry as rg
from ..sources.reviews import read_reviews
from ..streaming.batches import open_rows, score_batch_stream
from ..streaming.score import score_stream
from .data import noisy, reviews, table, texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEED = 42
TERMS = ft.DEFAULT_MAX_FEATURES


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def six(col: Column | str) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def read(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, for work on their texts."""
    return texts(spark, sf, "documents")


def talks(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "conversations")


def text_query(name: str, source: str, key: str, text: Callable[[], Column]) -> None:
    """Register a query that shows one text expression for every row."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return texts(spark, sf, source).select(key, text().alias("out"))

    QUERIES[name] = run


def labelled(spark: SparkSession, sf: str, problem: str = "binary") -> DataFrame:
    """Scored reviews with a class, texts left out."""
    df = rw.drop_null_rows(reviews(spark, sf).select("review_id", "Score"))
    if problem == "binary":
        df = rw.drop_neutral(df)
    return df.withColumn("label", lb.score_to_label("Score", problem))


# --- sources and sinks ------------------------------------------------------


@query("io1_read_reviews")
def io1(spark, sf):
    path = scratch_path(spark, "reviews") + ".csv"
    reviews(spark, sf).select("review_id", "Score", "Text").write.option(
        "header", True
    ).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    df = read_reviews(spark, path, keep=("review_id",))
    return df.select(
        F.col("review_id").cast("bigint").alias("review_id"),
        F.col("Score").cast("int").alias("score"),
        F.md5(F.col("Text").cast("binary")).alias("text_md5"),
    )


@query("io2_require_columns")
def io2(spark, sf):
    df = rw.require_columns(reviews(spark, sf), ["Score", "Text"])
    return df.select("review_id", "Score")


@query("io3_project_review")
def io3(spark, sf):
    return rw.project_review(reviews(spark, sf)).select(
        F.col("Score").alias("score"), F.col("Text").alias("body")
    )


def _model(spark: SparkSession, sf: str, problem: str = "binary") -> tr.SentimentModel:
    """A model per table folder, trained on all scored reviews once."""
    key = (spark.sparkContext.applicationId, sf, problem)
    if key not in _MODELS:
        data = prepare_reviews(
            reviews(spark, sf), spark, 1.0, problem, seed=SEED, key="review_id"
        )
        data = materialize(data.select("cleaned_text", "label"), "training")
        _MODELS[key] = tr.fit_sentiment(
            data, max_features=TERMS,
            label_names=lb.names_for(lb.num_classes(problem)),
        )
    return _MODELS[key]


_MODELS: dict[tuple, tr.SentimentModel] = {}


@query("io4_save_load_model")
def io4(spark, sf):
    """Predictions of the model and of its reloaded copy, which must agree."""
    model = _model(spark, sf)
    path = scratch_path(spark, "model")
    md.save_model(model, spark, path)
    again = md.load_model(spark, path)
    talk = talks(spark, sf)
    keys = ["conv_id", "turn"]
    a = sc.predict_ids(model, talk).select(*keys, "prediction")
    b = sc.predict_ids(again, talk).select(*keys, F.col("prediction").alias("reloaded"))
    return a.join(b, keys).select(
        *keys, (F.col("prediction") == F.col("reloaded")).alias("same")
    )


@query("io5_write_metrics")
def io5(spark, sf):
    path = scratch_path(spark, "metrics")
    mt.write_metrics(
        mt.nested_metrics(_predictions(spark, sf), "quality", "prediction", "model"), path
    )
    stored = spark.read.json(path)
    m = F.col("metrics")
    cells = F.transform(
        m["confusion_matrix"],
        lambda row: F.array_join(row.cast("array<string>"), ","),
    )
    return stored.select(
        "model",
        six(m["accuracy"]).alias("accuracy"),
        six(m["f1_macro"]).alias("f1_macro"),
        six(m["classification_report"]["macro avg"]["precision"]).alias("macro_precision"),
        six(m["classification_report"]["1"]["recall"]).alias("recall_1"),
        F.array_join(cells, ";").alias("confusion"),
    )


def _registry(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Per source a registered model; newer ones per source with labels and lang."""
    d = docs(spark, sf)
    old = d.groupBy("source").agg(F.min("doc_id").alias("position")).select(
        "position",
        F.col("source").alias("name"),
        F.concat(F.lit("models/v1/"), "source").alias("path"),
        F.lit("classical").alias("type"),
        F.lit("2025-01-01T00:00:00").alias("registered_at"),
    )
    toxic = d.join(table(spark, sf, "labels"), "doc_id").filter("toxic = 1")
    names = toxic.select(F.col("source").alias("name")).union(
        d.select(F.concat(F.lit("lang-"), "lang").alias("name"))
    ).distinct()
    new = names.select(
        "name",
        F.concat(F.lit("models/v2/"), "name").alias("path"),
        F.lit("transformer").alias("type"),
        F.lit("2025-06-01T00:00:00").alias("registered_at"),
    )
    return old, new


@query("io6_register_model")
def io6(spark, sf):
    return rg.upsert_models(*_registry(spark, sf))


@query("io6_stored_registry")
def io6b(spark, sf):
    """Models of all languages logged twice, compacted in between, and read back."""
    path = scratch_path(spark, "registry")
    langs = docs(spark, sf).select(F.col("lang").alias("name")).distinct()
    for version in ("v1", "v2"):
        folder = F.concat(F.lit(f"models/{version}/"), "name")
        rg.log_models(langs.select("name", folder.alias("path"), F.lit("classical").alias("type")), path)
        if version == "v1":
            rg.compact_registry(spark, path)
    return rg.read_registry(spark, path, "/srv").select("position", "name", "path", "type")


@query("io7_read_registry")
def io7(spark, sf):
    """A registry text per document, every French one cut off in the middle."""
    entry = F.struct(
        F.col("source").alias("name"),
        F.concat(F.lit("models/"), "lang").alias("path"),
        F.lit("classical").alias("type"),
    )
    other = F.struct(
        F.concat(F.lit("second-"), "lang").alias("name"),
        F.concat(F.lit("/abs/"), "source").alias("path"),
        F.lit("transformer").alias("type"),
    )
    text = F.to_json(F.array(entry, other))
    broken = F.concat(F.lit("invalid "), text)
    texts = docs(spark, sf).select(
        "doc_id", F.when(F.col("lang") == "fr", broken).otherwise(text).alias("value")
    )
    rows = texts.select("doc_id", F.posexplode(rg.parse_registry(F.col("value"))))
    return rows.select(
        "doc_id",
        F.col("pos").alias("position"),
        "col.name",
        rg.resolve_path(F.col("col.path"), "/srv").alias("path"),
        "col.type",
    )


# --- filters, sampling and checks --------------------------------------------


@query("f1_drop_null_rows")
def f1(spark, sf):
    return rw.drop_null_rows(reviews(spark, sf), ["Score", "Text"]).select(
        "review_id", "Score"
    )


@query("f2_sample_fraction")
def f2(spark, sf):
    df = rw.drop_null_rows(reviews(spark, sf).select("review_id", "Score"))
    return sample_fraction(df, 0.1, SEED, "review_id")


@query("f2_sample_approx")
def f2b(spark, sf):
    df = docs(spark, sf).select("doc_id", "lang")
    return sample_fraction(df, 0.25, SEED, "doc_id", exact=False)


@query("f3_drop_neutral")
def f3(spark, sf):
    return rw.drop_neutral(reviews(spark, sf)).select("review_id", "Score")


def _gappy(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with missing, blank and ordinary texts, by their labels."""
    text = (
        F.when((F.col("toxic") == 1) & (F.col("quality") == 0), F.lit(None))
        .when(F.col("toxic") == 1, F.lit(" \t\n "))
        .when(F.col("quality") == 0, F.lit(""))
        .otherwise(F.col("text"))
    )
    return (
        docs(spark, sf)
        .join(table(spark, sf, "labels"), "doc_id", "left")
        .select("doc_id", text.alias("text"))
    )


@query("f4_drop_empty_text")
def f4(spark, sf):
    return rw.drop_empty_text(_gappy(spark, sf), "text").select("doc_id")


@query("f5_require_min_rows")
def f5(spark, sf):
    return rw.require_min_rows(reviews(spark, sf).select("review_id", "lang"), 10)


@query("f6_stage_counts")
def f6(spark, sf):
    df = reviews(spark, sf)
    full = F.col("Score").isNotNull() & F.col("Text").isNotNull()
    return rw.stage_counts(
        df,
        [
            ("dropna", full),
            ("sample", drawn("review_id", 0.5, SEED)),
            ("neutral", F.col("Score") != 3),
            ("clean", ~tx.is_blank(tx.remove_non_alpha("Text"))),
        ],
    )


@query("v1_validate_text")
def v1(spark, sf):
    return vl.validate_text(_gappy(spark, sf), "text").select("doc_id", "reason")


@query("v2_validate_batch")
def v2(spark, sf):
    talk = talks(spark, sf)
    return vl.validate_batch(talk, "conv_id", "text", 6, 1200).select(
        "conv_id", "turn", "reason"
    )


@query("v2_validate_batch_array")
def v2b(spark, sf):
    lines = F.split("text", "\n")
    return read(spark, sf).select(
        "doc_id", vl.batch_reason(lines, 20, 800).alias("reason")
    )


@query("v3_validate_score")
def v3(spark, sf):
    df = reviews(spark, sf).select(
        "review_id", (F.col("Score") * 1.5 - 1).alias("Score")
    )
    return vl.validate_score(df).select("review_id", "reason")


# --- text ---------------------------------------------------------------------

QUERIES["t1_to_text"] = lambda spark, sf: docs(spark, sf).select(
    "doc_id", tx.to_text("n_chars").alias("out")
)
text_query("t2_strip_html", "pages", "page_id", lambda: tx.strip_html("html"))
REFERENCES = "caf&eacute; &hearts; &#0233;&#x1F600; &amp;lt; <i title='a > b'>x</i><?php echo 1; ?>"
text_query(
    "t2_references", "pages", "page_id",
    lambda: tx.strip_html(F.concat("html", F.lit(REFERENCES), "html")),
)


@query("sql_functions_agree")
def sql_functions_agree(spark, sf):
    """Per page, whether SQL and column forms give the same."""
    register_functions(spark)
    h = F.concat("html", F.lit(REFERENCES))
    pairs = {
        "strip_html": tx.strip_html, "clean_minimal": tx.clean_minimal,
        "clean_classical": tx.clean_classical, "clean_regex": tx.clean_regex,
    }
    rows = texts(spark, sf, "pages").select("page_id", h.alias("h"))
    same = [F.expr(f"{n}(h)").eqNullSafe(f("h")).alias(n) for n, f in pairs.items()]
    return rows.select("page_id", *same)


def _lateral(spark: SparkSession, df: DataFrame, select: str, call: str) -> DataFrame:
    """A table function over the rows of ``df``, in SQL."""
    register_functions(spark)
    return spark.sql(f"SELECT {select} FROM {{rows}} d, LATERAL {call} f", rows=df)


@query("x2_ngrams_sql")
def x2b(spark, sf):
    return _lateral(spark, table(spark, sf, "benchmark"), "d.item_id, f.place, f.term", "text_ngrams(d.text, 1, 3)")


@query("x3_term_freq_sql")
def x3b(spark, sf):
    return _lateral(spark, read(spark, sf), "d.doc_id, f.term, f.tf", "term_freq(d.text, 1, 2)")


@query("v1_validate_text_sql")
def v1b(spark, sf):
    return _lateral(spark, _gappy(spark, sf), "d.doc_id, f.reason", "text_refusal(d.text)")


text_query("t3_strip_tags_regex", "pages", "page_id", lambda: tx.strip_tags_regex("html"))
text_query(
    "t4_strip_urls", "pages", "page_id",
    lambda: tx.strip_urls(F.concat_ws(" ", "url", "html", "url")),
)
text_query(
    "t5_normalize_whitespace", "documents", "doc_id",
    lambda: tx.normalize_whitespace(F.concat_ws(" \t ", "lang", "text", "source")),
)
text_query("t6_demojize", "documents", "doc_id", lambda: tx.demojize(noisy("text")))


@query("t6_demojize_sequences")
def t6b(spark, sf):
    """Joined sequences, flags, keycaps and tones, with names from a table."""
    woman, man, girl, joiner = "\U0001F469", "\U0001F468", "\U0001F467", "\u200D"
    flag, other, thumb, dark = "\U0001F1F8\U0001F1EA", "\U0001F1EA\U0001F1F8", "\U0001F44D", "\U0001F3FF"
    named = {
        woman: "woman", man: "man", girl: "girl", f"{man}{joiner}{woman}{joiner}{girl}": "family",
        flag: "Sweden", other: "Spain", "3\u20E3": "keycap_3", thumb: "thumbs_up",
    }
    lexicon = ph.read_phrases(spark.createDataFrame(list(named.items()), "emoji string, name string"), "emoji", "name")
    text = F.col("text")
    for word, emoji in (
        (" the ", f" {man}{joiner}{woman}{joiner}{girl} {flag} "),
        (" la ", f" {woman} 3\uFE0F\u20E3 "),
        (" der ", f" {thumb}{dark} "),
    ):
        text = F.replace(text, F.lit(word), F.lit(emoji))
    return read(spark, sf).select("doc_id", tx.demojize(text, lexicon).alias("out"))


text_query(
    "t7_expand_contractions", "documents", "doc_id",
    lambda: tx.expand_contractions(noisy("text")),
)
text_query(
    "t8_lower_text", "documents", "doc_id", lambda: tx.lower_text("text")
)
text_query(
    "t9_replace_numbers", "documents", "doc_id", lambda: tx.replace_numbers(noisy("text"))
)
text_query(
    "t10_remove_non_alpha", "documents", "doc_id", lambda: tx.remove_non_alpha("text")
)


def letters() -> Column:
    """Noisy text as the tokenizer gets it."""
    return tx.remove_non_alpha(tx.replace_numbers(tx.lower_text(noisy("text"))))


text_query(
    "t11_tokenize", "documents", "doc_id",
    lambda: tx.join_tokens(tx.tokenize(letters())),
)
text_query(
    "t12_mark_negation", "documents", "doc_id",
    lambda: tx.join_tokens(tx.mark_negation(tx.tokenize(letters()))),
)
text_query(
    "t13_remove_stopwords", "documents", "doc_id",
    lambda: tx.join_tokens(
        tx.remove_stopwords(tx.mark_negation(tx.tokenize(letters())))
    ),
)
text_query(
    "t14_lemmatize", "documents", "doc_id",
    lambda: tx.join_tokens(tx.lemmatize(tx.tokenize(letters()))),
)


@query("t14_lemmatize_lexicon")
def t14b(spark, sf):
    """Lexicon: each distinct word of ``benchmark`` with its lower-cased stem."""
    words = table(spark, sf, "benchmark").select(
        F.explode(tx.tokenize(tx.remove_non_alpha(F.lower("text")))).alias("word")
    ).distinct()
    lexicon = words.select("word", F.regexp_replace("word", "(ing|ed|s)$", "").alias("lemma"))
    tokens = tx.tokenize(tx.remove_non_alpha(F.lower("text")))
    df = read(spark, sf).select("doc_id", tokens.alias("tokens"))
    return cl.lemmatize_with_lexicon(df, "tokens", lexicon).select(
        "doc_id", tx.join_tokens("tokens").alias("out")
    )


@query("t14_lemmatize_detachment")
def t14c(spark, sf):
    """Lexicon: words of ``benchmark``, cut at an ending, in a class by their length; and so are the tags."""
    tokens = tx.tokenize(tx.remove_non_alpha(F.lower("text")))
    by_length = lambda c: F.element_at(F.array(*map(F.lit, "nvar")), (F.length(c) % 4 + 1).cast("int"))
    words = table(spark, sf, "benchmark").select(F.explode(tokens).alias("word")).distinct()
    stems = F.regexp_replace("word", "(ing|ed|es|s|er|est)$", "")
    lexicon = words.select(F.explode(F.array("word", stems)).alias("lemma"))
    lexicon = lexicon.withColumn("word_class", by_length("lemma"))
    classes = words.withColumn("word_class", by_length("word"))
    exceptions = words.filter(F.col("word").startswith("th")).select(
        "word", by_length("word").alias("word_class"), F.left("word", F.lit(3)).alias("lemma")
    )
    lexicon = lexicon.unionByName(exceptions.select("lemma", "word_class"))
    df = read(spark, sf).select("doc_id", tokens.alias("tokens"))
    out = lm.lemmatize_by_class(df, "tokens", lexicon, classes, exceptions)
    return out.select("doc_id", tx.join_tokens("tokens").alias("out"))


text_query(
    "t15_filter_short", "documents", "doc_id",
    lambda: tx.join_tokens(tx.filter_short(tx.mark_negation(tx.tokenize(letters())))),
)
text_query(
    "t16_join_tokens", "documents", "doc_id",
    lambda: tx.join_tokens(F.split("text", "[ \n]")),
)
text_query("t17_clean_minimal", "pages", "page_id", lambda: tx.clean_minimal("html"))
text_query(
    "t18_clean_classical", "documents", "doc_id", lambda: tx.clean_classical(noisy("text"))
)
text_query(
    "t18_clean_classical_plain", "documents", "doc_id",
    lambda: tx.clean_classical("text", use_negation=False, drop_stopwords=False),
)
text_query("t19_clean_regex", "pages", "page_id", lambda: tx.clean_regex("html"))


@query("t20_clean_frame")
def t20(spark, sf):
    talk = talks(spark, sf)
    return cl.clean_frame(talk, "classical", "text").select(
        "conv_id", "turn", "cleaned_text"
    )


@query("t20_text_cleaner_stage")
def t20b(spark, sf):
    stage = cl.TextCleaner(inputCol="text", outputCol="cleaned_text", mode="transformer")
    return stage.transform(table(spark, sf, "benchmark")).select("item_id", "cleaned_text")


# --- labels -------------------------------------------------------------------


@query("l1_binary_label")
def l1(spark, sf):
    return rw.drop_null_rows(reviews(spark, sf), ["Score"]).select(
        "review_id", lb.score_to_label("Score", "binary").alias("label")
    )


@query("l2_three_class_label")
def l2(spark, sf):
    return labelled(spark, sf, "3-class").select("review_id", "label")


@query("l3_label_names")
def l3(spark, sf):
    """Name tables for 2, 3 and 5 classes, with the reviews each name has."""
    counts = labelled(spark, sf, "3-class").groupBy("label").count()
    parts = [
        lb.label_names(spark, n).withColumn("num_labels", F.lit(n)) for n in (2, 3, 5)
    ]
    return reduce(DataFrame.union, parts).join(
        counts.withColumnRenamed("count", "reviews"), "label", "left"
    )


@query("l4_with_label_name")
def l4(spark, sf):
    df = lb.with_label_name(labelled(spark, sf, "3-class"), "label", 3)
    return df.select("review_id", "label_name")


@query("l5_label_id")
def l5(spark, sf):
    text = F.when(F.col("lang") == "fr", F.col("source")).otherwise(
        F.concat(F.lit("LABEL_"), F.col("n_chars").cast("string"))
    )
    return docs(spark, sf).select("doc_id", lb.label_id(text).alias("label"))


@query("l6_label_distribution")
def l6(spark, sf):
    out = pr.label_distribution(labelled(spark, sf, "3-class"))
    return out.select("label", "n", six("share").alias("share"))


@query("l7_prepare_reviews")
def l7(spark, sf):
    df = prepare_reviews(
        reviews(spark, sf), spark, 0.5, "binary", "classical", SEED, key="review_id"
    )
    return df.select("review_id", "Score", "label", "cleaned_text")


@query("l7_options")
def l7b(spark, sf):
    """No sample, negation and stop words left alone."""
    df = prepare_reviews(
        reviews(spark, sf), spark, key="review_id",
        cleaning={"use_negation": False, "drop_stopwords": False},
    )
    return df.select("review_id", "Score", "label", "cleaned_text")


# --- splits -------------------------------------------------------------------


@query("s1_split_train_test")
def s1(spark, sf):
    return sp.with_split(labelled(spark, sf), 0.2, seed=SEED).select(
        "review_id", "label", "split"
    )


@query("s2_split_unstratified")
def s2(spark, sf):
    df = docs(spark, sf).select("doc_id", "lang")
    return sp.with_split(df, 0.1, stratify=None, seed=SEED, key="doc_id")


@query("s3_split_train_val_test")
def s3(spark, sf):
    return sp.with_split(labelled(spark, sf), 0.2, 0.1, seed=SEED).select(
        "review_id", "label", "split"
    )


@query("s4_check_split")
def s4(spark, sf):
    out = sp.check_split(sp.with_split(labelled(spark, sf), 0.2, 0.1, seed=SEED))
    return out.withColumn("class_share", six("class_share"))


# --- features -----------------------------------------------------------------


@query("x1_analyze")
def x1(spark, sf):
    return read(spark, sf).select(
        "doc_id", tx.join_tokens(tx.analyze("text")).alias("terms")
    )


@query("x2_ngrams")
def x2(spark, sf):
    terms = tx.ngrams(tx.analyze("text"), (1, 3))
    return table(spark, sf, "benchmark").select(
        "item_id", F.array_join(terms, "|").alias("terms")
    )


@query("x3_term_freq")
def x3(spark, sf):
    return ft.term_table(read(spark, sf), "doc_id", "text")


@query("x4_doc_freq")
def x4(spark, sf):
    return ft.doc_freq(ft.term_table(read(spark, sf), "doc_id", "text"))


@query("x5_vocabulary")
def x5(spark, sf):
    return ft.vocabulary(
        ft.term_table(read(spark, sf), "doc_id", "text", (1, 2)), TERMS
    )


@query("x5_vocabulary_sketch")
def x5b(spark, sf):
    """Of one to three words, rare ones left to the sketch."""
    return ft.vocabulary(
        ft.term_table(read(spark, sf), "doc_id", "text", (1, 3)), TERMS, sketch=True
    )


@query("x5_vocabulary_large")
def x5c(spark, sf):
    """More terms than one task sorts, cut and indexed by range."""
    return ft.vocabulary(ft.term_table(read(spark, sf), "doc_id", "text", (1, 2)), 150_000)


@query("x6_idf")
def x6(spark, sf):
    d = read(spark, sf)
    vocab = ft.vocabulary(ft.term_table(d, "doc_id", "text"), TERMS)
    return ft.with_idf(vocab, d).select("term", "term_index", six("idf").alias("idf"))


def _weights(df: DataFrame) -> DataFrame:
    return df.withColumn("idf", six("idf")).withColumn("tfidf", six("tfidf"))


@query("x7_tfidf")
def x7(spark, sf):
    return _weights(ft.tfidf(read(spark, sf), "doc_id", "text", TERMS))


@query("x8_transform_tfidf")
def x8(spark, sf):
    """Vocabulary of the documents, weights for the benchmark items."""
    vocab = ft.fit_vocabulary(read(spark, sf), "text", TERMS)
    terms = ft.term_table(table(spark, sf, "benchmark"), "item_id", "text")
    return _weights(ft.weigh(terms, vocab, "item_id"))


@query("x8_transform_vectors")
def x8b(spark, sf):
    """The same through the fitted vector stages, read back as rows."""
    from pyspark.ml.functions import vector_to_array

    model = ft.fit_tfidf(read(spark, sf), "text", "features", TERMS)
    out = ft.transform_tfidf(model, table(spark, sf, "benchmark"))
    rows = out.select(
        "item_id",
        F.posexplode(vector_to_array("features")).alias("term_index", "tfidf"),
    ).filter(F.col("tfidf") != 0)
    names = ft.feature_names(spark, model)
    return rows.join(F.broadcast(names), "term_index").select(
        "item_id", "term", "term_index", six("tfidf").alias("tfidf")
    )


@query("x8_vectorize")
def x8c(spark, sf):
    """Sparse vectors over a joined vocabulary, read back as rows."""
    vocab = ft.fit_vocabulary(read(spark, sf), "text", TERMS, (1, 2))
    out = ft.vectorize(table(spark, sf, "benchmark"), "text", vocab, ngram_range=(1, 2))
    cell = F.arrays_zip(F.unwrap_udt("features")["indices"], F.unwrap_udt("features")["values"])
    return out.select("item_id", F.inline(cell)).select(
        "item_id", F.col("indices").alias("term_index"), six("values").alias("tfidf")
    )


@query("x9_feature_names")
def x9(spark, sf):
    model = ft.fit_tfidf(read(spark, sf), "text", "features", TERMS)
    return ft.feature_names(spark, model)


# --- training -----------------------------------------------------------------


@query("m1_balanced_weights")
def m1(spark, sf):
    df = tr.balanced_weights(labelled(spark, sf))
    return df.select("review_id", "label", six("weight").alias("weight"))


@query("m2_fit_logistic")
def m2(spark, sf):
    """The fitted coefficients by term."""
    model = _model(spark, sf)
    names = ft.feature_names(spark, model.stages)
    fitted = model.stages.stages[-1]
    values = [(i, float(v)) for i, v in enumerate(fitted.coefficients)]
    coefs = spark.createDataFrame(values, "term_index int, coefficient double")
    return names.join(coefs, "term_index")


def _optimality(spark: SparkSession, sf: str, terms: int, **options: object) -> DataFrame:
    """Per term, whether the gradient of the objective vanishes at the fit."""
    from pyspark.ml.functions import vector_to_array

    data = prepare_reviews(
        reviews(spark, sf), spark, 1.0, "binary", seed=SEED, key="review_id"
    )
    data = materialize(data.select("cleaned_text", "label"), "training")
    model = tr.fit_sentiment(data, max_features=terms, tol=1e-12, **options)
    out = tr.balanced_weights(model.transform(data)).select(
        (F.col("weight") * (vector_to_array("probability")[1] - F.col("label"))).alias("pull"),
        F.posexplode(vector_to_array("features")).alias("term_index", "x"),
    )
    pulls = out.filter("x != 0").groupBy("term_index").agg(
        F.sum(F.col("pull") * F.col("x")).alias("pull")
    )
    fitted = [(i, float(v)) for i, v in enumerate(model.stages.stages[-1].coefficients)]
    coefs = spark.createDataFrame(fitted, "term_index int, coefficient double")
    names = ft.feature_names(spark, model.stages)
    return names.join(coefs, "term_index").join(pulls, "term_index").select(
        "term", "term_index",
        (F.abs(F.col("coefficient") + F.col("pull")) < 1e-3).alias("at_optimum"),
    )


@query("m2_optimality")
def m2b(spark, sf):
    return _optimality(spark, sf, TERMS)


@query("m2_newton_optimality")
def m2c(spark, sf):
    return _optimality(spark, sf, 300, solver="newton")


@query("m3_fit_vectors")
def m3(spark, sf):
    """Fit and predict on the given embeddings instead of text."""
    from pyspark.ml.functions import array_to_vector

    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    data = table(spark, sf, "embeddings").select(
        "vec_id", vector.alias("vector"), "label"
    )
    model = tr.fit_sentiment(data, "vector", "label")
    return tr.predict(model, data).select("vec_id", "label", "prediction")


@query("m3_optimality")
def m3b(spark, sf):
    """Per class and dimension, whether the gradient vanishes at the fit on vectors."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    data = table(spark, sf, "embeddings").select(vector.alias("vector"), "label")
    model = tr.fit_sentiment(data, "vector", "label", tol=1e-12)
    fitted = model.stages.stages[-1].coefficientMatrix.toArray()
    out = tr.balanced_weights(model.transform(data)).select(
        "weight", "label", vector_to_array("vector").alias("x"),
        F.posexplode(vector_to_array("probability")).alias("class", "p"),
    )
    pull = F.col("weight") * (F.col("p") - (F.col("class") == F.col("label")).cast("double"))
    sums = out.select("class", pull.alias("pull"), F.posexplode("x").alias("dim", "x")).groupBy(
        "class", "dim"
    ).agg(F.sum(F.col("pull") * F.col("x")).alias("pull"))
    rows = [(c, d, float(w)) for c, row in enumerate(fitted) for d, w in enumerate(row)]
    coefs = spark.createDataFrame(rows, "class int, dim int, coefficient double")
    return coefs.join(sums, ["class", "dim"]).select(
        "class", "dim", (F.abs(F.col("coefficient") + F.col("pull")) < 1e-2).alias("at_optimum")
    )


@query("m4_predict")
def m4(spark, sf):
    model = _model(spark, sf)
    clean = cl.clean_frame(read(spark, sf), "classical", "text")
    return tr.predict(model, clean.select("doc_id", "cleaned_text")).select(
        "doc_id", "prediction"
    )


def _margins(spark, model, clean: DataFrame, key: str) -> DataFrame:
    """Per key, the sum of long-form weights times coefficients, and the intercept."""
    fitted = model.stages.stages[-1]
    idf = model.stages.stages[2].getScalingVec()
    values = [
        (i, float(c), float(w))
        for i, (c, w) in enumerate(zip(fitted.coefficients, idf))
    ]
    vocab = ft.feature_names(spark, model.stages).join(
        spark.createDataFrame(values, "term_index int, coefficient double, idf double"),
        "term_index",
    )
    weights = ft.weigh(ft.term_table(clean, key, "cleaned_text"), vocab, key)
    sums = weights.join(F.broadcast(vocab.select("term", "coefficient")), "term").groupBy(
        key
    ).agg(F.sum(F.col("tfidf") * F.col("coefficient")).alias("margin"))
    margin = F.coalesce("margin", F.lit(0.0)) + float(fitted.intercept)
    return clean.select(key).join(sums, key, "left").select(key, margin.alias("margin"))


@query("m4_long_form_check")
def m4b(spark, sf):
    """Per document, whether the class from its vector is the sign of the sum
    of long-form weights times coefficients."""
    model = _model(spark, sf)
    clean = materialize(
        cl.clean_frame(read(spark, sf), "classical", "text").select("doc_id", "cleaned_text"),
        "cleaned",
    )
    by_vector = tr.predict(model, clean).select("doc_id", "prediction")
    return by_vector.join(_margins(spark, model, clean, "doc_id"), "doc_id").select(
        "doc_id", ((F.col("margin") > 0).cast("int") == F.col("prediction")).alias("same_class")
    )


@query("m5_predict_proba")
def m5(spark, sf):
    model = _model(spark, sf, "3-class")
    clean = cl.clean_frame(read(spark, sf), "classical", "text")
    out = tr.predict_proba(model, clean.select("doc_id", "cleaned_text"))
    return out.select(
        "doc_id", F.posexplode("probabilities").alias("label", "probability")
    )


@query("m5_probability_check")
def m5b(spark, sf):
    """Per document: number of probabilities, their sum, and whether the
    predicted class is the most probable."""
    model = _model(spark, sf, "3-class")
    clean = cl.clean_frame(read(spark, sf), "classical", "text")
    out = tr.predict(model, tr.predict_proba(model, clean.select("doc_id", "cleaned_text")))
    p = F.col("probabilities")
    total = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
    return out.select(
        "doc_id",
        F.size(p).alias("classes"),
        six(total).alias("total"),
        (F.get(p, F.col("prediction")) == F.array_max(p)).alias("predicts_highest"),
    )


_TRAINED: dict[tuple, plans.Trained] = {}


def _trained(spark: SparkSession, sf: str) -> plans.Trained:
    """One training run per table folder, with its split."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        _TRAINED[key] = plans.train_model(
            reviews(spark, sf), spark, max_features=TERMS, key="review_id"
        )
    return _TRAINED[key]


@query("m6_train_split")
def m6b(spark, sf):
    """Which rows a training run fits on and which it holds out."""
    return _trained(spark, sf).data.select("review_id", "label", "split")


@query("m6_train")
def m6(spark, sf):
    trained = plans.train_model(
        reviews(spark, sf), spark, scratch_path(spark, "model"),
        scratch_path(spark, "registry"), max_features=TERMS,
        key="review_id",
    )
    scores = F.col("metrics")
    return trained.metrics.select("model", *[scores[m].alias(m) for m in ev.METRICS])


# --- scoring ------------------------------------------------------------------


@query("p1_predict_ids")
def p1(spark, sf):
    talk = talks(spark, sf)
    return sc.predict_ids(_model(spark, sf), talk).select("conv_id", "turn", "prediction")


@query("p1_class_check")
def p1b(spark, sf):
    """Per turn, whether the id predicted from raw text is the sign of the long-form margin."""
    model = _model(spark, sf)
    turn = F.concat_ws("-", "conv_id", "turn").alias("turn_key")
    talk = materialize(talks(spark, sf).select(turn, "text"), "turns")
    ids = sc.predict_ids(model, talk, "text").select("turn_key", "prediction")
    clean = talk.select("turn_key", cleaner("classical")("text").alias("cleaned_text"))
    margins = _margins(spark, model, materialize(clean, "cleaned"), "turn_key")
    return ids.join(margins, "turn_key").select(
        "turn_key", ((F.col("margin") > 0).cast("int") == F.col("prediction")).alias("same_class")
    )


@query("p2_predict_with_labels")
def p2(spark, sf):
    talk = talks(spark, sf)
    return sc.predict_with_labels(_model(spark, sf), talk).select(
        "conv_id", "turn", "text", "label", "score"
    )


@query("p2_label_check")
def p2b(spark, sf):
    out = sc.predict_with_labels(_model(spark, sf), talks(spark, sf))
    return out.select(
        "conv_id", "turn", "text",
        F.col("label").isin("NEGATIVE", "POSITIVE").alias("named"),
        F.col("score").between(0.5, 1.0).alias("in_range"),
    )


@query("p3_order_check")
def p3b(spark, sf):
    out = sc.predict_with_probabilities(_model(spark, sf, "3-class"), talks(spark, sf))
    scores = F.col("predictions.score")
    return out.select(
        "conv_id", "turn",
        F.array_join(F.array_sort("predictions.label"), ",").alias("labels"),
        (F.sort_array(scores, asc=False) == scores).alias("descending"),
    )


@query("p3_predict_with_probabilities")
def p3(spark, sf):
    talk = talks(spark, sf)
    out = sc.predict_with_probabilities(_model(spark, sf, "3-class"), talk)
    # of a bare column Spark would first ask for the size, and score the rows for it before they are spread
    placed = F.transform(
        "predictions", lambda p, i: F.struct(i.alias("place"), p["label"].alias("label"), p["score"].alias("score"))
    )
    return out.select("conv_id", "turn", F.inline(placed))


def length_scorer():
    """Stands for a model: three class values from the length of a text."""
    import numpy as np

    def predict(texts):
        size = np.array([len(t) for t in texts])
        return np.stack([size % 5 - 2.0, size % 7 - 3.0, size % 11 - 5.0], axis=1)

    return predict


@query("p4_score_external")
def p4(spark, sf):
    talk = talks(spark, sf)
    out = sc.score_external(talk, length_scorer, "text", 3, mode=None)
    return out.select(
        "conv_id", "turn", "prediction", "label", six("score").alias("score")
    )


@query("p5_score_requests")
def p5(spark, sf):
    talk = talks(spark, sf)
    scored = sc.score_requests(_model(spark, sf), talk, "conv_id", "text")
    return scored.predictions.select("conv_id", "turn", "label", "score")


@query("p5_accepted")
def p5c(spark, sf):
    """Rows scored when batches of more than 1200 characters in a text fail."""
    talk = talks(spark, sf).withColumn(
        "text", F.when(F.length("text") <= 1200, F.col("text"))
    )
    scored = sc.score_requests(_model(spark, sf), talk, "conv_id", "text")
    return scored.predictions.select(
        "conv_id", "turn", F.col("label").isNotNull().alias("named")
    )


@query("p5_request_arrays")
def p5d(spark, sf):
    """A request per document, its lines the texts."""
    requests = read(spark, sf).select("doc_id", F.split("text", "\n").alias("texts"))
    scored = sc.score_request_arrays(_model(spark, sf), requests, "doc_id")
    return scored.predictions.select(
        "doc_id", "item", "text", F.col("label").isNotNull().alias("named")
    )


@query("p5_request_report")
def p5b(spark, sf):
    talk = talks(spark, sf).withColumn(
        "text", F.when(F.length("text") % 50 != 0, F.col("text"))
    )
    return sc.score_requests(_model(spark, sf), talk, "conv_id", "text").report


def document_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a stream, from one file or a folder of part files."""
    source = spark.read.parquet(f"{sf}/documents.parquet")
    # a stream takes a file only by a pattern
    return spark.readStream.schema(source.schema).parquet(f"{sf}/documents.parque[t]").select("doc_id", "text")


def _streamed(spark: SparkSession, sf: str) -> str:
    out = scratch_path(spark, "stream")
    run = score_stream(
        document_stream(spark, sf), _model(spark, sf), out, f"{out}/checkpoint",
        partitions=spark.sparkContext.defaultParallelism,
    )
    run.awaitTermination()
    return out


@query("p6_score_stream")
def p6(spark, sf):
    out = _streamed(spark, sf)
    return spark.read.parquet(f"{out}/scored").select("doc_id", "label", "score")


@query("p6_stream_accepted")
def p6c(spark, sf):
    out = _streamed(spark, sf)
    return spark.read.parquet(f"{out}/scored").select(
        "doc_id", F.col("label").isin("NEGATIVE", "POSITIVE").alias("named")
    )


@query("p6_stream_rejects")
def p6b(spark, sf):
    out = _streamed(spark, sf)
    return spark.read.parquet(f"{out}/rejects").select("doc_id", "reason")


def _dealt_talks(spark: SparkSession, sf: str) -> tuple[str, int]:
    """Turns of conversations in files that a stream reads one after the other.

    Even and odd turns of a conversation lie in different files; some first turns come in the last
    one. Also the delay in minutes that waits for the others but not for these.
    """
    talk = talks(spark, sf).withColumn("ts", F.timestamp_seconds(F.col("conv_id") * 60 + F.col("turn") * 5))
    n = talk.agg(F.max("conv_id")).first()[0] + 1
    late = (F.col("conv_id") % 5 == 2) & (F.col("turn") == 1)
    part = F.when(late, 9).otherwise(F.floor(F.col("conv_id") * 4 / n) + F.col("turn") % 2)
    folder = scratch_path(spark, "requests")
    stored = materialize(talk.withColumn("part", part), "talks")
    for i in (0, 1, 2, 3, 4, 9):
        stored.filter(F.col("part") == i).drop("part").coalesce(1).write.parquet(f"{folder}/{i}")
    return folder, n // 4 + 5


@query("p6_stream_batches")
def p6d(spark, sf):
    folder, delay = _dealt_talks(spark, sf)
    schema = spark.read.parquet(f"{folder}/0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    out = scratch_path(spark, "stream")
    score_batch_stream(
        stream, _model(spark, sf), out, f"{out}/checkpoint", "ts", "conv_id", "text",
        gap="2 minutes", delay=f"{delay} minutes", max_items=6, max_chars=1200,
    ).awaitTermination()
    shown = lambda df, status: df.select("conv_id", "turn", status.alias("status"))
    return (
        shown(spark.read.parquet(f"{out}/scored"), F.lit("scored"))
        .unionByName(shown(spark.read.parquet(f"{out}/rejects"), F.col("reason")))
        .unionByName(shown(open_rows(spark, out), F.lit("open")))
    )


# --- evaluation ---------------------------------------------------------------


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Three toy models over the labelled documents, in long form."""
    labels = table(spark, sf, "labels")
    toy = {
        "not_toxic": 1 - F.col("toxic"),
        "always_good": F.lit(1),
        "by_id": (F.col("doc_id") % 3).cast("int"),
    }
    models = {n: labels.select("doc_id", p.alias("prediction")) for n, p in toy.items()}
    return ev.long_predictions(models, "doc_id").join(
        labels.select("doc_id", "quality"), "doc_id"
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            six(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name
            for f in df.schema.fields
        ]
    )


def eval_query(name: str, fn: Callable) -> None:
    QUERIES[name] = lambda spark, sf: _rounded(
        fn(_predictions(spark, sf), "quality", "prediction", "model")
    )


eval_query("e1_confusion_matrix", ev.confusion_matrix)
eval_query("e2_accuracy", ev.accuracy)
eval_query("e3_precision_recall_f1", ev.precision_recall_f1)
eval_query("e4_macro_average", ev.macro_average)
eval_query("e5_weighted_average", ev.weighted_average)
eval_query(
    "e6_classification_report",
    lambda df, y, p, by: ev.classification_report(df, y, p, by, num_labels=3),
)
eval_query("e7_evaluate_classification", ev.evaluate_classification)


def _unseen(spark: SparkSession, sf: str) -> DataFrame:
    """Raw texts and labels of the rows that the training run held out."""
    return plans.holdout_rows(reviews(spark, sf), split=_trained(spark, sf).data)


@query("e8_evaluate_model")
def e8(spark, sf):
    return plans.evaluate_model(_trained(spark, sf).model, _unseen(spark, sf), "Text")[1]


@query("e8_evaluated_rows")
def e8b(spark, sf):
    """Rows of each class that the metrics stand on."""
    done = plans.evaluate_model(_trained(spark, sf).model, _unseen(spark, sf), "Text")[0]
    return ev.precision_recall_f1(done, "label", "prediction").select("label", "support")


@query("e8_metrics_check")
def e8c(spark, sf):
    """Accuracy and macro F1 of a run beside those counted from its stored predictions."""
    rows, metrics = plans.evaluate_model(_trained(spark, sf).model, _unseen(spark, sf), "Text")
    hit = F.col("label") == F.col("prediction")
    f1 = [
        2 * F.count_if(hit & (F.col("label") == c))
        / (F.count_if(F.col("label") == c) + F.count_if(F.col("prediction") == c))
        for c in (0, 1)
    ]
    plain = rows.agg(F.avg(hit.cast("int")).alias("accuracy"), ((f1[0] + f1[1]) / 2).alias("f1_macro"))
    plain = plain.unpivot([], ["accuracy", "f1_macro"], "metric", "plain")
    return metrics.join(plain, "metric").select(
        "metric", (F.abs(F.col("value") - F.col("plain")) < 1e-9).alias("same")
    )


@query("e9_compare_models")
def e9(spark, sf):
    truth = table(spark, sf, "labels")
    predictions = _predictions(spark, sf).drop("quality")
    return ev.compare_models(predictions, truth, "quality", "doc_id")


@query("e9_match_counts")
def e9b(spark, sf):
    """What a comparison of two models with a truth for some rows leaves out."""
    truth = table(spark, sf, "labels").withColumn(
        "quality", F.when(F.col("toxic") == 0, F.col("quality"))
    )
    rows = docs(spark, sf).select("doc_id", (F.col("n_chars") % 2).cast("int").alias("prediction"))
    both = ev.long_predictions({"a": rows, "b": rows.filter("doc_id % 3 = 0")}, "doc_id")
    return ev.match_counts(both, truth, "quality", "doc_id")


@query("e10_infer_num_labels")
def e10(spark, sf):
    return ev.infer_num_labels(labelled(spark, sf, "3-class"), "label")


@query("e10_stored_num_labels")
def e10b(spark, sf):
    """The class count of a stored model, where the data at hand has fewer classes."""
    path = scratch_path(spark, "model")
    md.save_model(_model(spark, sf, "3-class"), spark, path)
    rows = labelled(spark, sf, "3-class").filter("label < 2")
    return ev.infer_num_labels(rows, "label", md.model_info(spark, path))


@query("e11_holdout")
def e11(spark, sf):
    """A fitted model and a table from elsewhere, on rows that training held out."""
    trained = _trained(spark, sf)
    other = table(spark, sf, "labels").select(
        F.col("doc_id").alias("review_id"), (1 - F.col("toxic")).cast("int").alias("prediction")
    )
    return plans.holdout(
        reviews(spark, sf),
        {"terms": trained.model, "not toxic": other},
        output_path=scratch_path(spark, "comparison"),
        split=trained.data,
    )


@query("e11_rows")
def e11b(spark, sf):
    """Rows of a hold-out run, and whether training had them."""
    data = _trained(spark, sf).data
    seen = data.filter("split = 'train'").select("review_id", F.lit(True).alias("in_training"))
    return _unseen(spark, sf).join(seen, "review_id", "left").select(
        "review_id", "label", F.coalesce("in_training", F.lit(False)).alias("in_training")
    )


@query("e11_external_metrics")
def e11c(spark, sf):
    """The row of the scorer from elsewhere, which SQL can follow."""
    return e11(spark, sf).filter("model = 'not toxic'")


# --- profiles -----------------------------------------------------------------


@query("q1_null_counts")
def q1(spark, sf):
    return pr.null_counts(reviews(spark, sf))


@query("q2_column_info")
def q2(spark, sf):
    return pr.column_info(table(spark, sf, "events"))


@query("q3_describe_all")
def q3(spark, sf):
    return _rounded(pr.describe_all(table(spark, sf, "events")))


@query("q3_describe_reviews")
def q3b(spark, sf):
    out = pr.describe_all(reviews(spark, sf))
    return _rounded(out.withColumn("top", F.md5(F.col("top").cast("binary"))))


@query("q4_shape")
def q4(spark, sf):
    return pr.shape(reviews(spark, sf))


@query("q5_head_records")
def q5(spark, sf):
    return pr.head_records(
        docs(spark, sf).select("doc_id", "lang", "source", "n_chars"), 3, "doc_id"
    )


@query("q6_score_distribution")
def q6(spark, sf):
    return pr.score_distribution(reviews(spark, sf)).select(
        F.col("Score").alias("score"), "n"
    )


@query("q7_split_profile")
def q7(spark, sf):
    return pr.split_profile(sp.with_split(labelled(spark, sf), 0.2, 0.1, seed=SEED))


# --- the whole way ------------------------------------------------------------


@query("a1_cleaned_label_profile")
def flagship(spark, sf):
    """Scored, non-neutral reviews cleaned and counted by label."""
    df = rw.drop_neutral(rw.drop_null_rows(reviews(spark, sf), ["Score", "Text"]))
    df = cl.clean_frame(df, "classical").withColumn(
        "label", lb.score_to_label("Score", "binary")
    )
    return df.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.size(F.split("cleaned_text", " "))).cast("bigint").alias("tokens"),
        F.sum(F.length("cleaned_text")).cast("bigint").alias("chars"),
    )
