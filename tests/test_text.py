import html
import random
import re
import unicodedata
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tonelake.functions import lexicons as lx
from tonelake.functions import text as tx
from tonelake.functions.sql import register_functions
from tonelake.operators.cleaning import TextCleaner, clean_frame, lemmatize_with_lexicon
from tonelake.suite.data import noisy, table


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(fn(F.col("x")).alias("y")).first()[0]


LITERALS = [
    (tx.strip_html, "a<br />b", "ab"),
    (tx.strip_html, "x &amp; y", "x &amp; y"),
    (tx.strip_html, "<i>x</i> &amp;lt; y &lt;b&gt;", "x &lt; y <b>"),
    (tx.strip_html, "I <3 it", "I <3 it"),
    (tx.strip_html, "<p>a</p><script>if (a<b) {}</script><!-- c --><b>d</b>", "ad"),
    (tx.strip_html, "<p>&#8217;&#x41;&#0;</p>", html.unescape("&#8217;&#x41;&#0;")),
    (tx.strip_tags_regex, "<b>x</b> &amp; <3 y> z", "x &amp;  z"),
    (tx.strip_urls, "see https://a.b/c?d and www.test.com, xhttp://y z", "see  and  x z"),
    (tx.normalize_whitespace, "  a\t\n b c ", "a b c"),
    (tx.demojize, "good ❤️ \U0001F600!", "good :red_heart: :grinning_face:!"),
    (tx.demojize, "café 中", "café 中"),
    (tx.expand_contractions, "I don’t, can't, won't, it's John's", "I do not, cannot, will not, it is John's"),
    (tx.expand_contractions, "they've we'll I'm you'd dont", "they have we will I am you would do not"),
    (tx.replace_numbers, "12 of 3", " <num>  of  <num> "),
    (tx.replace_numbers, "٣x", " <num> x"),
    (tx.remove_non_alpha, "well-made, good,great café", "wellmade goodgreat caf"),
    (tx.remove_non_alpha, "a <b>\n c_9", "a <b>\n c"),
    (tx.clean_minimal, "<i>Fine</i> tea, <a href='t'>see here</a>", "Fine tea, see here"),
    (tx.clean_minimal, "Three cups cost $7.50 of 12", "Three cups cost $7.50 of 12"),
    (tx.clean_regex, "<b>A</b> &amp; http://x.y b", "A &amp; b"),
    (tx.clean_classical, "The KETTLE boils over!", "kettle boil"),
    (tx.clean_classical, "Sold 9 kettles for $7.50", "sold num kettle num num"),
    (tx.clean_classical, "We don't say it's hot", "say_NEG it_NEG is_NEG hot_NEG"),
    (tx.clean_classical, "", ""),
    (tx.clean_classical, None, None),
    (tx.clean_minimal, None, None),
]


@pytest.mark.parametrize("fn, value, want", LITERALS)
def test_literals(spark, fn, value, want):
    assert one(spark, value, fn) == want


def tokens(spark, words, fn):
    df = spark.createDataFrame([(words.split(),)], "x array<string>")
    return " ".join(df.select(fn("x")).first()[0])


def test_token_operators(spark):
    assert tokens(spark, "this not a good no way", tx.mark_negation) == (
        "this not a_NEG good_NEG no_NEG way_NEG"
    )
    assert tokens(spark, "no stop words", tx.mark_negation) == "no stop_NEG words_NEG"
    assert tokens(spark, "all fine", tx.mark_negation) == "all fine"
    assert tokens(spark, "the not never the_NEG cat", tx.remove_stopwords) == (
        "never the_NEG cat"
    )
    assert tokens(
        spark, "cities glasses boxes watches bus his children as cats_NEG ties",
        tx.lemmatize,
    ) == "city glass box watch bus his child as cats_NEG tie"
    assert tokens(spark, "a an_NEG the it cats", tx.filter_short) == "an_NEG the cats"


def test_tokenizer_splits(spark):
    got = one(spark, "i cannot <num> wanna scannot gimme", tx.tokenize)
    assert got == ["i", "can", "not", "num", "wan", "na", "scannot", "gim", "me"]


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="mode must be one of"):
        tx.cleaner("other")


def test_ngrams_and_analysis(spark):
    assert one(spark, "Good_NEG, a café x1!", tx.analyze) == ["good_neg", "café", "x1"]
    got = one(spark, "great big product", lambda c: tx.ngrams(tx.analyze(c), (1, 2)))
    assert got == ["great", "big", "product", "great big", "big product"]
    assert one(spark, "great", lambda c: tx.ngrams(tx.analyze(c), (2, 3))) == []
    for bad in ([1, 2], (1,), (2, 1), (0, 1)):
        with pytest.raises(ValueError, match="ngram_range"):
            tx.check_ngram_range(bad)


def test_term_counts(spark):
    got = one(spark, "b a b b c a", lambda c: tx.term_counts(F.split(c, " ")))
    assert [tuple(r) for r in got] == [("a", 2), ("b", 3), ("c", 1)]
    assert one(spark, "b", lambda c: tx.term_counts(F.array().cast("array<string>"))) == []


def plain_python(text, negation=True, stops=True):
    """Classical cleaning for text without markup, links and contractions."""
    text = re.sub(r"\d+", " <num> ", text.lower())
    text = re.sub(r"[^a-zA-Z\s<>]", "", text)
    words = re.sub(r"[<>]", " ", text).split()
    words = [h for w in words for h in (("can", "not") if w == "cannot" else (w,))]
    out, seen = [], False
    for w in words:
        if seen:
            out.append(w + "_NEG")
            continue
        seen = negation and w in lx.NEGATORS
        if not (stops and w in lx.STOP_WORDS):
            out.append(w)
    return out


def test_classical_against_python(spark, sf):
    """Whole documents against a row-at-a-time loop, lemmas left out."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    steps = tx.remove_stopwords(tx.mark_negation(tx.words_of("text")))
    for row in docs.select("text", steps.alias("got")).collect():
        if re.search(r"\b(\w+nt)\b|['<]|http|www", row["text"]):
            continue
        assert row["got"] == plain_python(row["text"])


def test_fast_cleaning_equals_its_steps(spark, sf):
    docs = table(spark, sf, "documents").select(noisy("text").alias("text")).union(
        table(spark, sf, "documents").select("text")
    )
    steps = tx.join_tokens(
        tx.filter_short(
            tx.lemmatize(tx.remove_stopwords(tx.mark_negation(tx.words_of("text"))))
        )
    )
    differ = docs.filter(tx.clean_classical("text") != steps)
    assert differ.count() == 0


class Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "template")

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in ("script", "style", "template")))

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def test_broken_pages_against_parser(spark):
    rng = random.Random(12)
    pieces = [
        "<b>", "</b>", "<p class='a > b'>", '<a href="x">', "<a href='x", '<img alt="', ">", "<", "&", "&amp;", "&amp",
        "&lt", "&notit;", "&#65", "&#x41;", "&#150;", "&#0;", "&#xFFFFFF;", "&nope;", "&eacute", " text ", "x", "\n",
        "<!-- c -->", "<!--", "-->", "<!doctype html>", "<?pi x>", "</>", "</ p>", "</p x='>'>", "<br/>", "<script>",
        "</script >", "<style>", "</style>", "if (a<b) {}", "=", "'", '"', "<3", "<scripty>", ";",
    ]
    pages = ["<i>" + "".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, x string")
    got = {r["id"]: r["y"] for r in df.select("id", tx.strip_html("x").alias("y")).collect()}
    wrong = []
    for i, page in enumerate(pages):
        parser = Text()
        parser.feed(page)
        parser.close()
        if got[i] != "".join(parser.parts):
            wrong.append((page, got[i], "".join(parser.parts)))
    assert not wrong, wrong[:8]


def test_html_against_parser(spark, sf):
    pages = table(spark, sf, "pages").select("html", tx.strip_html("html").alias("got"))
    for row in pages.collect():
        parser = Text()
        parser.feed(row["html"])
        parser.close()
        assert row["got"] == "".join(parser.parts)


def test_deleted_class_is_the_complement(spark):
    """Every code point but surrogates is kept or deleted as in the definition."""
    codes = [c for c in range(1, 0x3100) if unicodedata.category(chr(c)) != "Cs"]
    df = spark.createDataFrame([(chr(c),) for c in codes], "x string")
    got = [r[0] for r in df.select(tx.remove_non_alpha("x")).collect()]
    want = [c if re.match(r"[a-zA-Z\s<>]", c) else "" for c in map(chr, codes)]
    assert got == want


def test_clean_frame_drops_blank_rows(spark):
    df = spark.createDataFrame([(1, "Great!"), (2, "!!!"), (3, None)], "id int, Text string")
    out = clean_frame(df, "classical")
    assert [(r["id"], r["cleaned_text"]) for r in out.collect()] == [(1, "great")]
    with pytest.raises(ValueError, match="no column 'body'; the table has id, Text"):
        clean_frame(df, "classical", "body")


def test_cleaning_runs_once_per_row(spark, sf):
    df = clean_frame(table(spark, sf, "documents"), "transformer", "text")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("http|www") == 1


def test_lexicon_paths_agree(spark):
    words = [(i, ["cats", "ran_NEG", "ran", "fast"] * (i + 1)) for i in range(5)]
    df = spark.createDataFrame([*words, (9, [])], "id int, t array<string>")
    lexicon = spark.createDataFrame(
        [("cats", "cat"), ("ran", "run"), ("ran_NEG", "x")], "word string, lemma string"
    )
    small = lemmatize_with_lexicon(df, "t", lexicon)
    salted = lemmatize_with_lexicon(df, "t", lexicon, max_broadcast_rows=1)
    want = {i: ["cat", "ran_NEG", "run", "fast"] * (i + 1) for i in range(5)} | {9: []}
    assert {r["id"]: r["t"] for r in small.collect()} == want
    assert {r["id"]: r["t"] for r in salted.collect()} == want


def test_lexicon_with_repeated_and_null_keys(spark):
    df = spark.createDataFrame(
        [(1, ["cats"]), (1, ["ran", "dogs"]), (None, ["cats"])], "id int, t array<string>"
    )
    lexicon = spark.createDataFrame([("cats", "cat"), ("ran", "run")], "word string, lemma string")
    got = [tuple(r["t"]) for r in lemmatize_with_lexicon(df, "t", lexicon).collect()]
    assert sorted(got) == [("cat",), ("cat",), ("run", "dogs")]


def test_cleaner_stage_is_saved(spark, folder):
    stage = TextCleaner(inputCol="Text", outputCol="c", mode="transformer")
    stage.write().save(f"{folder}/stage")
    df = spark.createDataFrame([("<b>A</b>  b",)], "Text string")
    again = TextCleaner.load(f"{folder}/stage")
    assert again.transform(df).first()["c"] == "A b"


def test_sql_functions_equal_columns(spark, sf):
    names = register_functions(spark)
    assert {"clean_minimal", "mark_negation", "binary_label"} <= set(names)
    docs = table(spark, sf, "documents").select(noisy("text").alias("x"))
    pages = table(spark, sf, "pages").select(F.col("html").alias("x"))
    both = docs.union(pages)
    for name in ("strip_html", "strip_tags_regex", "strip_urls", "normalize_whitespace",
                 "demojize", "expand_contractions", "replace_numbers", "remove_non_alpha",
                 "tokenize", "clean_minimal", "clean_regex", "analyze"):
        same = F.call_function(name, F.col("x")).eqNullSafe(getattr(tx, name)("x"))
        assert both.filter(~same).count() == 0, name
    whole = F.call_function("clean_classical", F.col("x"))
    assert docs.filter(~whole.eqNullSafe(tx.clean_classical("x"))).count() == 0
    words = both.select(tx.tokenize(tx.remove_non_alpha(F.lower("x"))).alias("t"))
    for name in ("mark_negation", "remove_stopwords", "lemmatize", "filter_short"):
        same = F.call_function(name, F.col("t")).eqNullSafe(getattr(tx, name)("t"))
        assert words.filter(~same).count() == 0, name
    row = spark.sql(
        "SELECT binary_label(3), binary_label(4.9), binary_label(NULL), "
        "three_class_label(3), label_id('LABEL_7')"
    ).first()
    assert tuple(row) == (0, 1, None, 1, 7)


ODD_MARKUP = {
    "<a title='a > b'>x</a>": "x",
    "caf&eacute; <b>&amp;lt; &hearts;</b>": "café &lt; ♥",
    "a<?php echo 1; ?>b": "ab",
    "x<script>var a=1;": "x",
    "<b>&#0233;&#xE9;&#x1F600;&#00000000233;</b>&nope;&#0;": "éé\U0001F600é&nope;\uFFFD",
    "<i>x</i> caf&eacute au &notit; &#150;&#x80 &am<b>p;": "x café au ¬it; –€ &amp;",
    "a<b title=\"x>y</b>z": "a<b title=\"x>yz",
    "a<!-- open > b</p>c": "a<!-- open > bc",
    "x</a title='q'>y</>z</ b>": "xyz",
    "1 < 2 &lt 3": "1 < 2 < 3",
    "<p it's>x isn't > y</p>": "x isn't > y",
    '<img alt="a>b" src=x>t': "t",
    "&#233; stays": "&#233; stays",
}


def test_odd_markup_by_column_and_sql(spark):
    register_functions(spark)
    df = spark.createDataFrame([(x,) for x in ODD_MARKUP], "x string")
    rows = df.select(
        "x", tx.strip_html("x").alias("c"), F.expr("strip_html(x)").alias("s"),
        (tx.clean_classical("x") == F.expr("clean_classical(x)")).alias("same"),
    ).collect()
    assert {r["x"]: r["c"] for r in rows} == ODD_MARKUP
    assert all(r["c"] == r["s"] and r["same"] for r in rows)


def test_sql_labels_refuse_what_columns_refuse(spark):
    register_functions(spark)
    df = spark.createDataFrame([(None,), (2.0,)], "s double")
    assert [r[0] for r in df.selectExpr("binary_label(s)").collect()] == [None, 0]
    for name in ("binary_label", "three_class_label"):
        with pytest.raises(Exception, match="Invalid score"):
            spark.range(1).selectExpr(f"{name}(9D)").collect()
