"""Text cleaning as Column -> Column expressions.

Every function stays in the JVM: no Python worker is started, so filters and
projections still move through the plan. Where an input is used more than once
(a guard and its branch, a position and the array it points into) it is bound
with :func:`bind`, so that the optimizer cannot paste the upstream expression
into each use.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cache, partial
from html.entities import html5
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx
from . import phrases as ph

MODES = ("classical", "transformer")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a let-expression)."""
    return F.transform(F.array(value), body)[0]


def _as_col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_text(col: Column | str) -> Column:
    """Any value as a string; null stays null."""
    return _as_col(col).cast("string")


def _ranges_without(kept: str) -> str:
    """Character class of everything but ``kept``, as plain ranges.

    Java walks a list of ranges several times faster than a negated class.
    """
    codes = sorted(map(ord, kept))
    edges = [-1, *codes, 0x110000]
    gaps = [(a + 1, b - 1) for a, b in zip(edges, edges[1:]) if b - a > 1]
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in gaps) + "]+"


_ASCII_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DELETED = _ranges_without(
    _ASCII_LETTERS + "<>" + "".join(c for c in map(chr, range(0x3001)) if c.isspace())
)

# One left-to-right pass: element bodies that are not text, comments, declarations,
# processing instructions, then tags. A tag starts with a letter, so "<3" survives, and a ">" in a
# quoted attribute value does not end it. What is left, a tag whose quote or a comment whose end is
# missing, stays as text up to the next ">" (the group).
_GAP = f"[{lx.SPACE}]"
_NOT_TEXT = (
    rf"(?is)<(?:script(?=[{lx.SPACE}/>])[^>]*+(?<!/)>.*?(?:</{_GAP}*script{_GAP}*>|\z)"
    rf"|style(?=[{lx.SPACE}/>])[^>]*+(?<!/)>.*?(?:</{_GAP}*style{_GAP}*>|\z)"
    rf"|template(?=[{lx.SPACE}/>])[^>]*+>.*?</template{_GAP}*>"
    rf"|!--.*?--{_GAP}*+>"
    r"|!(?!--|\[)[^>]*+>"
    r"|\?[^>]*+>"
    r"|/[^>]*+>"
    rf"|[a-z](?:[^>=]++|={_GAP}*+\"[^\"]*+\"|={_GAP}*+'[^']*+'|=(?!{_GAP}*+[\"']))*+>)"
    r"|(<(?:[a-z]|!--)[^>]*+>)"
)

# Every named reference of HTML with its characters, some of them without a semicolon.
_PAIR, _NEXT = "\x1e", "\x1f"
NAMED_REFERENCES = {f"&{name}": chars for name, chars in sorted(html5.items())}
# Set where a tag was, so that no reference is put together across it
_CUT = "\uFDD1"
# Code points that a numeric reference doesn't mean: those of another code page, and none
_PAGE = {
    f"{code:X}": bytes([code]).decode("cp1252", "replace").replace("\uFFFD", chr(code))
    for code in range(0x80, 0xA0)
}


@cache
def reference_pattern() -> str:
    """A numeric reference, or the longest named one."""
    return f"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|{ph.trie_pattern(n[1:] for n in NAMED_REFERENCES)})"


def _numeric(code: Column) -> Column:
    """The character of ``&#NNN;`` or ``&#xHH;``, semicolon or not."""
    digits = F.regexp_extract(code, "^&#[xX]?0*([0-9a-fA-F]*);?$", 1)
    hexed = F.lower(F.substring(code, 3, 1)) == "x"
    # longer numbers are beyond all characters
    short = F.when(F.length(digits) > 7, F.lit("9999999")).otherwise(digits)
    value = F.when(hexed, F.conv(short, 16, 10)).otherwise(short)

    def character(n: Column) -> Column:
        point = F.coalesce(n, F.lit(0))
        plain = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        none = (
            point.between(1, 8) | (point == 11) | point.between(14, 31) | (point == 127)
            | point.between(0xFDD0, 0xFDEF) | (point % 0x10000 >= 0xFFFE)
        )
        return (
            F.when((point == 0) | point.between(0xD800, 0xDFFF) | (point > 0x10FFFF), F.lit("\uFFFD"))
            .when(point.between(0x80, 0x9F), F.try_element_at(ph.as_map(_PAGE), F.hex(point)))
            .when(none, F.lit(""))
            .otherwise(plain)
        )

    return bind(value.try_cast("bigint"), character)


def _entities(text: Column) -> Column:
    """Decode references in one pass, the longest name first; unknown ones stay."""
    named = ph.as_map(NAMED_REFERENCES)
    char = lambda code: F.when(code.startswith("&#"), _numeric(code)).otherwise(
        F.try_element_at(named, code)
    )
    return ph.swap(text, reference_pattern(), char)


def strip_html(col: Column | str) -> Column:
    """Text nodes only, joined without a separator.

    Text without ``<`` is returned untouched, character references included. References are read as browsers
    do, with or without a semicolon, but not across a tag. Broken markup: an element of code or style that
    isn't closed goes to the end, a tag or comment that isn't closed is text.
    """

    def parsed(text: Column) -> Column:
        marked = F.replace(
            _entities(F.regexp_replace(text, _NOT_TEXT, f"{_CUT}$1{_CUT}")), F.lit(_CUT), F.lit("")
        )
        return F.when(text.contains("&"), marked).otherwise(F.regexp_replace(text, _NOT_TEXT, "$1"))

    return bind(
        _as_col(col), lambda t: F.when(t.contains("<"), parsed(t)).otherwise(t)
    )


def strip_tags_regex(col: Column | str) -> Column:
    """Drop anything between ``<`` and ``>``; bodies and references stay."""
    return F.regexp_replace(_as_col(col), r"<[^>]+>", "")


def strip_urls(col: Column | str) -> Column:
    """Delete ``http...`` and ``www...`` up to the next whitespace."""
    return F.regexp_replace(_as_col(col), rf"(?:http|www)[^{lx.SPACE}]+", "")


def normalize_whitespace(col: Column | str) -> Column:
    """Every whitespace run to one space, ends trimmed."""
    return F.trim(F.regexp_replace(_as_col(col), rf"[{lx.SPACE}]+", " "))


def demojize(col: Column | str, lexicon: Mapping[str, str] | None = None) -> Column:
    """Emoji to ``:name:``, the longest sequence that has a name first.

    ``lexicon`` maps sequences (joined ones, flags, keycaps) to names, as ``phrases.read_phrases``
    reads it from a table; without one, names follow a rule (``phrases.emoji_names``). A tone of skin
    after a named emoji is added to its name. Variation selectors are optional anywhere. Only rows that
    hold a first character of a sequence are looked at.
    """
    needs, pattern, names = ph.emoji_parts(lexicon)
    known, tones = ph.as_map(names), ph.as_map(lx.SKIN_TONES)

    def name(part: Column) -> Column:
        def of(key: Column) -> Column:
            tone = F.try_element_at(tones, F.right(key, F.lit(1)))
            base = F.try_element_at(known, F.left(key, F.length(key) - 1))
            return F.coalesce(F.try_element_at(known, key), F.concat_ws("_", base, tone))

        return F.concat(F.lit(":"), bind(F.replace(part, F.lit(ph.JOIN_VARIANT), F.lit("")), of), F.lit(":"))

    return bind(
        _as_col(col), lambda t: F.when(t.rlike(needs), ph.swap(t, pattern, name)).otherwise(t)
    )


def expand_contractions(col: Column | str, table: Mapping[str, str] | None = None) -> Column:
    """``don't`` to ``do not``, ``can't`` to ``cannot``, ``gonna`` to ``going to`` and so on.

    One pass over the text with all entries of ``table`` (keys in small letters; without one,
    ``phrases.contraction_table``), the longest first. A capital, or capitals, are kept.
    """
    table = ph.contraction_table() if table is None else table
    every, bare = ph.contraction_patterns(tuple(sorted(table.items())))
    known = ph.as_map(table)

    def full(part: Column) -> Column:
        def cased(text: Column) -> Column:
            loud = (part == F.upper(part)) & (part != F.lower(part))
            first = F.left(part, F.lit(1))
            begins = (first == F.upper(first)) & (first != F.lower(first))
            return (
                F.when(loud, F.upper(text))
                .when(begins, F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, 2, 1000)))
                .otherwise(text)
            )

        return bind(F.try_element_at(known, F.lower(part)), cased)

    plain = bind(
        _as_col(col),
        lambda t: F.when(
            t.contains("\u2019") | t.contains("`"),
            F.regexp_replace(t, r"(?<=[A-Za-z])[\u2019`](?=[A-Za-z])", "'"),
        ).otherwise(t),
    )
    return bind(
        plain,
        lambda t: F.when(t.contains("'"), ph.swap(t, every, full))
        .when(t.rlike(bare), ph.swap(t, bare, full))
        .otherwise(t),
    )


def lower_text(col: Column | str) -> Column:
    return F.lower(_as_col(col))


def replace_numbers(col: Column | str) -> Column:
    """Each run of decimal digits, in any script, to `` <num> ``."""
    return F.regexp_replace(_as_col(col), r"\p{Nd}+", " <num> ")


def remove_non_alpha(col: Column | str) -> Column:
    """Delete (not blank) all but ASCII letters, whitespace, ``<`` and ``>``."""
    return F.regexp_replace(_as_col(col), _DELETED, "")


def tokenize(col: Column | str) -> Column:
    """Words of text that :func:`remove_non_alpha` has been over.

    ``<num>`` falls apart at its brackets and leaves ``num``.
    """
    return _split_words(col, rf"[<>{lx.SPACE}]+")


def _split_words(col: Column | str, gap: str) -> Column:
    halves = "|".join(rf"{a}(?={b}\b)" for a, b in lx.SPLIT_WORDS)
    text = F.regexp_replace(_as_col(col), rf"(?=[cglw])\b({halves})", "$1 ")
    return F.array_remove(F.split(text, gap), "")


def _first_negator(tokens: Column) -> Column:
    """1-based place of the first negator, 0 without one."""
    return F.coalesce(
        F.array_position(F.transform(tokens, lambda w: w.isin(*lx.NEGATORS)), True),
        F.lit(0),
    ).cast("int")


def mark_negation(tokens: Column | str) -> Column:
    """``_NEG`` on every token after the first negator; the scope never closes."""
    return bind(
        _as_col(tokens),
        lambda t: bind(
            _first_negator(t),
            lambda p: F.transform(
                t,
                lambda w, i: F.when(
                    (p > 0) & (i >= p), F.concat(w, F.lit("_NEG"))
                ).otherwise(w),
            ),
        ),
    )


def remove_stopwords(
    tokens: Column | str, words: Sequence[str] = lx.STOP_WORDS
) -> Column:
    """Drop stop words unless negation marked them."""
    return F.filter(
        _as_col(tokens), lambda w: ~w.isin(*words) | w.endswith("_NEG")
    )


def noun_lemma(word: Column) -> Column:
    """Singular of one word by suffix; the rule-based stand-in for a lexicon."""
    irregular = F.create_map(
        *[F.lit(x) for pair in lx.IRREGULAR_LEMMAS.items() for x in pair]
    )
    size = F.length(word)

    def minus(n: int) -> Column:
        return F.substring(word, F.lit(1), size - n)

    return (
        F.when(word.isin(*lx.IRREGULAR_LEMMAS), F.element_at(irregular, word))
        .when(~word.endswith("s") | (size <= 3), word)
        .when(word.endswith("ies") & (size > 4), F.concat(minus(3), F.lit("y")))
        .when(
            word.endswith("sses") | word.endswith("xes") | word.endswith("ches")
            | word.endswith("shes") | word.endswith("zes"),
            minus(2),
        )
        .when(
            word.endswith("ss") | word.endswith("us") | word.endswith("is"), word
        )
        .otherwise(minus(1))
    )


def lemmatize(tokens: Column | str) -> Column:
    """Suffix lemmas inside the array; ``_NEG`` tokens pass through."""
    return F.transform(
        _as_col(tokens),
        lambda w: F.when(w.endswith("_NEG"), w).otherwise(noun_lemma(w)),
    )


def filter_short(tokens: Column | str, min_len: int = 3) -> Column:
    return F.filter(
        _as_col(tokens), lambda w: (F.length(w) >= min_len) | w.endswith("_NEG")
    )


def join_tokens(tokens: Column | str) -> Column:
    return F.array_join(_as_col(tokens), " ")


def clean_minimal(col: Column | str) -> Column:
    """HTML and URLs out, whitespace tidied; case, digits and emoji stay."""
    return normalize_whitespace(strip_urls(strip_html(to_text(col))))


def clean_regex(col: Column | str) -> Column:
    """Like :func:`clean_minimal`, with tags cut by pattern."""
    return normalize_whitespace(strip_urls(strip_tags_regex(to_text(col))))


def words_of(col: Column | str) -> Column:
    """The string half of classical cleaning, ending in a token array."""
    text = strip_urls(strip_html(to_text(col)))
    text = lower_text(expand_contractions(demojize(text)))
    # only letters, brackets and whitespace are left: any non-letter is a gap
    return _split_words(
        remove_non_alpha(replace_numbers(text)), r"[\x00-@\[-`{-\x{10ffff}]+"
    )


def clean_classical(
    col: Column | str,
    use_negation: bool = True,
    drop_stopwords: bool = True,
    stop_words: Sequence[str] = lx.STOP_WORDS,
) -> Column:
    """Full cleaning for bag-of-words models.

    Equal to mark_negation, remove_stopwords, lemmatize and filter_short in
    that order. Tokens behind the negator are never stop words, short or
    lemmatizable, so the array is cut there once and only the head is worked on.
    """

    def head(tokens: Column) -> Column:
        if drop_stopwords:
            tokens = F.filter(tokens, lambda w: ~w.isin(*stop_words))
        return F.filter(
            F.transform(tokens, noun_lemma), lambda w: F.length(w) > 2
        )

    def negated(tokens: Column, place: Column) -> Column:
        size = F.size(tokens)
        none = place == 0
        before = F.slice(tokens, F.lit(1), F.when(none, size).otherwise(place))
        after = F.slice(tokens, place + 1, F.when(none, 0).otherwise(size - place))
        tail = F.transform(after, lambda w: F.concat(w, F.lit("_NEG")))
        return F.concat(head(before), tail)

    words = words_of(col)
    if use_negation:
        words = bind(
            words, lambda t: bind(_first_negator(t), lambda p: negated(t, p))
        )
    else:
        words = head(words)
    return join_tokens(words)


def cleaner(mode: str, **options: Any) -> Callable[[Column | str], Column]:
    """The cleaning function of a mode; options are those of ``clean_classical``."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, got {mode!r}")
    if mode == "classical":
        return partial(clean_classical, **options)
    if options:
        raise ValueError(f"mode {mode} has no options, got {', '.join(options)}")
    return clean_minimal


def is_blank(col: Column | str) -> Column:
    """Null, empty or nothing but whitespace."""
    text = _as_col(col)
    return text.isNull() | ~text.rlike(rf"[^{lx.SPACE}]")


def analyze(col: Column | str) -> Column:
    """Lower-cased runs of two or more word characters (``_`` is one)."""
    return F.regexp_extract_all(
        F.lower(_as_col(col)), F.lit(r"[\p{L}\p{N}_]{2,}"), 0
    )


def ngrams(tokens: Column | str, ngram_range: tuple[int, int] = (1, 1)) -> Column:
    """All n-grams of the range, space-joined, shorter ones first."""
    low, high = check_ngram_range(ngram_range)

    def of_size(t: Column, n: int) -> Column:
        if n == 1:
            return t
        starts = F.when(
            F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))

    if (low, high) == (1, 1):
        return _as_col(tokens)
    return bind(
        _as_col(tokens),
        lambda t: F.concat(*[of_size(t, n) for n in range(low, high + 1)]),
    )


def check_ngram_range(ngram_range: object) -> tuple[int, int]:
    if not isinstance(ngram_range, tuple) or len(ngram_range) != 2:
        raise ValueError(
            f"ngram_range is a pair of least and most words, not {ngram_range}"
        )
    low, high = ngram_range
    if not 1 <= low <= high:
        raise ValueError(f"ngram_range needs 1 <= low <= high, got {ngram_range}")
    return low, high


def term_counts(terms: Column | str) -> Column:
    """``array<struct<term, tf>>`` of a term array, without a shuffle.

    The array is sorted and cut into runs, n log n in the length of the text.
    """

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return bind(
            starts,
            lambda b: F.transform(
                b,
                lambda at, k: F.struct(
                    F.get(s, at).alias("term"),
                    (F.coalesce(F.get(b, k + 1), F.size(s)) - at)
                    .cast("bigint").alias("tf"),
                ),
            ),
        )

    return bind(
        F.sort_array(_as_col(terms)),
        lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(
            F.array().cast("array<struct<term:string,tf:bigint>>")
        ),
    )
