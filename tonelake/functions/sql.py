"""The text and label operators as SQL functions of a session.

``register_functions(spark)`` makes them temporary SQL functions, whose bodies
Spark inlines: a query that calls them stays a plain expression tree. Operators that give several rows for
one are table functions, for ``FROM t, LATERAL f(t.text)``; they become a generator over the row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

from . import lexicons as lx
from . import phrases as ph
from . import text as tx


def _raw(text: str) -> str:
    """A string literal, without escapes where its quotes allow it."""
    if '"' in text and "'" in text:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    quote = '"' if '"' not in text else "'"
    return f"r{quote}{text}{quote}"


# As the column functions do: a score out of range is an error, a missing one is not
_REFUSED = (
    "WHEN score IS NOT NULL THEN CAST(raise_error(concat('Invalid score: ', "
    "CAST(score AS STRING))) AS INT) END"
)


def _words(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _sub(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, {_raw(pattern)}, {_raw(new)})"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _swap(x: str, pattern: str, name: str) -> str:
    """Matches replaced by ``name``, an expression over ``p``."""
    mark = ph.MARK
    return (
        f"array_join(transform(split(regexp_replace({x}, {_raw('(' + pattern + ')')}, '{mark}$1{mark}'), '{mark}'), "
        f"(p, i) -> CASE WHEN i % 2 = 1 THEN coalesce({name}, p) ELSE p END), '')"
    )


def _map(table: Mapping[str, str]) -> str:
    return f"str_to_map({_raw(ph.map_text(table))}, {_raw(tx._NEXT)}, {_raw(tx._PAIR)})"


def _entities(x: str) -> str:
    digits = "regexp_extract(p, '^&#[xX]?0*([0-9a-fA-F]*);?$', 1)"
    short = _let("d", digits, "CASE WHEN length(d) > 7 THEN '9999999' ELSE d END")
    value = f"CASE WHEN lower(substring(p, 3, 1)) = 'x' THEN conv({short}, 16, 10) ELSE {short} END"
    character = (
        "CASE WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN '\uFFFD' "
        f"WHEN n BETWEEN 128 AND 159 THEN try_element_at({_map(tx._PAGE)}, hex(n)) "
        "WHEN n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 "
        "OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' "
        "ELSE decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END"
    )
    numeric = _let("n", f"coalesce(try_cast({value} AS BIGINT), 0)", character)
    named = f"try_element_at({_map(tx.NAMED_REFERENCES)}, p)"
    return _swap(x, tx.reference_pattern(), f"CASE WHEN startswith(p, '&#') THEN {numeric} ELSE {named} END")


def _contractions(x: str) -> str:
    x = _sub(x, "(?<=[A-Za-z])[\u2019`](?=[A-Za-z])", "'")
    table = ph.contraction_table()
    every, _ = ph.contraction_patterns(tuple(sorted(table.items())))
    full = f"try_element_at({_map(table)}, lower(p))"
    cased = (
        f"CASE WHEN p = upper(p) AND p <> lower(p) THEN upper({full}) "
        f"WHEN left(p, 1) = upper(left(p, 1)) AND left(p, 1) <> lower(left(p, 1)) "
        f"THEN upper(left({full}, 1)) || substring({full}, 2) ELSE {full} END"
    )
    return _swap(x, every, cased)


def _emoji(x: str) -> str:
    needs, pattern, names = ph.emoji_parts()
    key = f"replace(p, '{ph.JOIN_VARIANT}', '')"
    name = (
        f"':' || coalesce(try_element_at({_map(names)}, {key}), concat_ws('_', "
        f"try_element_at({_map(names)}, left({key}, length({key}) - 1)), "
        f"try_element_at({_map(lx.SKIN_TONES)}, right({key}, 1)))) || ':'"
    )
    return f"CASE WHEN rlike({x}, {_raw(needs)}) THEN {_swap(x, pattern, name)} ELSE {x} END"


def _split_words(x: str) -> str:
    halves = "|".join(rf"{a}(?={b}\b)" for a, b in lx.SPLIT_WORDS)
    return _sub(x, rf"\b({halves})", "$1 ")


def _lemma(w: str) -> str:
    irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in lx.IRREGULAR_LEMMAS.items())
    return f"""CASE WHEN {w} IN ({_words(lx.IRREGULAR_LEMMAS)}) THEN CASE {w} {irregular} END
      WHEN NOT endswith({w}, 's') OR length({w}) <= 3 THEN {w}
      WHEN endswith({w}, 'ies') AND length({w}) > 4
        THEN left({w}, length({w}) - 3) || 'y'
      WHEN rlike({w}, '(ss|x|ch|sh|z)es$') THEN left({w}, length({w}) - 2)
      WHEN rlike({w}, '(s|u|i)s$') THEN {w}
      ELSE left({w}, length({w}) - 1) END"""


def function_bodies() -> dict[str, tuple[str, str, str]]:
    """Name to ``(parameters, result type, body)``; later ones call earlier ones."""
    one, many = "x STRING", "tokens ARRAY<STRING>"
    place = (
        "array_position(transform(tokens, w -> "
        f"w IN ({_words(lx.NEGATORS)})), true)"
    )
    return {
        "strip_tags_regex": (one, "STRING", _sub("x", "<[^>]+>", "")),
        "strip_html": (
            one, "STRING",
            "CASE WHEN NOT contains(x, '<') THEN x WHEN contains(x, '&') THEN replace("
            f"{_entities(_sub('x', tx._NOT_TEXT, f'{tx._CUT}$1{tx._CUT}'))}, '{tx._CUT}', '') "
            f"ELSE {_sub('x', tx._NOT_TEXT, '$1')} END",
        ),
        "strip_urls": (one, "STRING", _sub("x", rf"(?:http|www)[^{lx.SPACE}]+", "")),
        "normalize_whitespace": (
            one, "STRING", f"trim({_sub('x', f'[{lx.SPACE}]+', ' ')})"
        ),
        "expand_contractions": (one, "STRING", _contractions("x")),
        "replace_numbers": (one, "STRING", _sub("x", r"\p{Nd}+", " <num> ")),
        "remove_non_alpha": (one, "STRING", _sub("x", tx._DELETED, "")),
        "tokenize": (
            one, "ARRAY<STRING>",
            f"array_remove(split({_split_words('x')}, {_raw(f'[<>{lx.SPACE}]+')}), '')",
        ),
        "mark_negation": (
            many, "ARRAY<STRING>",
            f"transform(array({place}), p -> transform(tokens, (w, i) -> "
            "CASE WHEN p > 0 AND i >= p THEN w || '_NEG' ELSE w END))[0]",
        ),
        "remove_stopwords": (
            many, "ARRAY<STRING>",
            "filter(tokens, w -> endswith(w, '_NEG') OR NOT "
            f"(w IN ({_words(lx.STOP_WORDS)})))",
        ),
        "lemmatize": (
            many, "ARRAY<STRING>",
            "transform(tokens, w -> CASE WHEN endswith(w, '_NEG') THEN w "
            f"ELSE {_lemma('w')} END)",
        ),
        "filter_short": (
            many, "ARRAY<STRING>",
            "filter(tokens, w -> length(w) > 2 OR endswith(w, '_NEG'))",
        ),
        "demojize": (one, "STRING", _emoji("x")),
        "clean_classical": (
            one, "STRING",
            "array_join(filter_short(lemmatize(remove_stopwords(mark_negation(tokenize("
            "remove_non_alpha(replace_numbers(lower(expand_contractions(demojize("
            "strip_urls(strip_html(x)))))))))))), ' ')",
        ),
        "clean_minimal": (
            one, "STRING", "normalize_whitespace(strip_urls(strip_html(x)))"
        ),
        "clean_regex": (
            one, "STRING", "normalize_whitespace(strip_urls(strip_tags_regex(x)))"
        ),
        "analyze": (
            one, "ARRAY<STRING>",
            r"regexp_extract_all(lower(x), r'[\p{L}\p{N}_]{2,}', 0)",
        ),
        "binary_label": (
            "score DOUBLE", "INT",
            "CASE WHEN CAST(score AS INT) BETWEEN 1 AND 3 THEN 0 "
            f"WHEN CAST(score AS INT) BETWEEN 4 AND 5 THEN 1 {_REFUSED}",
        ),
        "three_class_label": (
            "score DOUBLE", "INT",
            "CASE WHEN CAST(score AS INT) BETWEEN 1 AND 2 THEN 0 "
            "WHEN CAST(score AS INT) = 3 THEN 1 "
            f"WHEN CAST(score AS INT) BETWEEN 4 AND 5 THEN 2 {_REFUSED}",
        ),
        "label_id": (
            one, "INT", r"try_cast(regexp_extract(x, r'^LABEL_(\d+)$', 1) AS INT)"
        ),
    }


def _ngrams(x: str, low: str, high: str) -> str:
    terms = rf"coalesce(regexp_extract_all(lower({x}), r'[\p{{L}}\p{{N}}_]{{2,}}', 0), array())"
    starts = "CASE WHEN size(t) >= n THEN sequence(1, size(t) - n + 1) ELSE CAST(array() AS ARRAY<INT>) END"
    grams = f"transform({starts}, i -> array_join(slice(t, i, n), ' '))"
    return _let("t", terms, f"flatten(transform(sequence({low}, {high}), n -> {grams}))")


def _term_counts(terms: str) -> str:
    begins = "filter(sequence(0, size(s) - 1), i -> i = 0 OR get(s, i) <> get(s, i - 1))"
    counted = (
        "transform(b, (at, k) -> named_struct('term', get(s, at), "
        "'tf', CAST(coalesce(get(b, k + 1), size(s)) - at AS BIGINT)))"
    )
    none = "CAST(array() AS ARRAY<STRUCT<term: STRING, tf: BIGINT>>)"
    runs = _let("b", begins, counted)
    return _let("s", f"array_sort({terms})", f"CASE WHEN size(s) > 0 THEN {runs} ELSE {none} END")


def _reason(x: str, most: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'empty' "
        f"WHEN NOT rlike({x}, {_raw(f'[^{lx.SPACE}]')}) THEN 'whitespace_only' "
        f"WHEN length({x}) > {most} THEN 'too_long' END"
    )


def table_function_bodies() -> dict[str, tuple[str, str, str]]:
    """Name to ``(parameters, columns, query)``."""
    span = "x STRING, low INT DEFAULT 1, high INT DEFAULT 1"
    return {
        # n-grams of a text by their place, shorter ones first
        "text_ngrams": (
            span, "place INT, term STRING",
            f"SELECT p, g FROM (SELECT posexplode({_ngrams('x', 'low', 'high')}) AS (p, g))",
        ),
        # distinct n-grams of a text with their counts
        "term_freq": (
            span, "term STRING, tf BIGINT",
            f"SELECT term, tf FROM (SELECT inline({_term_counts(_ngrams('x', 'low', 'high'))}) AS (term, tf))",
        ),
        # why a text is refused, no row for a good one
        "text_refusal": (
            f"x STRING, most INT DEFAULT {lx.MAX_TEXT_CHARS}", "reason STRING",
            f"SELECT r FROM (SELECT explode(filter(array({_reason('x', 'most')}), r -> r IS NOT NULL)) AS r)",
        ),
    }


def register_functions(spark: SparkSession) -> list[str]:
    """Create or replace the functions in this session; returns their names."""
    bodies = function_bodies()
    for name, (parameters, result, body) in bodies.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) "
            f"RETURNS {result} RETURN {body}"
        )
    tables = table_function_bodies()
    for name, (parameters, columns, body) in tables.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) "
            f"RETURNS TABLE({columns}) RETURN {body}"
        )
    return [*bodies, *tables]
