"""DuckDB SQL for the queries, written apart from the Spark expressions.

Only fixed values (word lists and rule tables) are shared. Text steps are
chained as common table expressions, one per step, each on a column ``t``.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions import lexicons as lx
from .data import NOISE

ORACLES: dict[str, str] = {}

# whitespace for RE2, whose \s is ASCII and leaves out the vertical tab
WS = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

REVIEWS = """
reviews AS (
  SELECT d.doc_id AS review_id, d.text AS "Text", d.lang, d.source,
    CAST(CASE WHEN l.doc_id IS NULL THEN NULL
         WHEN quality = 1 AND toxic = 0 THEN 4 + d.doc_id % 2
         WHEN quality = 1 THEN 3 WHEN toxic = 0 THEN 2 ELSE 1 END AS INTEGER)
      AS "Score"
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""

LABELLED = """
labelled AS (
  SELECT review_id, "Score", CAST(CASE WHEN "Score" <= 3 THEN 0 ELSE 1 END
    AS INTEGER) AS label
  FROM reviews WHERE "Score" IS NOT NULL AND "Score" <> 3
)"""

LABELLED3 = """
labelled3 AS (
  SELECT review_id, "Score", CAST(CASE WHEN "Score" <= 2 THEN 0
    WHEN "Score" = 3 THEN 1 ELSE 2 END AS INTEGER) AS label
  FROM reviews WHERE "Score" IS NOT NULL
)"""


def with_(*tables: str, then: str) -> str:
    return "WITH " + ",".join(tables) + "\n" + then


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(pattern: str, new: str, x: str = "t") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(new)}, 'g')"


Step = str


def noisy(x: str) -> str:
    for word, noise in NOISE:
        x = f"replace({x}, {q(word)}, {q(noise)})"
    return x


# --- text steps: lists of expressions on t ------------------------------------


def html_steps() -> list[Step]:
    bare = "t"
    for element in ("script", "style", "template"):
        bare = sub(rf"(?is)<{element}\b[^>]*>.*?</{element}\s*>", "", bare)
    bare = sub(r"(?s)<!--.*?-->", "", bare)
    bare = sub(r"<![A-Za-z][^>]*>", "", bare)
    bare = sub(r"</?[A-Za-z][^>]*>", "", bare)
    for name, char in lx.NAMED_ENTITIES:
        bare = f"replace({bare}, {q(name)}, {q(char)})"
    bare = f"replace({bare}, '&#39;', {q(chr(39))})"
    bare = f"replace({bare}, '&amp;', '&')"
    return [f"CASE WHEN contains(t, '<') THEN {bare} ELSE t END"]


URLS = [sub(rf"(http|www)[^{WS}]+", "")]
SPACES = [f"trim({sub(rf'[{WS}]+', ' ')})"]
TAGS = [sub(r"<[^>]+>", "")]
LOWER = ["lower(t)"]
NUMBERS = [sub(r"\p{Nd}+", " <num> ")]
LETTERS = [sub(rf"[^a-zA-Z<>{WS}]", "")]


def emoji_steps() -> list[Step]:
    out = "t"
    for char, name in lx.EMOJI_NAMES.items():
        out = f"replace({out}, {q(char)}, {q(f':{name}:')})"
    return [out]


def contraction_steps() -> list[Step]:
    """The same entries as a chain of replacements, in an order that gives the longest."""
    lead = [k for k in lx.SLANG if k[0] == "'"]
    steps = [sub(r"([A-Za-z])[\x{2019}`]([A-Za-z])", r"\1'\2")]
    steps += [sub(rf"(?i)\b{k}\b", v) for k, v in lx.IRREGULAR_CONTRACTIONS.items() if "'" in k]
    steps += [sub(rf"(?i){k}\b", v) for k, v in lx.ENDINGS.items()]
    steps.append(sub(rf"(?i)\b({'|'.join(lx.IS_AFTER)})'s\b", r"\1 is"))
    steps.append(sub(rf"(?i)\b({'|'.join(lx.BARE_NOT_STEMS)})nt\b", r"\1 not"))
    steps += [sub(rf"(?i)\b{k}\b", v) for k, v in lx.IRREGULAR_CONTRACTIONS.items() if "'" not in k]
    steps += [sub(rf"(?i)\b{k}\b", v) for k, v in lx.SLANG.items() if k not in lead]
    return steps + [sub(rf"(?i)(^|[^A-Za-z]){k}\b", rf"\1{lx.SLANG[k]}") for k in lead]


def token_steps() -> list[Step]:
    split = "t"
    for a, b in lx.SPLIT_WORDS:
        split = sub(rf"\b({a})({b})\b", r"\1 \2", split)
    return [
        split,
        f"list_filter(regexp_split_to_array(t, {q(rf'[<>{WS}]+')}), lambda w: w <> '')",
    ]


def in_list(x: str, words) -> str:
    return f"{x} IN ({', '.join(map(q, words))})"


NEGATION = [
    "struct_pack(t := t, p := list_position(list_transform(t, lambda w: "
    + in_list("w", lx.NEGATORS) + "), true))",
    "list_transform(t.t, lambda w, i: CASE WHEN t.p > 0 AND i > t.p "
    "THEN w || '_NEG' ELSE w END)",
]
STOPS = [
    "list_filter(t, lambda w: ends_with(w, '_NEG') OR NOT "
    + in_list("w", lx.STOP_WORDS) + ")"
]


def lemma(w: str) -> str:
    irregular = " ".join(
        f"WHEN {w} = {q(a)} THEN {q(b)}" for a, b in lx.IRREGULAR_LEMMAS.items()
    )
    return (
        f"CASE {irregular} "
        f"WHEN length({w}) <= 3 OR NOT regexp_matches({w}, 's$') THEN {w} "
        f"WHEN length({w}) > 4 AND regexp_matches({w}, 'ies$') "
        f"THEN left({w}, length({w}) - 3) || 'y' "
        f"WHEN regexp_matches({w}, '(ss|x|ch|sh|z)es$') THEN left({w}, length({w}) - 2) "
        f"WHEN regexp_matches({w}, '(s|u|i)s$') THEN {w} "
        f"ELSE left({w}, length({w}) - 1) END"
    )


LEMMAS = [
    "list_transform(t, lambda w: CASE WHEN ends_with(w, '_NEG') THEN w ELSE "
    + lemma("w") + " END)"
]
LONG = ["list_filter(t, lambda w: length(w) > 2 OR ends_with(w, '_NEG'))"]
JOIN = ["array_to_string(t, ' ')"]
MINIMAL = html_steps() + URLS + SPACES
WORDS = (
    html_steps() + URLS + emoji_steps() + contraction_steps() + LOWER + NUMBERS
    + LETTERS + token_steps()
)
CLASSICAL = WORDS + NEGATION + STOPS + LEMMAS + LONG + JOIN


def chain(source: str, keys: str, start: str, steps: list[Step]) -> str:
    """CTEs ``s0 .. sn``; the last one is named ``done``."""
    parts = [f"s0 AS (SELECT {keys}, {start} AS t FROM {source})"]
    for i, step in enumerate(steps):
        parts.append(f"s{i + 1} AS (SELECT {keys}, {step} AS t FROM s{i})")
    parts.append(f"done AS (SELECT * FROM s{len(steps)})")
    return ",\n".join(parts)


def text_oracle(
    name: str, source: str, key: str, start: str, steps: list[Step], out: str = "out"
) -> None:
    ORACLES[name] = with_(
        chain(source, key, start, steps), then=f"SELECT {key}, t AS {out} FROM done"
    )


# --- sources and sinks ----------------------------------------------------------

ORACLES["io1_read_reviews"] = with_(
    REVIEWS, then='SELECT review_id, "Score" AS score, md5("Text") AS text_md5 FROM reviews'
)
ORACLES["io2_require_columns"] = with_(
    REVIEWS, then='SELECT review_id, "Score" FROM reviews'
)
ORACLES["io3_project_review"] = with_(
    REVIEWS, then='SELECT "Score" AS score, "Text" AS body FROM reviews'
)
ORACLES["io4_save_load_model"] = (
    "SELECT conv_id, turn, true AS same FROM conversations"
)
ORACLES["io6_register_model"] = """
WITH old AS (
  SELECT source AS name, min(doc_id) AS pos FROM documents GROUP BY source
), new AS (
  SELECT DISTINCT source AS name FROM documents JOIN labels USING (doc_id)
  WHERE toxic = 1
  UNION SELECT DISTINCT 'lang-' || lang FROM documents
), both_ AS (
  SELECT name, o.pos, n.name IS NOT NULL AS is_new
  FROM old o FULL JOIN new n USING (name)
)
SELECT CAST(row_number() OVER (ORDER BY pos NULLS LAST, name) - 1 AS BIGINT) AS position,
  name, CASE WHEN is_new THEN 'models/v2/' ELSE 'models/v1/' END || name AS path,
  CASE WHEN is_new THEN 'transformer' ELSE 'classical' END AS type,
  CASE WHEN is_new THEN '2025-06-01T00:00:00' ELSE '2025-01-01T00:00:00' END
    AS registered_at
FROM both_"""
ORACLES["io6_stored_registry"] = """
SELECT CAST(row_number() OVER (ORDER BY lang) - 1 AS BIGINT) AS position, lang AS name,
  '/srv/models/v2/' || lang AS path, 'classical' AS type
FROM (SELECT DISTINCT lang FROM documents)"""
ORACLES["io7_read_registry"] = """
SELECT doc_id, CAST(0 AS INTEGER) AS position, source AS name,
  '/srv/models/' || lang AS path, 'classical' AS type
FROM documents WHERE lang <> 'fr'
UNION ALL
SELECT doc_id, CAST(1 AS INTEGER), 'second-' || lang, '/abs/' || source, 'transformer'
FROM documents WHERE lang <> 'fr'"""

# --- filters, sampling and checks -----------------------------------------------

ORACLES["f1_drop_null_rows"] = with_(
    REVIEWS,
    then='SELECT review_id, "Score" FROM reviews '
    'WHERE "Score" IS NOT NULL AND "Text" IS NOT NULL',
)
ORACLES["f2_sample_fraction"] = with_(
    REVIEWS,
    """
h AS (
  SELECT review_id, "Score", row_number() OVER (
    ORDER BY md5(CAST(review_id AS VARCHAR) || '|42|sample')) AS place, count(*) OVER () AS n
  FROM reviews WHERE "Score" IS NOT NULL
)""",
    then='SELECT review_id, "Score" FROM h '
    "WHERE place <= round_even(n * CAST(0.1 AS DOUBLE), 0)",
)
ORACLES["f2_sample_approx"] = (
    "SELECT doc_id, lang FROM documents "
    "WHERE substr(md5(CAST(doc_id AS VARCHAR) || '|42|sample'), 1, 8) < '40000000'"
)
ORACLES["f3_drop_neutral"] = with_(
    REVIEWS, then='SELECT review_id, "Score" FROM reviews WHERE "Score" <> 3'
)
GAPPY = """
gappy AS (
  SELECT d.doc_id, CASE WHEN toxic = 1 AND quality = 0 THEN NULL
    WHEN toxic = 1 THEN ' ' || chr(9) || chr(10) || ' ' WHEN quality = 0 THEN ''
    ELSE text END AS text
  FROM documents d LEFT JOIN labels USING (doc_id)
)"""
BLANK = f"NOT regexp_matches(text, {q(rf'[^{WS}]')})"
ORACLES["f4_drop_empty_text"] = with_(
    GAPPY, then=f"SELECT doc_id FROM gappy WHERE text IS NOT NULL AND NOT ({BLANK})"
)
ORACLES["f5_require_min_rows"] = (
    "SELECT doc_id AS review_id, lang FROM documents"
)
ORACLES["f6_stage_counts"] = with_(
    REVIEWS,
    """
f1 AS (SELECT * FROM reviews WHERE "Score" IS NOT NULL AND "Text" IS NOT NULL),
f2 AS (SELECT * FROM f1
       WHERE substr(md5(CAST(review_id AS VARCHAR) || '|42|sample'), 1, 1) < '8'),
f3 AS (SELECT * FROM f2 WHERE "Score" <> 3),
f4 AS (SELECT * FROM f3 WHERE regexp_matches("Text", '[a-zA-Z<>]'))""",
    then="""
SELECT CAST(0 AS INTEGER) AS stage_no, 'load' AS stage, count(*) AS rows FROM reviews
UNION ALL SELECT 1, 'dropna', count(*) FROM f1
UNION ALL SELECT 2, 'sample', count(*) FROM f2
UNION ALL SELECT 3, 'neutral', count(*) FROM f3
UNION ALL SELECT 4, 'clean', count(*) FROM f4""",
)


def reason(text: str, limit: int) -> str:
    return (
        f"CASE WHEN {text} IS NULL OR {text} = '' THEN 'empty' "
        f"WHEN NOT regexp_matches({text}, {q(rf'[^{WS}]')}) THEN 'whitespace_only' "
        f"WHEN length({text}) > {limit} THEN 'too_long' END"
    )


ORACLES["v1_validate_text"] = with_(
    GAPPY, then=f"SELECT doc_id, {reason('text', 5000)} AS reason FROM gappy"
)
ORACLES["v2_validate_batch"] = f"""
WITH v AS (
  SELECT conv_id, CASE WHEN count(*) > 6 THEN 'too_many_items'
    WHEN bool_or({reason('text', 1200)} IS NOT NULL) THEN 'bad_item' END AS reason
  FROM conversations GROUP BY conv_id
)
SELECT c.conv_id, c.turn, v.reason FROM conversations c JOIN v USING (conv_id)"""
ORACLES["v2_validate_batch_array"] = f"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
SELECT doc_id, CASE WHEN len(lines) > 20 THEN 'too_many_items'
  WHEN len(list_filter(lines, lambda x: {reason('x', 800)} IS NOT NULL)) > 0
  THEN 'bad_item' END AS reason
FROM s"""
ORACLES["v3_validate_score"] = with_(
    REVIEWS,
    then="""
SELECT review_id, CASE WHEN coalesce(trunc("Score" * 1.5 - 1) BETWEEN 1 AND 5, false)
  THEN NULL ELSE 'invalid_score' END AS reason FROM reviews""",
)

# --- text -------------------------------------------------------------------------

ORACLES["t1_to_text"] = (
    "SELECT doc_id, CAST(n_chars AS VARCHAR) AS out FROM documents"
)
NOISY = noisy("text")
text_oracle("t2_strip_html", "pages", "page_id", "html", html_steps())
_PLAIN = ORACLES["t2_strip_html"]
ORACLES["t2_references"] = (
    "SELECT page_id, concat(out, 'café ♥ é\U0001F600 &lt; x', out) AS out "
    f"FROM ({_PLAIN})"
)
ORACLES["sql_functions_agree"] = (
    "SELECT page_id, true AS strip_html, true AS clean_minimal, true AS clean_classical, "
    "true AS clean_regex FROM pages"
)
text_oracle("t3_strip_tags_regex", "pages", "page_id", "html", TAGS)
text_oracle(
    "t4_strip_urls", "pages", "page_id", "url || ' ' || html || ' ' || url", URLS
)
text_oracle(
    "t5_normalize_whitespace", "documents", "doc_id",
    "lang || ' ' || chr(9) || ' ' || text || ' ' || chr(9) || ' ' || source", SPACES,
)
text_oracle("t6_demojize", "documents", "doc_id", NOISY, emoji_steps())
text_oracle(
    "t6_demojize_sequences", "documents", "doc_id", "text",
    [
        f"replace(t, {q(' the ')}, {q(' :family: :Sweden: ')})", f"replace(t, {q(' la ')}, {q(' :woman: :keycap_3: ')})",
        f"replace(t, {q(' der ')}, {q(' :thumbs_up_dark_skin_tone: ')})",
    ],
)
text_oracle("t7_expand_contractions", "documents", "doc_id", NOISY, contraction_steps())
text_oracle("t8_lower_text", "documents", "doc_id", "text", LOWER)
text_oracle("t9_replace_numbers", "documents", "doc_id", NOISY, NUMBERS)
text_oracle("t10_remove_non_alpha", "documents", "doc_id", "text", LETTERS)
READY = LOWER + NUMBERS + LETTERS + token_steps()
for _name, _steps in {
    "t11_tokenize": [],
    "t12_mark_negation": NEGATION,
    "t13_remove_stopwords": NEGATION + STOPS,
    "t14_lemmatize": LEMMAS,
    "t15_filter_short": NEGATION + LONG,
}.items():
    text_oracle(_name, "documents", "doc_id", NOISY, READY + _steps + JOIN)
ORACLES["t14_lemmatize_lexicon"] = f"""
WITH words AS (
  SELECT DISTINCT unnest(regexp_extract_all(
    regexp_replace(lower(text), {q(rf'[^a-zA-Z<>{WS}]')}, '', 'g'), '[a-z]+')) AS word
  FROM benchmark
), lexicon AS (
  SELECT word, regexp_replace(word, '(ing|ed|s)$', '') AS lemma FROM words
), {chain("documents", "doc_id", "lower(text)", LETTERS + token_steps())},
tokens AS (
  SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM done
), found AS (
  SELECT doc_id, string_agg(coalesce(lemma, tokens.word), ' ' ORDER BY pos) AS out
  FROM tokens LEFT JOIN lexicon ON tokens.word = lexicon.word GROUP BY doc_id
)
SELECT d.doc_id, coalesce(out, '') AS out FROM done d LEFT JOIN found USING (doc_id)"""
_RULES = ", ".join(
    f"('{c}', '{i:02d}', '{old}', '{new}')"
    for i, (c, old, new) in enumerate((c, *r) for c, rules in lx.DETACHMENTS.items() for r in rules)
)
BY_LENGTH = "substr('nvar', CAST(length({0}) % 4 + 1 AS INTEGER), 1)"
ORACLES["t14_lemmatize_detachment"] = f"""
WITH RECURSIVE bench AS (
  SELECT DISTINCT unnest(regexp_extract_all(
    regexp_replace(lower(text), {q(rf'[^a-zA-Z<>{WS}]')}, '', 'g'), '[a-z]+')) AS word
  FROM benchmark
), rules(word_class, i, old, new) AS (VALUES {_RULES}),
listed AS (
  SELECT word, {BY_LENGTH.format("word")} AS word_class, left(word, 3) AS lemma FROM bench
  WHERE starts_with(word, 'th')
), lemmas AS (
  SELECT lemma, {BY_LENGTH.format("lemma")} AS word_class FROM (
    SELECT word AS lemma FROM bench
    UNION SELECT regexp_replace(word, '(ing|ed|es|s|er|est)$', '') FROM bench)
  UNION SELECT lemma, word_class FROM listed
), {chain("documents", "doc_id", "lower(text)", LETTERS + token_steps())},
tokens AS (
  SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM done
), words AS (
  SELECT w.word, CASE WHEN b.word IS NULL THEN 'n' ELSE {BY_LENGTH.format("w.word")} END AS word_class
  FROM (SELECT DISTINCT word FROM tokens) w LEFT JOIN bench b USING (word)
), tagged AS (
  SELECT w.*, l.lemma AS listed FROM words w LEFT JOIN listed l USING (word, word_class)
), forms AS (
  SELECT word, word_class, 1 AS level, word AS form, '' AS ord, listed IS NULL AS open FROM tagged
  UNION ALL SELECT word, word_class, 1, listed, '0', false FROM tagged WHERE listed IS NOT NULL
  UNION ALL
  SELECT f.word, f.word_class, CASE WHEN f.ord = '' THEN 1 ELSE f.level + 1 END,
    left(f.form, length(f.form) - length(r.old)) || r.new, f.ord || r.i, true
  FROM forms f JOIN rules r ON r.word_class = f.word_class AND ends_with(f.form, r.old)
  WHERE f.open
), best AS (
  SELECT f.word, arg_min(f.form, (f.level, length(f.form), f.ord)) AS lemma
  FROM forms f JOIN lemmas l ON l.lemma = f.form AND l.word_class = f.word_class GROUP BY f.word
), found AS (
  SELECT doc_id, string_agg(coalesce(lemma, tokens.word), ' ' ORDER BY pos) AS out
  FROM tokens LEFT JOIN best ON tokens.word = best.word GROUP BY doc_id
)
SELECT d.doc_id, coalesce(out, '') AS out FROM done d LEFT JOIN found USING (doc_id)"""
text_oracle(
    "t16_join_tokens", "documents", "doc_id", "text", [sub(r"[ \n]", " ")]
)
text_oracle("t17_clean_minimal", "pages", "page_id", "html", MINIMAL)
text_oracle("t18_clean_classical", "documents", "doc_id", NOISY, CLASSICAL)
text_oracle(
    "t18_clean_classical_plain", "documents", "doc_id", "text",
    WORDS + LEMMAS + LONG + JOIN,
)
text_oracle("t19_clean_regex", "pages", "page_id", "html", TAGS + URLS + SPACES)
ORACLES["t20_clean_frame"] = with_(
    chain("conversations", "conv_id, turn", "text", CLASSICAL),
    then="SELECT conv_id, turn, t AS cleaned_text FROM done WHERE trim(t) <> ''",
)
text_oracle(
    "t20_text_cleaner_stage", "benchmark", "item_id", "text", MINIMAL, "cleaned_text"
)

# --- labels -----------------------------------------------------------------------

ORACLES["l1_binary_label"] = with_(
    REVIEWS,
    then='SELECT review_id, CAST(CASE WHEN "Score" > 3 THEN 1 ELSE 0 END AS INTEGER) '
    'AS label FROM reviews WHERE "Score" IS NOT NULL',
)
ORACLES["l2_three_class_label"] = with_(
    REVIEWS, LABELLED3, then="SELECT review_id, label FROM labelled3"
)
ORACLES["l3_label_names"] = with_(
    REVIEWS,
    LABELLED3,
    """
names(label, label_name, num_labels) AS (
  VALUES (0, 'NEGATIVE', 2), (1, 'POSITIVE', 2), (0, 'NEGATIVE', 3), (1, 'NEUTRAL', 3),
    (2, 'POSITIVE', 3), (0, 'LABEL_0', 5), (1, 'LABEL_1', 5), (2, 'LABEL_2', 5),
    (3, 'LABEL_3', 5), (4, 'LABEL_4', 5)
), counts AS (SELECT label, count(*) AS reviews FROM labelled3 GROUP BY label)""",
    then="SELECT label, label_name, num_labels, reviews "
    "FROM names LEFT JOIN counts USING (label)",
)
ORACLES["l4_with_label_name"] = with_(
    REVIEWS,
    LABELLED3,
    then="SELECT review_id, CASE label WHEN 0 THEN 'NEGATIVE' WHEN 1 THEN 'NEUTRAL' "
    "ELSE 'POSITIVE' END AS label_name FROM labelled3",
)
ORACLES["l5_label_id"] = (
    "SELECT doc_id, CASE WHEN lang <> 'fr' THEN CAST(n_chars AS INTEGER) END AS label "
    "FROM documents"
)
ORACLES["l6_label_distribution"] = with_(
    REVIEWS,
    LABELLED3,
    then="SELECT label, count(*) AS n, "
    "round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share "
    "FROM labelled3 GROUP BY label",
)
ORACLES["l7_prepare_reviews"] = with_(
    REVIEWS,
    """
h AS (
  SELECT *, row_number() OVER (
    ORDER BY md5(CAST(review_id AS VARCHAR) || '|42|sample')) AS place, count(*) OVER () AS n
  FROM reviews WHERE "Score" IS NOT NULL AND "Text" IS NOT NULL
), kept AS (
  SELECT * FROM h
  WHERE place <= round_even(n * CAST(0.5 AS DOUBLE), 0) AND "Score" <> 3
)""",
    chain("kept", 'review_id, "Score"', '"Text"', CLASSICAL),
    then='SELECT review_id, "Score", CAST(CASE WHEN "Score" > 3 THEN 1 ELSE 0 END '
    "AS INTEGER) AS label, t AS cleaned_text FROM done WHERE trim(t) <> ''",
)

ORACLES["l7_options"] = with_(
    REVIEWS,
    """
kept AS (
  SELECT * FROM reviews
  WHERE "Score" IS NOT NULL AND "Text" IS NOT NULL AND "Score" <> 3
)""",
    chain("kept", 'review_id, "Score"', '"Text"', WORDS + LEMMAS + LONG + JOIN),
    then='SELECT review_id, "Score", CAST(CASE WHEN "Score" > 3 THEN 1 ELSE 0 END '
    "AS INTEGER) AS label, t AS cleaned_text FROM done WHERE trim(t) <> ''",
)

# --- splits -----------------------------------------------------------------------


def split_ctes(source: str, key: str, label: str, test: str, val: str | None) -> str:
    """Quotas by largest remainder, then ranks in hash order; last is ``parts``."""
    val_total = (
        f"CAST(ceil((n - n_test) * CAST({val} AS DOUBLE)) AS BIGINT)" if val else "0"
    )
    return f"""
sizes AS (
  SELECT {label} AS class, count(*) AS size FROM {source} GROUP BY 1
), totals AS (
  SELECT CAST(sum(size) AS BIGINT) AS n,
    CAST(ceil(sum(size) * CAST({test} AS DOUBLE)) AS BIGINT) AS n_test FROM sizes
), more_totals AS (SELECT n, n_test, {val_total} AS n_val FROM totals
), test_share AS (
  SELECT class, size, n, n_test, n_val, size * n_test // n AS base,
    row_number() OVER (ORDER BY size * n_test % n DESC, class) AS turn
  FROM sizes, more_totals
), test_quota AS (
  SELECT class, size, n, n_test, n_val, base + CASE WHEN turn <=
    n_test - (SELECT sum(base) FROM test_share) THEN 1 ELSE 0 END AS q_test
  FROM test_share
), val_share AS (
  SELECT *, (size - q_test) * n_val // (n - n_test) AS base, row_number() OVER (
    ORDER BY (size - q_test) * n_val % (n - n_test) DESC, class) AS turn
  FROM test_quota
), quotas AS (
  SELECT class, q_test, base + CASE WHEN turn <=
    n_val - (SELECT sum(base) FROM val_share) THEN 1 ELSE 0 END AS q_val
  FROM val_share
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY {label}
    ORDER BY md5(CAST({key} AS VARCHAR) || '|42|split')) AS place FROM {source}
), parts AS (
  SELECT p.* EXCLUDE (place), CASE WHEN place <= q_test THEN 'test'
    WHEN place <= q_test + q_val THEN 'val' ELSE 'train' END AS split
  FROM placed p JOIN quotas q ON q.class = {label}
)"""


SPLIT3 = (REVIEWS, LABELLED, split_ctes("labelled", "review_id", "label", "0.2", "0.1"))
ORACLES["s1_split_train_test"] = with_(
    REVIEWS, LABELLED, split_ctes("labelled", "review_id", "label", "0.2", None),
    then="SELECT review_id, label, split FROM parts",
)
ORACLES["s2_split_unstratified"] = with_(
    "base_rows AS (SELECT doc_id, lang, 0 AS one FROM documents)",
    split_ctes("base_rows", "doc_id", "one", "0.1", None),
    then="SELECT doc_id, lang, split FROM parts",
)
ORACLES["s3_split_train_val_test"] = with_(
    *SPLIT3, then="SELECT review_id, label, split FROM parts"
)
ORACLES["s4_check_split"] = with_(
    *SPLIT3,
    then="""
SELECT split, label, count(*) AS rows,
  CAST(sum(count(*)) OVER (PARTITION BY split) AS BIGINT) AS split_rows,
  round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY split) AS DOUBLE), 6)
    AS class_share,
  (SELECT count(*) FROM (SELECT review_id FROM parts GROUP BY review_id
    HAVING count(DISTINCT split) > 1)) AS shared_keys
FROM parts GROUP BY split, label""",
)

# --- features ---------------------------------------------------------------------

TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
DOC_TERMS = f"""
words AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL)"""
CORPUS = """
corpus AS (
  SELECT term, CAST(sum(tf) AS BIGINT) AS total_tf, count(*) AS doc_freq
  FROM tf GROUP BY term
)"""
VOCAB = """
top AS (SELECT * FROM corpus ORDER BY total_tf DESC, term LIMIT 5000),
vocab AS (
  SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_index,
    total_tf, doc_freq,
    ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + doc_freq AS DOUBLE)) + 1 AS idf
  FROM top
)"""
ITEM_TERMS = f"""
item_words AS (SELECT item_id, unnest({TERMS}) AS term FROM benchmark),
item_tf AS (SELECT item_id, term, count(*) AS tf FROM item_words GROUP BY ALL)"""


def weights(source: str, key: str) -> str:
    return f"""
raw AS (
  SELECT {key}, term, term_index, tf, idf, tf * idf AS w
  FROM {source} JOIN vocab USING (term)
), norms AS (SELECT {key}, sqrt(sum(w * w)) AS norm FROM raw GROUP BY {key})"""


def weighed(key: str) -> str:
    return (
        f"SELECT {key}, term, term_index, tf, round(idf, 6) AS idf, "
        f"round(w / norm, 6) AS tfidf FROM raw JOIN norms USING ({key})"
    )


ORACLES["x1_analyze"] = (
    f"SELECT doc_id, array_to_string({TERMS}, ' ') AS terms FROM documents"
)
ORACLES["x2_ngrams"] = f"""
WITH w AS (SELECT item_id, {TERMS} AS t FROM benchmark)
SELECT item_id, array_to_string(list_concat(t, list_concat(
  list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]),
  list_transform(range(1, greatest(len(t) - 1, 1)),
    lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))), '|') AS terms
FROM w"""
ORACLES["x3_term_freq"] = with_(DOC_TERMS, then="SELECT doc_id, term, tf FROM tf")
ORACLES["x4_doc_freq"] = with_(DOC_TERMS, CORPUS, then="SELECT * FROM corpus")
ORACLES["x5_vocabulary"] = f"""
WITH w AS (SELECT doc_id, {TERMS} AS t FROM documents),
words AS (
  SELECT doc_id, unnest(t) AS term FROM w UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, greatest(len(t), 1)),
    lambda i: t[i] || ' ' || t[i + 1])) FROM w
), corpus AS (
  SELECT term, count(*) AS total_tf, count(DISTINCT doc_id) AS doc_freq
  FROM words GROUP BY term ORDER BY total_tf DESC, term LIMIT 5000
)
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_index,
  total_tf, doc_freq FROM corpus"""


def grams(table: str, key: str, high: int) -> str:
    """Table ``grams``: every run of up to ``high`` terms of each row."""
    return f"""
w AS (SELECT {key}, {TERMS} AS t FROM {table}),
grams AS (
  SELECT {key}, unnest(flatten(list_transform(range(1, {high + 1}), lambda n:
    list_transform(range(1, greatest(len(t) - n + 2, 1)),
      lambda i: array_to_string(t[i:i + n - 1], ' '))))) AS term FROM w
)"""


def most_used(high: int, limit: int) -> str:
    return with_(
        grams("documents", "doc_id", high),
        f"""
corpus AS (
  SELECT term, count(*) AS total_tf, count(DISTINCT doc_id) AS doc_freq
  FROM grams GROUP BY term ORDER BY total_tf DESC, term LIMIT {limit}
)""",
        then="""
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_index,
  total_tf, doc_freq FROM corpus""",
    )


ORACLES["x5_vocabulary_sketch"] = most_used(3, 5000)
ORACLES["x5_vocabulary_large"] = most_used(2, 150_000)
ORACLES["x6_idf"] = with_(
    DOC_TERMS, CORPUS, VOCAB,
    then="SELECT term, term_index, round(idf, 6) AS idf FROM vocab",
)
ORACLES["x7_tfidf"] = with_(
    DOC_TERMS, CORPUS, VOCAB, weights("tf", "doc_id"), then=weighed("doc_id")
)
ORACLES["x8_transform_tfidf"] = with_(
    DOC_TERMS, CORPUS, VOCAB, ITEM_TERMS, weights("item_tf", "item_id"),
    then=weighed("item_id"),
)
ORACLES["x8_transform_vectors"] = with_(
    DOC_TERMS, CORPUS, VOCAB, ITEM_TERMS, weights("item_tf", "item_id"),
    then=f"SELECT item_id, term, term_index, tfidf FROM ({weighed('item_id')})",
)
ORACLES["x2_ngrams_sql"] = with_(
    grams("benchmark", "item_id", 3).replace("unnest(flatten", "(flatten"),
    then="""
SELECT item_id, CAST(generate_subscripts(term, 1) - 1 AS INTEGER) AS place, unnest(term) AS term FROM grams""",
)
ORACLES["x3_term_freq_sql"] = with_(
    grams("documents", "doc_id", 2),
    then="SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL",
)
ORACLES["v1_validate_text_sql"] = with_(
    GAPPY,
    then=f"SELECT * FROM (SELECT doc_id, {reason('text', 5000)} AS reason FROM gappy) WHERE reason IS NOT NULL",
)
ORACLES["x8_vectorize"] = with_(
    grams("documents", "doc_id", 2),
    "tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL)",
    CORPUS, VOCAB,
    grams("benchmark", "item_id", 2).replace("w AS (", "v AS (").replace("FROM w", "FROM v").replace("grams AS", "item_grams AS"),
    "item_tf AS (SELECT item_id, term, count(*) AS tf FROM item_grams GROUP BY ALL)",
    weights("item_tf", "item_id"),
    then=f"SELECT item_id, term_index, tfidf FROM ({weighed('item_id')})",
)
ORACLES["x9_feature_names"] = with_(
    DOC_TERMS, CORPUS, VOCAB, then="SELECT term_index, term FROM vocab"
)

# --- training and scoring ---------------------------------------------------------

ORACLES["m1_balanced_weights"] = with_(
    REVIEWS, LABELLED,
    then="""
SELECT review_id, label, round(CAST((SELECT count(*) FROM labelled) AS DOUBLE)
  / ((SELECT count(DISTINCT label) FROM labelled)
  * count(*) OVER (PARTITION BY label)), 6) AS weight FROM labelled""",
)
TRAINING = with_(
    REVIEWS,
    'kept AS (SELECT * FROM reviews WHERE "Score" IS NOT NULL AND "Score" <> 3)',
    chain("kept", 'review_id, "Score"', '"Text"', CLASSICAL),
    """
cleaned AS (
  SELECT review_id, CAST(CASE WHEN "Score" > 3 THEN 1 ELSE 0 END AS INTEGER) AS label,
    t FROM done WHERE trim(t) <> ''
)""",
    then="",
)
ORACLES["m2_optimality"] = f"""{TRAINING.rstrip()}, words AS (
  SELECT unnest(regexp_extract_all(lower(t), '[a-z_]{{2,}}')) AS term FROM cleaned
), top AS (
  SELECT term FROM words GROUP BY term ORDER BY count(*) DESC, term LIMIT 5000
)
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_index,
  true AS at_optimum FROM top"""
ORACLES["m2_newton_optimality"] = ORACLES["m2_optimality"].replace("LIMIT 5000", "LIMIT 300")
ORACLES["m4_long_form_check"] = with_(
    chain("documents", "doc_id", "text", CLASSICAL),
    then="SELECT doc_id, true AS same_class FROM done WHERE trim(t) <> ''",
)
ORACLES["m5_probability_check"] = with_(
    chain("documents", "doc_id", "text", CLASSICAL),
    then="SELECT doc_id, CAST(3 AS INTEGER) AS classes, CAST(1 AS DOUBLE) AS total, "
    "true AS predicts_highest FROM done WHERE trim(t) <> ''",
)
TRAINED = TRAINING.rstrip() + "," + split_ctes("cleaned", "review_id", "label", "0.2", None)
ORACLES["m6_train_split"] = TRAINED + "\nSELECT review_id, label, split FROM parts"
ORACLES["m3_optimality"] = """
WITH c AS (SELECT CAST(unnest(range(max(label) + 1)) AS INTEGER) AS class FROM embeddings),
d AS (SELECT CAST(unnest(range(max(len(embedding)))) AS INTEGER) AS dim FROM embeddings)
SELECT class, dim, true AS at_optimum FROM c, d"""
ORACLES["p1_class_check"] = (
    "SELECT concat(conv_id, '-', turn) AS turn_key, true AS same_class FROM conversations"
)
HELD = "SELECT review_id, label FROM parts WHERE split = 'test'"
ORACLES["e8_evaluated_rows"] = (
    TRAINED + f"\nSELECT label, count(*) AS support FROM ({HELD}) GROUP BY label"
)
ORACLES["e8_metrics_check"] = (
    "SELECT metric, true AS same FROM (VALUES ('accuracy'), ('f1_macro')) t(metric)"
)
ORACLES["e11_rows"] = TRAINED + f"\nSELECT *, false AS in_training FROM ({HELD})"
ORACLES["p2_label_check"] = (
    "SELECT conv_id, turn, text, true AS named, true AS in_range FROM conversations"
)
ORACLES["p3_order_check"] = (
    "SELECT conv_id, turn, 'NEGATIVE,NEUTRAL,POSITIVE' AS labels, true AS descending "
    "FROM conversations"
)
ORACLES["p5_accepted"] = f"""
WITH v AS (
  SELECT conv_id FROM conversations GROUP BY conv_id
  HAVING count(*) <= 100 AND NOT bool_or({reason("text", 1200)} IS NOT NULL)
)
SELECT conv_id, turn, true AS named FROM conversations JOIN v USING (conv_id)"""
ORACLES["p5_request_arrays"] = f"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
good AS (
  SELECT * FROM s WHERE len(lines) <= 100
    AND len(list_filter(lines, lambda x: {reason('x', 5000)} IS NOT NULL)) = 0
)
SELECT doc_id, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS item,
  unnest(lines) AS text, true AS named FROM good"""
ORACLES["p6_stream_accepted"] = (
    f"SELECT doc_id, true AS named FROM documents WHERE {reason('text', 5000)} IS NULL"
)
ORACLES["p4_score_external"] = """
WITH x AS (
  SELECT conv_id, turn, length(text) % 5 - 2.0::DOUBLE AS a,
    length(text) % 7 - 3.0::DOUBLE AS b, length(text) % 11 - 5.0::DOUBLE AS c
  FROM conversations
), m AS (
  SELECT *, CAST(CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END
    AS INTEGER) AS prediction FROM x
)
SELECT conv_id, turn, prediction,
  CASE prediction WHEN 0 THEN 'NEGATIVE' WHEN 1 THEN 'NEUTRAL' ELSE 'POSITIVE' END AS label,
  round(exp(greatest(a, b, c)) / (exp(a) + exp(b) + exp(c)), 6) AS score
FROM m"""
ORACLES["p5_request_report"] = """
WITH v AS (
  SELECT conv_id, count(*) AS items, CASE WHEN count(*) > 100 THEN 'too_many_items'
    WHEN bool_or(length(text) % 50 = 0 OR text IS NULL OR length(text) > 5000
      OR trim(text) = '') THEN 'bad_item' END AS reason
  FROM conversations GROUP BY conv_id
)
SELECT conv_id, CASE WHEN reason IS NULL THEN items ELSE 0 END AS total_processed,
  CASE WHEN reason IS NULL THEN 0 ELSE items END AS total_rejected, reason FROM v"""
ORACLES["p6_stream_rejects"] = (
    f"SELECT doc_id, {reason('text', 5000)} AS reason FROM documents "
    f"WHERE {reason('text', 5000)} IS NOT NULL"
)

ORACLES["p6_stream_batches"] = f"""
WITH size AS (SELECT max(conv_id) + 1 AS n FROM conversations),
t AS (
  SELECT *, conv_id * 60 + turn * 5 AS ts, conv_id % 5 = 2 AND turn = 1 AS held FROM conversations
), mark AS (
  SELECT max(ts) FILTER (NOT held) - (max(n) // 4 + 5) * 60 AS early,
    max(ts) - (max(n) // 4 + 5) * 60 AS last FROM t, size
), rows AS (SELECT *, held AND ts < early AS late FROM t, mark),
v AS (
  SELECT conv_id, CASE WHEN max(ts) + 120 > max(last) THEN 'open'
    WHEN count(*) > 6 THEN 'too_many_items'
    WHEN bool_or({reason('text', 1200)} IS NOT NULL) THEN 'bad_item' ELSE 'scored' END AS status
  FROM rows WHERE NOT late GROUP BY conv_id
)
SELECT conv_id, turn, CASE WHEN late THEN 'late' ELSE status END AS status
FROM rows LEFT JOIN v USING (conv_id)"""

# --- evaluation -------------------------------------------------------------------

PRED_ROWS = """
pred AS (
  SELECT doc_id, 'not_toxic' AS model, quality AS y, 1 - toxic AS p FROM labels
  UNION ALL SELECT doc_id, 'always_good', quality, 1 FROM labels
  UNION ALL SELECT doc_id, 'by_id', quality, CAST(doc_id % 3 AS INTEGER) FROM labels
)"""
METRICS = """seen AS (
  SELECT model, y AS label FROM pred UNION SELECT model, p FROM pred
), counts AS (
  SELECT s.model, s.label,
    count(*) FILTER (WHERE y = s.label AND p = s.label) AS tp,
    count(*) FILTER (WHERE p = s.label) AS predicted,
    count(*) FILTER (WHERE y = s.label) AS support
  FROM seen s JOIN pred USING (model) GROUP BY s.model, s.label
), classes AS (
  SELECT model, label, tp, support,
    CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / predicted END AS pr,
    CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS rc,
    CASE WHEN predicted + support = 0 THEN 0.0
      ELSE CAST(2 * tp AS DOUBLE) / (predicted + support) END AS f
  FROM counts
), scores AS (
  SELECT model, CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy,
    avg(f) AS f1_macro, sum(f * support) / sum(support) AS f1_weighted,
    avg(pr) AS precision_macro, avg(rc) AS recall_macro,
    sum(pr * support) / sum(support) AS precision_weighted,
    sum(rc * support) / sum(support) AS recall_weighted,
    CAST(sum(support) AS BIGINT) AS support
  FROM classes GROUP BY model
)"""
PRED = f"{PRED_ROWS},\n{METRICS}"
GRID = """
SELECT a.model, a.label AS true_label, b.label AS pred_label,
  (SELECT count(*) FROM pred p
   WHERE p.model = a.model AND p.y = a.label AND p.p = b.label) AS n
FROM seen a JOIN seen b USING (model)"""
ORACLES["e1_confusion_matrix"] = with_(PRED, then=GRID)
ORACLES["e2_accuracy"] = with_(
    PRED, then="SELECT model, round(accuracy, 6) AS accuracy FROM scores"
)
ORACLES["e3_precision_recall_f1"] = with_(
    PRED,
    then="SELECT model, label, support, round(pr, 6) AS precision, "
    "round(rc, 6) AS recall, round(f, 6) AS f1 FROM classes",
)
ORACLES["e4_macro_average"] = with_(
    PRED,
    then="SELECT model, round(precision_macro, 6) AS precision_macro, "
    "round(recall_macro, 6) AS recall_macro, round(f1_macro, 6) AS f1_macro FROM scores",
)
ORACLES["e5_weighted_average"] = with_(
    PRED,
    then="SELECT model, round(precision_weighted, 6) AS precision_weighted, "
    "round(recall_weighted, 6) AS recall_weighted, "
    "round(f1_weighted, 6) AS f1_weighted FROM scores",
)
ORACLES["e6_classification_report"] = with_(
    PRED,
    then="""
SELECT model, label AS row_no, CASE label WHEN 0 THEN 'NEGATIVE' WHEN 1 THEN 'NEUTRAL'
  ELSE 'POSITIVE' END AS class, round(pr, 6) AS precision, round(rc, 6) AS recall,
  round(f, 6) AS f1, support FROM classes
UNION ALL SELECT model, 1000000, 'accuracy', NULL, NULL, round(accuracy, 6), support
  FROM scores
UNION ALL SELECT model, 1000001, 'macro avg', round(precision_macro, 6),
  round(recall_macro, 6), round(f1_macro, 6), support FROM scores
UNION ALL SELECT model, 1000002, 'weighted avg', round(precision_weighted, 6),
  round(recall_weighted, 6), round(f1_weighted, 6), support FROM scores""",
)
FIVE = ("accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro")
ORACLES["e7_evaluate_classification"] = with_(
    PRED,
    then="\nUNION ALL ".join(
        f"SELECT model, '{m}' AS metric, round({m}, 6) AS value FROM scores" for m in FIVE
    ),
)
ORACLES["e9_compare_models"] = with_(
    PRED,
    then="SELECT model, " + ", ".join(f"round({m}, 4) AS {m}" for m in FIVE)
    + " FROM scores",
)
ORACLES["e11_external_metrics"] = TRAINED + f""", pred AS (
  SELECT review_id, 'not toxic' AS model, h.label AS y, CAST(1 - toxic AS INTEGER) AS p
  FROM ({HELD}) h JOIN labels l ON l.doc_id = h.review_id
), {METRICS}
SELECT model, {", ".join(f"round({m}, 4) AS {m}" for m in FIVE)} FROM scores"""
ORACLES["e9_match_counts"] = """
WITH truth AS (SELECT doc_id, CASE WHEN toxic = 0 THEN quality END AS q FROM labels),
p AS (SELECT 'a' AS model, doc_id FROM documents
  UNION ALL SELECT 'b', doc_id FROM documents WHERE doc_id % 3 = 0),
k AS (SELECT doc_id, count(*) AS times, any_value(q) AS q FROM truth GROUP BY doc_id)
SELECT model, count(*) AS rows,
  count(*) FILTER (times IS NOT NULL AND q IS NOT NULL) AS matched,
  count(*) FILTER (times IS NULL) AS unmatched,
  count(*) FILTER (times IS NOT NULL AND q IS NULL) AS unlabelled,
  count(*) FILTER (times > 1) AS repeated
FROM p LEFT JOIN k USING (doc_id) GROUP BY model"""
ORACLES["e10_stored_num_labels"] = "SELECT CAST(3 AS BIGINT) AS num_labels"
ORACLES["e10_infer_num_labels"] = with_(
    REVIEWS, LABELLED3,
    then="SELECT count(DISTINCT label) AS num_labels FROM labelled3",
)
ORACLES["io5_write_metrics"] = with_(
    PRED,
    f"""
grid AS ({GRID}),
rows_ AS (
  SELECT model, true_label, string_agg(CAST(n AS VARCHAR), ',' ORDER BY pred_label) AS r
  FROM grid GROUP BY model, true_label
), matrix AS (
  SELECT model, string_agg(r, ';' ORDER BY true_label) AS confusion
  FROM rows_ GROUP BY model
)""",
    then="""
SELECT s.model, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro,
  round(precision_macro, 6) AS macro_precision, round(c.rc, 6) AS recall_1, confusion
FROM scores s JOIN matrix USING (model) JOIN classes c ON c.model = s.model AND c.label = 1""",
)

# --- profiles ---------------------------------------------------------------------


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


ORACLES["q1_null_counts"] = with_(
    REVIEWS,
    then=union(
        [
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE \"{c}\" IS NULL) AS nulls "
            "FROM reviews"
            for c in ("review_id", "Text", "lang", "source", "Score")
        ]
    ),
)
EVENT_COLUMNS = (
    ("event_id", "bigint", "numeric"), ("ts", "timestamp_ntz", "date"),
    ("user_id", "bigint", "numeric"), ("event_type", "string", "categorical"),
    ("value", "double", "numeric"), ("props", "string", "categorical"),
)
ORACLES["q2_column_info"] = union(
    [
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, "
        f"'{t}' AS data_type, '{k}' AS kind, count({c}) AS non_null FROM events"
        for i, (c, t, k) in enumerate(EVENT_COLUMNS)
    ]
)


def number_line(source: str, c: str) -> str:
    x = f'CAST("{c}" AS DOUBLE)'
    quart = ", ".join(
        f"round(quantile_cont({x}, {p / 100}), 6) AS p{p}" for p in (25, 50, 75)
    )
    return (
        f"SELECT '{c}' AS column_name, 'numeric' AS kind, count(\"{c}\") AS count, "
        "CAST(NULL AS BIGINT) AS unique, CAST(NULL AS VARCHAR) AS top, "
        f"CAST(NULL AS BIGINT) AS freq, round(avg({x}), 6) AS mean, "
        f"round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, {quart}, "
        f"round(max({x}), 6) AS max FROM {source}"
    )


def text_line(source: str, c: str, kind: str, show: Callable[[str], str]) -> str:
    x = f'CAST("{c}" AS VARCHAR)'
    none = ", ".join(
        f"CAST(NULL AS DOUBLE) AS {m}"
        for m in ("mean", "std", "min", "p25", "p50", "p75", "max")
    )
    best = (
        f"(SELECT {{}} FROM (SELECT {x} AS v, count(*) AS n FROM {source} "
        f'WHERE "{c}" IS NOT NULL GROUP BY 1) ORDER BY n DESC, md5(v) LIMIT 1)'
    )
    return (
        f"SELECT '{c}' AS column_name, '{kind}' AS kind, count(\"{c}\") AS count, "
        f'count(DISTINCT "{c}") AS unique, {best.format(show("v"))} AS top, '
        f"{best.format('n')} AS freq, {none} FROM {source}"
    )


ORACLES["q3_describe_all"] = union(
    [
        number_line("events", c) if k == "numeric"
        else text_line("events", c, k, lambda v: v)
        for c, _, k in EVENT_COLUMNS
    ]
)
ORACLES["q3_describe_reviews"] = with_(
    REVIEWS,
    then=union(
        [number_line("reviews", c) for c in ("review_id", "Score")]
        + [
            text_line("reviews", c, "categorical", lambda v: f"md5({v})")
            for c in ("Text", "lang", "source")
        ]
    ),
)
ORACLES["q4_shape"] = (
    "SELECT count(*) AS n_rows, CAST(5 AS INTEGER) AS n_columns FROM documents"
)
ORACLES["q5_head_records"] = (
    "SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || "
    "'\",\"source\":\"' || source || '\",\"n_chars\":' || n_chars || '}' AS record "
    "FROM documents ORDER BY doc_id LIMIT 3"
)
ORACLES["q6_score_distribution"] = with_(
    REVIEWS, then='SELECT "Score" AS score, count(*) AS n FROM reviews GROUP BY 1'
)
ORACLES["q7_split_profile"] = with_(
    *SPLIT3,
    then="SELECT split, label, count(*) AS n FROM parts GROUP BY ROLLUP (split, label)",
)
ORACLES["a1_cleaned_label_profile"] = with_(
    REVIEWS,
    "kept AS (SELECT * FROM reviews WHERE \"Score\" IS NOT NULL AND \"Score\" <> 3)",
    chain("kept", 'review_id, "Score"', '"Text"', CLASSICAL),
    then='SELECT CAST(CASE WHEN "Score" > 3 THEN 1 ELSE 0 END AS INTEGER) AS label, '
    "count(*) AS n, CAST(sum(len(string_split(t, ' '))) AS BIGINT) AS tokens, "
    "CAST(sum(length(t)) AS BIGINT) AS chars FROM done WHERE trim(t) <> '' GROUP BY 1",
)
