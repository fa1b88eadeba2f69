"""One query per operator, over the whole of its table, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .conversations import conversation_report, damage_turns
from .decontam import find_contamination
from .jaccard import near_copies
from .langid import detect_language, held_out, train_language_model
from .licences import licence_sql, scan_licences
from .linededup import drop_boilerplate
from .maxscore import top_k
from .packing import pack_documents
from .secretscan import find_secrets
from .sharding import shard_by_bytes
from .spelling import spelling_variants, word_counts
from .tokenfile import token_file_round_trip
from .tokens import public_path
from .vectors import near_vectors


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_path())


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_file_round_trip(spark, docs, public_path(), with_ids=False)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = drop_boilerplate(table(spark, sf_dir, "documents"))
    return docs.select(
        "doc_id",
        F.col("lines_removed").cast("long").alias("lines_removed"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


OP3_SQL = """
WITH lines AS (
    SELECT DISTINCT doc_id, text, source, trim(rtrim(unnest(string_split(text, chr(10))), chr(13)), ' ') AS line
    FROM documents
), spread AS (
    SELECT line, min(doc_id) AS keeper FROM lines
    WHERE regexp_matches(line, '[^ \\t\\n\\v\\f\\r]')
    GROUP BY line HAVING count(DISTINCT source) >= 10
), split AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
        generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM documents
), marked AS (
    SELECT s.doc_id, s.raw, s.pos, p.line IS NOT NULL AND p.keeper <> s.doc_id AS gone
    FROM split s LEFT JOIN spread p ON p.line = trim(rtrim(s.raw, chr(13)), ' ')
)
SELECT doc_id, count(*) FILTER (gone) AS lines_removed,
    md5(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_md5
FROM marked GROUP BY doc_id
"""


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"))
    return found.withColumn("dice", F.round("dice", 6))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = detect_language(docs, train_language_model(docs))
    return found.withColumn("held_out", held_out())


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumn("rank", F.col("rank").cast("int"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations")
    return conversation_report(convs, damage_turns(convs))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(table(spark, sf_dir, "documents"), damage_every=97)
    return spelling_variants(words)


# Floors as the operator takes them; every row asks or answers on its own, copies too.
OP11_SQL = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
    FROM embeddings WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS other,
        CAST(coalesce(list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i])), 0) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other) AS rank FROM scores
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


# Words as the operator takes them, and every run of as many as some item's window has.
_WORDS_SQL = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_WORDS_SQL}, []) AS w FROM documents),
sets AS (
    SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)),
        lambda p: array_to_string(list_slice(w, p, p + least(5, len(w)) - 1), ' '))) AS s
    FROM d WHERE len(w) > 0
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT r.a AS doc_id, min(r.b) AS class_id, any_value(coalesce(k.n, 0)) AS n_links
FROM reach r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = r.a
GROUP BY r.a
"""
OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS_SQL}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n,
        array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS gram
    FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)
), places AS (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), found AS (
    SELECT p.r, p.p, p.n, x.item_id FROM places p
    JOIN windows x ON x.n = p.n AND x.gram = array_to_string(list_slice(p.w, p.p, p.p + p.n - 1), ' ')
), hit AS (
    SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM found) GROUP BY r
), items AS (
    SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
    FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, '') AS i FROM found) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

QUERIES = {
    "op1_packing": op1_packing,
    "op2_token_files": op2_token_files,
    "op3_line_dedup": op3_line_dedup,
    "op4_secrets": op4_secrets,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_licences": op6_licences,
    "op7_language": op7_language,
    "op8_sharding": op8_sharding,
    "op9_decontamination": op9_decontamination,
    "op10_vectors": op10_vectors,
    "op11_top_k": op11_top_k,
    "op12_conversations": op12_conversations,
    "op13_spelling": op13_spelling,
}
ORACLES = {
    "op3_line_dedup": OP3_SQL,
    "op5_jaccard_join": OP5_SQL,
    "op6_licences": licence_sql(),
    "op9_decontamination": OP9_SQL,
    "op11_top_k": OP11_SQL,
}
