"""Removal of lines that many sites share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import hot_join

MIN_SITES = 10
MIN_WORDS = 1
# Dropped lines of a document are looked up in so many parts
PARTS = 256
# Sketches of 2**LG_K registers; their error is 1.04 / sqrt(2**LG_K) in parts of 1.
LG_K = 10
BAND = 4 * 1.04 / 2 ** (LG_K / 2)


def boilerplate_lines(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    min_words: int = MIN_WORDS,
    site_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Lines that occur on ``min_sites`` sites or more, and the document that keeps each.

    Columns ``line_a, line_b`` (the line's hash in 128 bits), ``sites`` (exact near
    the threshold, else the sketch's estimate) and ``keeper`` (the smallest
    document holding the line, as hash of id and text). A line is what lies
    between line feeds, trimmed of spaces; it counts if it is not blank and has ``min_words``
    words or more, parted by white space: with 1, every line that says something,
    in any script. A null site is no site.

    One HyperLogLog sketch a line is built in each task and merged by the
    aggregation. Where the estimate lies within ``BAND`` of the threshold,
    distinct sites are counted exactly, on those lines alone.
    """
    lines = _lines(docs, site_col, id_col, text_col).filter(
        F.col("line").rlike(r"\S") & (F.size(F.split("line", r"\s+")) >= min_words)
    )
    hashed = lines.select(*_hash("line"), "site", "doc")
    spread = materialize(
        hashed.groupBy("line_a", "line_b")
        .agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"),
            F.min("doc").alias("doc"),
            (F.count(F.lit(1)) >= min_sites).alias("often"),
        )
        .filter(F.col("often") & (F.col("sites") >= min_sites * (1 - BAND)))
        .select("line_a", "line_b", "sites", F.col("doc.key").alias("keeper")),
        "line-spread",
    )
    near = spread.filter(F.col("sites") < min_sites * (1 + BAND)).select("line_a", "line_b")
    seen = hot_join(
        hashed.select("line_a", "line_b", "site", F.col("doc.key").alias("doc")),
        near,
        ["line_a", "line_b"],
        ["doc"],
    )
    exact = seen.groupBy("line_a", "line_b").agg(F.count_distinct("site").alias("exact"))
    return (
        spread.join(exact, ["line_a", "line_b"], "left")
        .withColumn("sites", F.coalesce("exact", "sites"))
        .filter(F.col("sites") >= min_sites)
        .drop("exact")
    )


def _trimmed(line: Column) -> Column:
    return F.trim(F.rtrim(line, F.lit("\r")))


def _hash(line: str) -> list[Column]:
    return [
        F.xxhash64(line).alias("line_a"),
        F.xxhash64(F.lit("b"), line).alias("line_b"),
    ]


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).isNull(), id_col, text_col)


def _lines(docs: DataFrame, site_col: str, id_col: str, text_col: str) -> DataFrame:
    """Distinct lines of each document: a copy within a document adds nothing."""
    order = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), _key(id_col, text_col).alias("key"))
    lines = F.array_distinct(F.transform(F.split(text_col, "\n"), _trimmed))
    return docs.select(
        F.col(site_col).cast("string").alias("site"), order.alias("doc"), F.explode(lines).alias("line")
    )


def drop_boilerplate(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    min_words: int = MIN_WORDS,
    site_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents without the lines that ``min_sites`` sites or more share.

    Each such line stays in one document, the one with the smallest id (null ids
    last, then by hash of id and text), however often it occurs there. All
    columns of ``docs`` come back; ``text`` loses the lines, and ``lines_removed``
    (which replaces a column of that name) counts them. Nothing else of a text
    changes. Null texts stay null, with 0 removed; rows alike in id and text
    count as one document and are treated alike. An empty table stays empty.

    Only hashes of lines are shuffled for the decision. Each document then gets
    the hashes it must drop by a join on its own key, so no line, however common,
    meets in one task. A text's lines are looked up in ``PARTS`` parts of its hashes, so a long text with
    many lines to drop takes no square of them.
    """
    spread = boilerplate_lines(docs, min_sites, min_words, site_col, id_col, text_col)
    spread = materialize(spread, "boilerplate")
    rows = _lines(docs, site_col, id_col, text_col).select(
        F.col("doc.key").alias("doc"), *_hash("line")
    )
    hits = hot_join(
        rows, spread.select("line_a", "line_b", "keeper"), ["line_a", "line_b"], ["doc"]
    )
    part = lambda a: F.pmod(a, F.lit(PARTS)).cast("int")
    drops = (
        hits.filter(F.col("doc") != F.col("keeper"))
        .groupBy("doc", part(F.col("line_a")).alias("part"))
        .agg(F.collect_set(F.struct("line_a", "line_b")).alias("lines"))
        .groupBy(F.col("doc").alias("__doc"))
        .agg(F.map_from_entries(F.collect_list(F.struct("part", "lines"))).alias("__drop"))
    )
    lines = F.split(text_col, "\n")

    def stays(line: Column) -> Column:
        a, b = _hash_of(_trimmed(line))
        own = F.struct(a.alias("line_a"), b.alias("line_b"))
        return ~F.coalesce(F.array_contains(F.try_element_at("__drop", part(a)), own), F.lit(False))

    kept = F.filter(lines, stays)
    marked = docs.withColumn("__doc", _key(id_col, text_col)).join(drops, "__doc", "left")
    hit = F.col("__drop").isNotNull()
    names = [c for c in docs.columns if c != "lines_removed"]
    return marked.select(
        *[
            F.when(hit, F.array_join(kept, "\n")).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c)
            for c in names
        ],
        F.when(hit, F.size(lines) - F.size(kept)).otherwise(F.lit(0)).alias("lines_removed"),
    )


def _hash_of(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit("b"), line)
