import duckdb
import pytest

import __spark_entry__ as entry
import check
import corpus_pipeline
from tonelake.llm.packing import WINDOW
from tonelake.session import materialize

from .test_decontam import brute as spans
from .test_jaccard import shingles
from .test_linededup import brute as lines

SQL = ["op3_line_dedup", "op5_jaccard_join", "op6_licences", "op9_decontamination"]


def test_names():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS FROM '{sf}/{table}.parquet'")
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    res = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in res.fetchall()]
    assert check.compare(got, want) is None


def test_every_stage_against_its_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language id", "line dedup", "n-gram jaccard join", "benchmark decontamination", "packing"
    ]
    stages = dict(corpus_pipeline.STAGES)

    def apply(name):
        nonlocal docs
        docs = materialize(stages[name](spark, docs, sf), "test-stage")
        return docs.collect()

    kept = apply("language id")
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(kept) >= 0.98 * len(before)

    got = apply("line dedup")
    want = lines([(r["doc_id"], r["text"], r["source"]) for r in kept], 10, 1)
    want = {d: t for d, t, n in want if not n or t.strip()}
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)

    one = apply("n-gram jaccard join")
    sets = {r["doc_id"]: shingles(r["text"]) for r in got}
    alike = lambda a, b: a and 5 * len(a & b) >= 4 * len(a | b)
    ids = [r["doc_id"] for r in one]
    assert not any(alike(sets[a], sets[b]) for a in ids for b in ids if a < b)
    for gone in sets.keys() - set(ids):
        assert any(alike(sets[gone], sets[b]) for b in sets if b < gone)

    clean = apply("benchmark decontamination")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in one if not spans(r["text"], items)[1]}

    pieces = apply("packing")
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in clean}
    assert max(r["offset"] + r["length"] for r in pieces) <= WINDOW


def test_pipeline_without_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "test-stage")
    assert docs.count() == 0
