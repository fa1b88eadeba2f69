import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonelake.llm import maxscore
from tonelake.llm.maxscore import Postings, top_k

SCHEMA = "vec_id long, embedding array<double>, row string, key int, score double"


def brute(rows, asks, k=5):
    kept = [
        (key, [math.floor(256 * x) for x in v])
        for key, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, (key, query) in enumerate(kept):
        if key is None or not asks(key):
            continue
        hits = sorted(
            (-sum(a * b for a, b in zip(query, v, strict=False)), other is None, other or 0)
            for j, (other, v) in enumerate(kept)
            if j != i
        )
        out += [
            (key, rank, None if none else other, -score)
            for rank, (score, none, other) in enumerate(hits[:k], 1)
        ]
    return sorted(out, key=str)


def run(spark, rows, divisor=50, **options):
    df = spark.createDataFrame([(k, v, "r", 1, 0.5) for k, v in rows], SCHEMA).repartition(3)
    got = top_k(df, F.col("vec_id") % divisor == 0, **options).collect()
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got), key=str)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 60), st.integers(1, 12), st.floats(0, 0.95))
def test_search_finds_all_that_reach_the_bound(seed, n, terms, gaps):
    rng = np.random.default_rng(seed)
    table = rng.integers(-9, 10, (n, terms)) * (rng.random((n, terms)) >= gaps)
    query = rng.integers(-9, 10, terms)
    scores = table @ query
    asked = [(t, int(w)) for t, w in enumerate(query) if w]
    for bound in (-np.inf, 0, 1, int(scores.max()), int(np.median(scores)), int(scores.max()) + 1):
        found, got = Postings(list(table)).search(asked, bound)
        assert found.tolist() == np.flatnonzero(scores >= bound).tolist()
        assert got.tolist() == scores[found].tolist()


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "PIECE", 40)
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(0, 0.2, 16).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(300)]  # a group of copies
    want = brute(rows, lambda i: i % 50 == 0)
    assert run(spark, rows, shard_rows=60) == want
    assert run(spark, rows) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, -0.25, 1.0]), (0, [0.5, -0.25, 1.0]), (50, [0.0, 0.0, 0.0]), (100, []),
        (None, [0.5, 0.5, 0.5]), (None, [0.5, 0.5, 0.5]), (150, None), (200, [nan, 1.0, 1.0]), (250, [None, 1.0, 1.0]),
        (300, [inf, 0.0, 0.0]), (3, [0.5, -0.25]), (4, [0.5, -0.25, 1.0, 9.0]), (-50, [-0.001, -0.5, -1.0]),
    ]
    assert run(spark, rows) == brute(rows, lambda i: i % 50 == 0)
    assert run(spark, rows[:1]) == []
    assert run(spark, []) == []


def test_large_components_are_exact(spark):
    rows = [(0, [3e6, 1.0]), (1, [3e6, 7.0]), (2, [3e6, 7.004]), (3, [-1e30, 0.0])]
    got = run(spark, rows)
    want = brute(rows[:3], lambda i: i == 0)
    assert got[:2] == want and got[2] == (0, 3, 3, -(2**63))


@pytest.mark.parametrize("shard_rows", [100, 8192])
def test_many_rows_may_ask_with_one_vector(spark, shard_rows):
    rows = [(50 * i, [0.3, 0.4]) for i in range(150)] + [(1 + 7 * i, [i / 100, 0.1]) for i in range(90)]
    assert run(spark, rows, shard_rows=shard_rows) == brute(rows, lambda i: i % 50 == 0)
