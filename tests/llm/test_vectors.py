import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonelake.llm import vectors
from tonelake.llm.graph import components
from tonelake.llm.vectors import near_vectors


def brute(rows):
    good = [(k, np.array(v, float)) for k, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    scaled = [v / np.abs(v).max() for _, v in good]
    unit = [v / np.linalg.norm(v) for v in scaled]
    n = len(good)
    links = [[j for j in range(n) if i != j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95] for i in range(n)]
    best = [k for k, _ in good]
    while True:
        new = [min([best[i], *(best[j] for j in links[i])]) for i in range(n)]
        if new == best:
            break
        best = new
    out = {k: (0, k, True) for k, _ in rows}
    out |= {k: (len(links[i]), best[i], best[i] == k) for i, (k, _) in enumerate(good)}
    return out


@pytest.mark.parametrize("long_list", [32, 8])
def test_against_brute_force(spark, monkeypatch, long_list):
    monkeypatch.setattr(vectors, "LONG_LIST", long_list)
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(long_list)
    base = rng.standard_normal((300, 32))
    near = np.repeat(base[:40], 4, 0) + 0.2 * rng.standard_normal((160, 32))
    crowd = base[41] + 0.12 * rng.standard_normal((150, 32))
    values = np.concatenate([base, near, crowd, base[50:60] * 3, np.repeat(base[70:71], 30, 0)])
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    rows += [(9000, None), (9001, [0.0] * 32), (9002, [1.0, None]), (9003, [float("nan")] * 32), (9004, [float("inf"), 1.0]), (9005, []), (9006, [1e-300, 0.0]), (9007, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()}
    assert got == brute(rows)


def test_links_between_crowds_that_fill_their_lists(spark):
    rng = np.random.default_rng(4)
    u, v, w = np.linalg.qr(rng.standard_normal((32, 3)))[0].T
    turn = np.arccos(0.96)
    far = np.arccos(0.9)
    centres = [u, np.cos(turn) * u + np.sin(turn) * v, w, np.cos(far) * w + np.sin(far) * v]
    values = np.concatenate([c + 0.002 * rng.standard_normal((40, 32)) for c in centres])
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([values, values[:3], values[40:41] * 2]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()}
    want = brute(rows)
    assert want[0][:2] == (82 + 1, 0) and want[60][1] == 0 and want[100][1] == 80 and want[130][1] == 120
    assert got == want


def test_audit_weighs_nodes_alike(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((61, 32))
    values = np.concatenate([base, base[:60] + 0.01 * rng.standard_normal((60, 32)), base[60] + 0.01 * rng.standard_normal((600, 32))])
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    nodes = vectors.vector_nodes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).withColumn("copies", F.lit(1).cast("long")).cache()
    links = [(r["node"], 600) for r in nodes.collect() if r["vec_id"] == 60 or r["vec_id"] > 120]
    # every isolated pair is lost; the crowd has all its links
    share, n = vectors.audit_links(nodes, spark.createDataFrame(links, "node long, links long"))
    assert n == 721 and abs(share - 601 / 721) < 1e-9


def test_last_search_is_audited(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((20, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base + 0.01 * rng.standard_normal((20, 16))]))]
    monkeypatch.setattr(vectors, "_top", lambda x, nodes, *_: pa.RecordBatch.from_pydict(
        {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())}
    ))
    with pytest.raises(RuntimeError, match="recall"):
        near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), max_tries=1)


def test_tables_for_a_lone_pair():
    for n in (1000, 10**6, 10**7, 3 * 10**7):
        bits, tables = vectors._bits(n), vectors._tables_for(n)
        assert 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables >= 0.99


def test_crowded_nodes_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    values = 1 + 0.1 * np.random.default_rng(7).standard_normal((100, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
    nodes = vectors.vector_nodes(table).cache()
    hub = nodes.filter("vec_id = 0").first()["node"]
    near = F.array(F.struct(F.lit(0.9).alias("cosine"), F.lit(hub).alias("b")))
    lists = nodes.filter("vec_id > 0").select(F.col("node").alias("a"), near.alias("near"))
    met = [{(r["a"], r["b"]) for r in vectors._improve(lists, nodes, turn).collect()} for turn in (0, 1)]
    assert met[0] - met[1] and met[1] - met[0]


def test_odd_tables(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (None, [2.0, 0.0], "c"), (None, None, "d")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string")
    got = near_vectors(df).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in got) == [
        (0, 0, 0), (0, 2, 1), (1, 2, 1), (1, 2, 1)
    ]
    assert near_vectors(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3), (200, 200), (103, 100), (103, 100)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
