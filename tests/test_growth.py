"""What keeps the work of a step in proportion to its input."""

import os

from pyspark.sql import functions as F

from tonelake import session
from tonelake.functions import phrases as ph
from tonelake.functions import text as tx
from tonelake.llm.common import hot_join
from tonelake.operators import cleaning as cl
from tonelake.operators import rows as rw
from tonelake.operators import skew
from tonelake.operators.skew import narrow_join


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_changed_tokens_go_back_to_their_row(spark):
    tokens = [["cats", "a", "cats"], [], None, ["b"], ["b", "dogs"], ["x_NEG", None, "dogs", "c", "cats"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "id int, t array<string>")
    pairs = {"cats": "cat", "dogs": "dog", "b": "b", "x_NEG": "y"}
    lexicon = spark.createDataFrame([*pairs.items(), ("a", None)], "word string, lemma string")
    out = cl.with_lemmas(cl.numbered_rows(df), "t", lexicon)
    want = [t and [w if w is None or w.endswith("_NEG") else pairs.get(w, w) for w in t] for t in tokens]
    assert [r["t"] for r in out.orderBy("id").collect()] == want


def test_emoji_are_told_by_a_short_class_first(spark):
    needs, whole, _ = ph.emoji_parts()
    assert needs.startswith("(?=[") and whole.startswith("(?=[")
    df = spark.createDataFrame([("a 3️⃣ \U0001F600 café #1",)], "t string")
    assert df.select(tx.demojize("t")).first()[0] == "a :keycap_3: :grinning_face: café #1"


def test_wide_rows_are_not_sorted_for_a_join(spark):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("t"))
    few = df.filter("id % 3 = 0").select("id", F.lit(1).alias("n"))
    out = narrow_join(df, few, "id", "left", max_rows=5)
    assert "ShuffledHashJoin" in plan(out) and "SortMergeJoin" not in plan(out)
    assert out.filter("n = 1").count() == 34 and out.count() == 100


def test_a_lookup_repeated_for_each_salt_is_not_broadcast(spark, folder, monkeypatch):
    spark.range(50).select((F.col("id") * 2).alias("k"), "id").write.parquet(f"{folder}/lookup")
    lookup = spark.read.parquet(f"{folder}/lookup")
    rows = spark.range(300).select(F.pmod("id", F.lit(4)).alias("k"), F.col("id").alias("row"))
    assert "BroadcastHashJoin" in plan(hot_join(rows, lookup, ["k"], ["row"]))
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 5)
    for how, count in (("inner", 150), ("left", 300)):
        out = hot_join(rows, lookup, ["k"], ["row"], how)
        assert "SortMergeJoin" in plan(out) and "BroadcastHashJoin" not in plan(out)
        assert out.count() == count and out.filter("id = k div 2").count() == 150


def test_nulls_are_dropped_where_a_column_comes_from(spark, folder):
    nan = float("nan")
    rows = [(1, 1.0, "a"), (2, nan, "b"), (3, None, "c"), (4, 4.0, None)]
    spark.createDataFrame(rows, "id int, s double, t string").write.parquet(f"{folder}/in")
    df = spark.read.parquet(f"{folder}/in")
    scores = df.select("id", F.col("s").alias("score"))
    joined = rw.drop_null_rows(df.select("id", "t").join(scores, "id", "left"), ["score", "t"])
    assert [r["id"] for r in joined.collect()] == [1]
    assert "IsNotNull(t)" in plan(joined)


def test_pieces_stay_small(spark, folder, monkeypatch):
    spark.range(50_000).coalesce(1).write.parquet(f"{folder}/in")
    size = sum(os.path.getsize(f"{folder}/in/{f}") for f in os.listdir(f"{folder}/in") if f.endswith(".parquet"))
    monkeypatch.setattr(session, "PIECE_BYTES", size // 20, raising=False)
    df = session.spread(spark.read.parquet(f"{folder}/in"), f"{folder}/in")
    assert df.rdd.getNumPartitions() >= 20
