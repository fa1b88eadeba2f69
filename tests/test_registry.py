import json
import threading

from pyspark.sql import functions as F

from tonelake.sources import registry as rg


def listed(df):
    return [(r["name"], r["path"]) for r in df.orderBy("position").collect()]


def test_two_writers_at_once_lose_nothing(spark, folder):
    path, failed = f"{folder}/registry", []

    def write(who):
        try:
            for i in range(4):
                rows = [(f"{who}{i}", f"p/{who}{i}", "t"), ("both", f"p/{who}{i}", "t")]
                rg.log_models(spark.createDataFrame(rows, "name string, path string, type string"), path)
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=write, args=(who,)) for who in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    got = dict(listed(rg.read_registry(spark, path)))
    assert got.keys() == {f"{w}{i}" for w in "ab" for i in range(4)} | {"both"}
    assert got["both"] in ("p/a3", "p/b3") and got["a2"] == "p/a2"
    # compacted, the same; nor does a writer in between lose anything
    before = listed(rg.read_registry(spark, path))
    assert listed(rg.compact_registry(spark, path)) == before
    with open_parts(spark, path) as parts:
        assert parts == []
    rg.register_model(spark, path, "a0", "p/new", "t")
    after = listed(rg.read_registry(spark, path))
    assert [n for n, _ in after] == [n for n, _ in before] and dict(after)["a0"] == "p/new"
    assert listed(rg.compact_registry(spark, path)) == after


class open_parts:
    def __init__(self, spark, path):
        self.parts = rg._log_parts(spark, path)

    def __enter__(self):
        return self.parts

    def __exit__(self, *error):
        return False


def test_log_beside_a_given_list(spark, folder):
    path = f"{folder}/list.json"
    with open(path, "w") as f:
        json.dump([{"name": n, "path": n, "type": "t"} for n in ("z", "b", "z")], f)
    assert listed(rg.read_registry(spark, path)) == [("z", "z"), ("b", "b"), ("z", "z")]
    entries = spark.createDataFrame([("b", "b2", "t"), ("a", "a", "t"), (None, "x", "t")], "name string, path string, type string")
    rg.log_models(entries, path)
    assert listed(rg.read_registry(spark, path)) == [("z", "z"), ("b", "b2"), ("a", "a")]
    rg.log_models(entries.limit(0), path)
    # a writer that isn't done, or failed, has written nothing
    entries.withColumn("stamp", F.lit("1")).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).json(f"{path}.log/unfinished")
    assert listed(rg.compact_registry(spark, path)) == [("z", "z"), ("b", "b2"), ("a", "a")]
