import random
import time
from collections import defaultdict

from corpus_pipeline import line_dedup
from tonelake.llm.linededup import drop_boilerplate

SCHEMA = "doc_id long, text string, source string"


def brute(rows, min_sites, min_words):
    sites, keeper = defaultdict(set), {}
    for doc, text, site in rows:
        for line in set((text or "").split("\n")):
            line = line.rstrip("\r").strip(" ")
            if text is not None and len(line.split()) >= min_words:
                if site is not None:
                    sites[line].add(site)
                if doc is not None:
                    keeper[line] = min(doc, keeper.get(line, doc))
    out = []
    for doc, text, _ in rows:
        if text is None:
            out.append((doc, None, 0))
            continue
        lines = text.split("\n")
        kept = [
            x for x in lines
            if len(sites[y := x.rstrip("\r").strip(" ")]) < min_sites or keeper.get(y) == doc
        ]
        out.append((doc, "\n".join(kept), len(lines) - len(kept)))
    return out


def key(row):
    return tuple((x is None, x or "") for x in row)


def test_against_brute_force(spark):
    rng = random.Random(2)
    pool = [f"shared line number {i} here" for i in range(40)] + ["short", "", "  shared line number 1 here \r"]
    rows = []
    for doc in range(300):
        lines = rng.choices(pool, k=rng.randint(0, 6)) + [f"own line of {doc}"] * (doc % 3)
        rows.append((doc, "\n".join(lines), rng.choice([None, *[f"s{i}" for i in range(25)]])))
    got = drop_boilerplate(spark.createDataFrame(rows, SCHEMA), min_sites=12, min_words=3).collect()
    want = brute(rows, 12, 3)
    assert sorted((r["doc_id"], r["text"], r["lines_removed"]) for r in got) == sorted(want)
    assert 0 < sum(n for *_, n in want)


def test_a_line_of_a_third_of_all_rows(spark):
    rows = [(i, f"one line for everyone\nown words of {i}", f"s{i % 30}") for i in range(3000)]
    got = {r["doc_id"]: r["text"] for r in drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.pop(0) == rows[0][1]
    assert all(text == f"own words of {i}" for i, text in got.items())


def test_odd_rows(spark, odd):
    df = odd.withColumnRenamed("sequence_id", "lines_removed")
    got = drop_boilerplate(df, min_sites=1, min_words=1)
    assert got.columns == df.columns
    rows = {(r["doc_id"], r["text"], r["lines_removed"]) for r in got.collect()}
    assert (2, None, 0) in rows and (3, "", 0) in rows
    # rows alike in id and text keep the line that both hold
    assert (1, "Plain words stand here. They end.", 0) in rows
    assert got.count() == 8
    assert drop_boilerplate(df.limit(0)).count() == 0


def test_short_lines_and_scripts_without_spaces_in_the_pipeline(spark):
    shared = ["Les.", "And ornd.", "\u8457\u4f5c\u6a29\u306f\u5f53\u793e\u306b\u5e30\u5c5e\u3057\u307e\u3059"]
    rows = [(i, "\n".join([*shared, "", "\t", f"own words of {i}"]), f"s{i % 12}", "en", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA + ", lang string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in line_dedup(spark, docs, "").collect()}
    assert got.pop(0) == rows[0][1]
    assert all(text == f"\n\t\nown words of {i}" for i, text in got.items()) and len(got) == 59


def test_a_long_text_with_very_many_lines_to_drop(spark):
    shared = [f"shared {i}" for i in range(20_000)]
    rows = [(i, "\n".join(x for n, s in enumerate(shared) for x in (s, f"own {i} {n}")), f"s{i}") for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    began = time.time()
    got = {r["doc_id"]: (r["lines_removed"], hash(r["text"])) for r in drop_boilerplate(df, min_sites=3).collect()}
    assert time.time() - began < 60
    own = lambda i: "\n".join(f"own {i} {n}" for n in range(20_000))
    assert got == {0: (0, hash(rows[0][1])), 1: (20_000, hash(own(1))), 2: (20_000, hash(own(2)))}
