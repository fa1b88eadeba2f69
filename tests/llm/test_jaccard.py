import random
import re

import numpy as np
import pytest

from tonelake.llm import jaccard
from tonelake.llm.common import word_hashes
from tonelake.llm.jaccard import _shared, keep_one_of_each, near_copies, runs_for
from tonelake.operators import skew

from .conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    words = WORD.findall((text or "").lower())
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = [
        [j for j in range(len(rows)) if i != j and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
        for i in range(len(rows))
    ]
    best = [key for key, _ in rows]
    while True:
        new = [min([best[i], *(best[j] for j in links[i])]) for i in range(len(rows))]
        if new == best:
            return {rows[i][0]: (best[i], len(links[i])) for i in range(len(rows))}
        best = new


def family(rng, base, n, most):
    """Near copies of a text, with up to ``most`` of its words changed."""
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(len(words))] = f"changed{rng.randrange(10**6)}"
        yield " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    passage = prose(60, 90_000)
    texts = [prose(rng.randint(20, 120), 500 * i) for i in range(60)]
    texts += [f"{prose(rng.randint(5, 200), 40_000 + 500 * i)} {passage}" for i in range(60)]
    for k in range(12):
        texts += family(rng, prose(100, 200_000 + 999 * k), 8, 5)
    texts += family(rng, prose(150, 300_000), 70, 4)
    texts += [texts[3]] * 5 + ["one two three", "One, two three!", "one two", "a b c d e", "a b c d e f"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("bucket", [256, 20])
def test_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    rows = corpus(bucket)
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute(rows)
    assert {r["doc_id"] for r in got if r["kept"]} == {c for c, _ in brute(rows).values()}


def test_runs_reach_the_recall():
    assert runs_for(0.9) < runs_for(0.999) < runs_for(0.99999) <= 10


def test_shared_counts_in_column_blocks():
    rng = np.random.default_rng(1)
    lists = [np.unique(rng.integers(0, 200, rng.integers(0, 80))) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in lists] for a in lists]
    for cells in (1 << 22, 90):
        got = _shared(lists, cells)
        np.fill_diagonal(got, 0)
        np.fill_diagonal(w := np.array(want), 0)
        assert (got == w).all()


def test_long_text_hashes_like_short_ones():
    text = " ".join(f"wörd{i}" for i in range(250_000)).encode()
    hashes, starts = word_hashes(text)
    assert len(hashes) == 250_000 == len(np.unique(hashes))
    one, _ = word_hashes("WÖRD249999".encode())
    assert hashes[-1] != one[0]  # only A-Z fold
    assert hashes[-1] == word_hashes("WöRD249999".encode())[0][0]


def test_odd_rows(spark, odd):
    df = odd.withColumnRenamed("lang", "row_key")
    got = near_copies(df).collect()
    assert len(got) == 8
    by = {r["doc_id"]: r for r in got}
    assert [(by[i]["class_id"], by[i]["n_links"]) for i in (1, 2, 3, 4)] == [(1, 1), (2, 0), (3, 0), (4, 0)]
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns and kept.count() == 7
    assert near_copies(df.limit(0)).count() == 0


def test_large_buckets_are_judged_by_a_few_before_members_go_on(spark, monkeypatch):
    """A dense bucket of any size sends about ``JUDGED`` samples, and none of its members on."""
    rng = random.Random(9)
    group = [rng.getrandbits(31) for _ in range(64)]
    near = [(i, [*group[:63], rng.getrandbits(31)]) for i in range(3000)]
    apart = [(i, [*group[:8], *(rng.getrandbits(31) for _ in range(56))]) for i in range(3000, 6000)]
    sets = spark.createDataFrame(near + apart, "sid long, sample array<int>")
    parents = sets.selectExpr("sid div 3000 as path", "sid", "3000L as size")
    rows, store = {}, jaccard.materialize

    def watched(df, name):
        out = store(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "materialize", watched)
    assert [r["path"] for r in jaccard._dense(sets, parents).collect()] == [0]
    assert 0 < rows["judged"] < 2 * 2 * jaccard.JUDGED
    rows.clear()
    classes = sets.filter("sid < 3000").withColumn("n", jaccard.F.lit(100))
    paths = jaccard._split(classes, 2)
    assert paths.select("sid").distinct().count() == 3000
    assert rows["live-sets"] < 300


def test_groups_of_middling_likeness_do_not_multiply(spark, monkeypatch):
    """Sets that share less than half, but enough for each step to put them into more buckets."""
    rng = random.Random(5)
    core = [rng.getrandbits(31) for _ in range(54)]
    held = ([t for t in core if rng.random() < 0.85] for _ in range(1500))
    sets = [(i, [*some, *(rng.getrandbits(31) for _ in range(64 - len(some)))]) for i, some in enumerate(held)]
    classes = spark.createDataFrame(sets, "sid long, sample array<int>").withColumn("n", jaccard.F.lit(100))
    rows, store = {}, jaccard.materialize

    def watched(df, name):
        out = store(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "materialize", watched)
    paths = jaccard._split(classes, 4)
    assert rows["members"] < 30 * 1500
    whole = paths.groupBy("path").count().agg({"count": "max"}).first()[0]
    assert whole > 1400


def test_groups_of_weak_likeness_do_not_multiply(spark, monkeypatch):
    """Sets that share two fifths, so that each step keeps as many rows as it took."""
    rng = random.Random(6)
    core = [rng.getrandbits(31) for _ in range(54)]
    held = ([t for t in core if rng.random() < 0.7] for _ in range(1500))
    sets = [(i, [*some, *(rng.getrandbits(31) for _ in range(64 - len(some)))]) for i, some in enumerate(held)]
    classes = spark.createDataFrame(sets, "sid long, sample array<int>").withColumn("n", jaccard.F.lit(100))
    rows, store = {}, jaccard.materialize

    def watched(df, name):
        out = store(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "materialize", watched)
    paths = jaccard._split(classes, 4)
    assert rows["members"] < 15 * 1500
    assert rows["buckets"] < 6 * 1500
    whole = paths.groupBy("path").count().agg({"count": "max"}).first()[0]
    assert whole > 1400


def test_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 20)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rows = corpus(7)
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute(rows)


def test_only_classes_with_links_are_looked_up(spark, monkeypatch):
    """Most texts are alone; the table of firsts, repeated for each salt past a bound, has none of them."""
    rows, size, store = corpus(8), {}, jaccard.materialize
    want = brute(rows)

    def watched(df, name):
        out = store(df, name)
        size[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "materialize", watched)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 5)
    out = near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == want
    assert sorted(r["doc_id"] for r in got if r["kept"]) == sorted({c for c, _ in want.values()})
    sets = {}
    for key, text in rows:
        sets.setdefault(want[key][0], set()).add(frozenset(shingles(text)))
    assert size["class-firsts"] == sum(len(s) > 1 for s in sets.values()) < len(sets) / 2
