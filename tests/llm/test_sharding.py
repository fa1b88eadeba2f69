import random
import zlib

import pytest

from tonelake.llm.sharding import shard_by_bytes


def brute(rows, shards):
    """``doc_id, size, checksum, shard, slot`` by one running total."""
    cards = [(key, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for key, t in rows]
    cards.sort(key=lambda c: (c[0] is not None, c[0] or 0, c[1], c[2]))
    total, before, held, out = sum(c[2] for c in cards), 0, [0] * shards, []
    for key, crc, size in cards:
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        out.append((key, size, crc, shard, held[shard]))
        held[shard] += 1
        before += size
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "shards", "n"), [(1, 8, 700), (2, 3, 50), (3, 8, 5)])
def test_against_brute_force(spark, seed, shards, n):
    rng = random.Random(seed)
    texts = [None, "", "ünï", "x" * 400, "y" * 9000, *[rng.choice("ab") * rng.randint(1, 90) for _ in range(n)]]
    rows = [(rng.choice([None, 7, *range(n)]), rng.choice(texts)) for _ in range(n)] + [(None, None)] * (n // 2)
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards).collect()
    names = ("doc_id", "size", "text_crc32", "shard", "slot")
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == brute(rows, shards)


def test_contiguous_and_even(spark):
    rows = [(i, "x" * (i * 37 % 101)) for i in range(500)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got.sort(key=lambda r: r["doc_id"])
    assert [r["size"] for r in got] == [len(t) + 1 for _, t in rows]
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    sums = {}
    for r in got:
        own = sums.setdefault(r["shard"], [])
        assert r["slot"] == len(own)
        own.append(r["size"])
    totals = [sum(x) for x in sums.values()]
    assert len(sums) == 8 and max(totals) - min(totals) <= 2 * 101


def test_odd_rows(spark, odd):
    got = shard_by_bytes(odd.withColumnsRenamed({"lang": "shard", "source": "range"})).collect()
    assert len(got) == 8
    assert sorted(r["size"] for r in got if r["doc_id"] in (2, 3)) == [1, 1]
    slots = {(r["shard"], r["slot"]) for r in got}
    assert len(slots) == 8
    assert shard_by_bytes(odd.limit(0)).count() == 0
