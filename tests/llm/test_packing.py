import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tonelake.llm.packing import SquareSumPacker, pack_documents
from tonelake.llm.tokens import encoder, public_path


def ids(n, key):
    return np.arange(key, key + n, dtype="<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 9))
def test_pieces_tile_documents_and_windows(sizes, max_open):
    packer = SquareSumPacker(3, window=16, max_open=max_open)
    rows = []
    for key, n in enumerate(sizes):
        rows += packer.add((key, n, 0, ids(n, 1000 * key)))
        assert packer.open <= max_open
    for made in packer.finish():
        rows += made
    docs, windows = {}, {}
    for (key, total, start, data), window, offset in rows:
        assert total == sizes[key] and data == ids(total, 1000 * key)[4 * start :][: len(data)]
        docs.setdefault(key, []).append((start, len(data) // 4))
        windows.setdefault(window, []).append((offset, len(data) // 4))
    for key, n in enumerate(sizes):
        assert gapless(docs[key]) == n
    fills = [gapless(w) for w in windows.values()]
    assert all(f == 16 or f & (f - 1) == 0 for f in fills)


def gapless(parts):
    at = 0
    for start, n in sorted(parts):
        assert start == at and n > 0
        at += n
    return at


def test_place_is_the_one_of_least_square_sum():
    rng = np.random.default_rng(5)
    for _ in range(500):
        packer = SquareSumPacker(0, window=24, levels=12)
        for fill in rng.integers(1, 24, rng.integers(0, 12)).tolist():
            packer.windows[fill // 2].append((fill, []))
            packer.counts[fill // 2] += 1
        size = int(rng.integers(1, 24))

        def squares(level, packer=packer, size=size):
            after = list(packer.counts)
            if level is not None:
                after[level] -= 1
            fill = size + (packer.windows[level][-1][0] if level is not None else 0)
            if fill != 24:
                after[fill % 24 // 2] += 1
            return sum(n * n for n in after)

        held = [h for h in range(12) if packer.counts[h]]
        whole = [None] + [h for h in held if packer.windows[h][-1][0] + size <= 24]
        cut = [h for h in held if h not in whole]
        before = sum(n * n for n in packer.counts)
        chosen = packer.place(size)
        least = min(map(squares, whole))
        if least > before + 1 and cut and min(map(squares, cut)) <= before:
            assert chosen in cut and squares(chosen) == min(map(squares, cut))
        else:
            assert chosen in whole and squares(chosen) == least


def test_small_partitions_are_packed_by_the_rule():
    rng = np.random.default_rng(7)
    packer, by_rule = SquareSumPacker(0), set()
    for key in range(250):
        n = int(rng.integers(20, 900))
        by_rule |= {w for _, w, _ in packer.add((key, n, 0, ids(n, 0)))}
    at_end = {w for rows in packer.finish() for _, w, _ in rows}
    assert len(by_rule) > 2 * len(at_end)


def test_ids_of_pieces_are_the_librarys(spark, odd):
    rows = pack_documents(odd, public_path(), with_ids=True).collect()
    plain = encoder(public_path()).tokenizer
    for doc in odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        want = np.array(
            plain.encode(doc["text"] or "", add_special_tokens=False).ids + [1], "<u4"
        ).tobytes()
        own = sorted((r for r in rows if r["doc_id"] == doc["doc_id"]), key=lambda r: r["start"])
        for r in own:
            assert r["ids"] == want[4 * r["start"] :][: 4 * r["length"]]
        assert {r["doc_tokens"] for r in own} == {len(want) // 4}


def test_documents_and_odd_rows(spark, odd):
    rows = pack_documents(odd, public_path(), with_ids=True).collect()
    plain = encoder(public_path()).tokenizer
    want = sorted(
        (r["doc_id"] or 0, len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1)
        for r in odd.collect()
    )
    firsts = [r for r in rows if r["start"] == 0]
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in firsts) == want
    assert sum(r["length"] for r in rows) == sum(n for _, n in want)
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] for r in rows)
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    fills = [gapless(w) for w in windows.values()]
    assert all(f == 2048 or f & (f - 1) == 0 for f in fills)
    assert pack_documents(odd.limit(0), public_path()).count() == 0
