import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tonelake.llm.eliasfano import EliasFano
from tonelake.llm.tokenfile import TokenFile, file_bytes, token_file_round_trip
from tonelake.llm.tokens import WordEncoder, encoder, public_path

PIECES = ["I'm", "Don't.", "é", "é.", "é", "ΑΣ.", "İ", "a.b,", "12,5.", "...", "'S.", "\x1c", " ", "\n\n", "<|endoftext|>", "ABC,", "ß", "\U0001F600", "'", "ǅ"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, " ", " ", "\t"]), max_size=12).map("".join))
def test_words_encode_as_the_library_encodes_the_text(text):
    enc = encoder(public_path())
    got = np.frombuffer(enc.encode([text])[0], "<u4").tolist()
    assert got == enc.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62), max_size=700), st.booleans())
def test_elias_fano(values, narrow):
    values = np.sort(np.array([v % 50 if narrow else v for v in values], np.int64))
    coded, _ = EliasFano.from_bytes(b"xx" + EliasFano.build(values).to_bytes(), 2)
    assert coded.values().tolist() == values.tolist()
    for i in range(0, len(values), 37):
        assert coded.select(i) == values[i]
        assert coded.stretch(i, min(len(values), 3 * i)).tolist() == values[i : 3 * i].tolist()
    with pytest.raises(IndexError):
        coded.select(len(values))


def test_elias_fano_is_small_and_selects_over_gaps():
    bounds = np.cumsum(np.random.default_rng(1).integers(1, 3000, 20_000))
    assert len(EliasFano.build(bounds).to_bytes()) < 2 * len(bounds)
    gap = np.concatenate([np.zeros(600, np.int64), [10**6], np.full(300, 10**6 + 1)])
    coded = EliasFano.build(gap)
    assert [coded.select(i) for i in (0, 255, 256, 599, 600, 601, 900)] == gap[[0, 255, 256, 599, 600, 601, 900]].tolist()


def test_file_has_any_document():
    lists = [[7, 8, 9], [1], [5, 1]]
    data = b"".join(np.array(x, "<u2").tobytes() for x in lists)
    file = TokenFile(file_bytes([None, -4, 90], np.array([3, 1, 2]), data, 2))
    assert [file.doc_id(i) for i in range(3)] == [None, -4, 90]
    assert [file.tokens(i).tolist() for i in range(3)] == lists
    assert [(k, s, x.tolist()) for k, s, x in file] == [(None, 0, lists[0]), (-4, 3, lists[1]), (90, 4, lists[2])]


@pytest.mark.parametrize("file_ids", [50, 1 << 24])
def test_round_trip(spark, odd, file_ids):
    rows = token_file_round_trip(spark, odd, public_path(), file_ids=file_ids).collect()
    rows.sort(key=lambda r: r["start"])
    keys = [r["doc_id"] for r in rows]
    assert keys == [None, 1, 1, 2, 3, 4, 5, 6]
    plain = encoder(public_path()).tokenizer
    texts = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["text"] or "") for r in odd.collect())
    at = 0
    for row, (_, text) in zip(rows, texts, strict=True):
        want = [*plain.encode(text, add_special_tokens=False).ids, 1]
        assert row["start"] == at and row["n_tokens"] == len(want)
        assert np.frombuffer(row["ids"], "<u4").tolist() == want
        at += len(want)


def test_many_empty_texts_of_one_id(spark):
    rows = [(None, None)] * 900 + [(5, "")] * 900 + [(6, "some words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = token_file_round_trip(spark, df, public_path(), with_ids=False, file_docs=70).collect()
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [key for key, _ in rows]
    assert [r["start"] for r in got] == list(range(1801)) and {r["n_tokens"] for r in got[:-1]} == {1}


def test_packing_in_pieces(monkeypatch):
    from tonelake.llm import eliasfano

    values = np.cumsum(np.random.default_rng(4).integers(0, 9000, 1000))
    whole = EliasFano.build(values).to_bytes()
    monkeypatch.setattr(eliasfano, "_PIECE", 64)
    assert EliasFano.build(values).to_bytes() == whole
    coded, _ = EliasFano.from_bytes(whole)
    assert coded.stretch(61, 333).tolist() == values[61:333].tolist()


def test_empty_table(spark, odd):
    assert token_file_round_trip(spark, odd.limit(0), public_path()).count() == 0


def test_signs_after_a_word_are_learnt_once(monkeypatch):
    enc, asked = WordEncoder(public_path()), []
    library = enc._ids
    monkeypatch.setattr(enc, "_ids", lambda pieces: asked.extend(pieces) or library(pieces))
    texts = ["wörd### other%%% Third### ÀŁŉɏ&&& a.,:;?! b/()*$#", "wörd%%% other.", "''s a'b## <|endoftext|>!!"]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in enc.encode(texts[:2])]
    assert sorted(asked) == sorted(["###", "%%%", "&&&", ".,:;?!", "/()*$#", "."])
    got += [np.frombuffer(ids, "<u4").tolist() for ids in enc.encode(texts[2:])]
    assert got == [enc.tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
