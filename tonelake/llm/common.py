"""What the operators of this package share: batches of texts, word hashes, ids."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import SALTS, fits_broadcast

BATCH_BYTES = 1024 * 1024
# Rows of an Arrow batch made into Python objects at once
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The only two columns that the operators read; others may have any name."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The store that a folder's URI names; a plain path is a mounted share."""
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def text_batches(
    batches: Iterable[pa.RecordBatch], max_bytes: int = BATCH_BYTES
) -> Iterator[tuple[list, list]]:
    """``(ids, texts)`` of about ``max_bytes`` characters; a longer text comes alone."""
    ids: list = []
    texts: list = []
    size = 0
    for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = len(text) if text else 0
            if ids and size + n > max_bytes:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(key)
            texts.append(text)
            size += n
    if ids:
        yield ids, texts


def filter_rows(docs: DataFrame, text_col: str, keep: Callable[[list], np.ndarray]) -> DataFrame:
    """Rows of ``docs`` whose texts ``keep`` says yes to, with all their columns.

    ``keep`` gets lists of texts, about ``BATCH_BYTES`` at a time.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            upto = np.cumsum(sizes, dtype=np.int64)
            done = 0
            while done < batch.num_rows:
                most = (upto[done - 1] if done else 0) + BATCH_BYTES
                stop = max(done + 1, int(np.searchsorted(upto, most, "right")))
                part = batch.slice(done, stop - done)
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))
                done = stop

    return docs.mapInArrow(run, docs.schema)


def hot_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner"
) -> DataFrame:
    """Join rows to a stored lookup table, unique by ``keys``, that may have hot keys.

    Broadcast if its size, which is looked up, is small. Otherwise the lookup is
    repeated once per salt, and a frequent key is shared out over ``SALTS`` tasks. Spark takes
    the repeated table for as small as the stored one, so it is told not to broadcast it.
    """
    if fits_broadcast(lookup):
        return rows.join(F.broadcast(lookup), keys, how)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = lookup.withColumn("__salt", salts).hint("merge")
    return rows.withColumn("__salt", salt).join(salted, [*keys, "__salt"], how).drop("__salt")


# Bits of the filter in ``maybe_in``; its rows are 4 KB each, 4 MB in all at most.
FILTER_BITS = 1 << 25


def maybe_in(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key``, a hash, may be among those ``wanted``; none that is goes.

    A bitmap of fixed size is built from the wanted keys by aggregation and
    broadcast, so the rows that a join would drop aren't shuffled for it. When very many keys are wanted
    it lets more through, and the join that follows decides.
    """
    place = F.pmod(F.col(key), F.lit(FILTER_BITS)) + 1
    bits = wanted.groupBy(F.bitmap_bucket_number(place).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__bits")
    )
    bit = F.bitmap_bit_position(place)
    marked = rows.withColumns({"__bucket": F.bitmap_bucket_number(place), "__bit": bit})
    marked = marked.join(F.broadcast(bits), "__bucket")
    byte = "ascii(decode(substring(__bits, int(__bit div 8) + 1, 1), 'ISO-8859-1'))"
    hit = F.expr(f"({byte} & shiftleft(1, int(__bit % 8))) <> 0")
    return marked.filter(hit).select(*rows.columns)


# --- word hashes ------------------------------------------------------------
# A word is a run of ASCII letters, digits and bytes of 128 and more (so any
# character that is not ASCII); A-Z count as a-z.

_LOWER = np.zeros(256, np.uint8)
_LOWER[48:58] = np.arange(48, 58)
_LOWER[97:123] = np.arange(97, 123)
_LOWER[65:91] = np.arange(97, 123)
_LOWER[128:] = np.arange(128, 256)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, name: str, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, _CHUNK + 4096), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def _hash_chunk(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = _LOWER[raw]
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = low != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(low * _power(_BASE, "up", len(low)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power(_BACK, "down", len(low) + 1)[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), starts


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first byte of every word of UTF-8 text.

    Works in pieces cut between words, so that a long text needs little more
    than its hashes.
    """
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= _CHUNK:
        return _hash_chunk(raw)
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + _CHUNK)
        while end < len(raw) and _LOWER[raw[end]]:
            end += 1
        h, s = _hash_chunk(raw[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def batch_words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and where each text's words begin and end.

    The second array has one entry more than there are texts. Null is empty.
    """
    encoded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    hashes, starts = word_hashes(b"\n".join(encoded))
    first = np.cumsum([0, *(len(e) + 1 for e in encoded)])
    return hashes, np.searchsorted(starts, first)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, by the position of its first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + words[j : j + n]
    return mix(out + np.uint64(k))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of ``k`` words in a row.

    A text of fewer words is one shingle of all of them, one of none has none.
    """
    return np.unique(gram_hashes(words, min(k, len(words)))) if len(words) else words[:0]
