"""Benchmark passages in documents, found by winnowed fingerprints."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import (
    FILTER_BITS,
    SALTS,
    batch_words,
    filter_rows,
    gram_hashes,
    hot_join,
    id_and_text,
    maybe_in,
    open_folder,
    text_batches,
)

SPAN = 10
GRAM = 5
# Benchmark words in one block, of 8 bytes and about 8 more for fingerprints each
BLOCK_WORDS = 1 << 22


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of every ``window`` in a row (the last of equals).

    Two texts that share ``window + k - 1`` words share a window of k-gram
    hashes, so they share the fingerprint kept from it.
    """
    if not len(grams):
        return np.empty(0, np.int64)
    if len(grams) <= window:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))])
    # sliding minimum over (hash, -place) by doubling steps
    best = np.arange(len(grams))
    step = 1
    while step < window:
        reach = min(step, window - step)
        left, right = best[:-reach], best[reach:]
        best = np.where(grams[right] <= grams[left], right, left)
        step += reach
    return np.unique(best)


class Block:
    """Part of the benchmark: its words end to end, fingerprints and short items."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], span: int = SPAN, gram: int = GRAM):
        self.span, self.gram = span, gram
        self.names = [i for i, _ in items]
        lengths = np.array([len(w) for _, w in items], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.words = np.concatenate([w for _, w in items]) if items else np.empty(0, np.uint64)
        prints, places, owners = [], [], []
        short: dict[int, list[tuple[int, int]]] = {}
        for n, (_, words) in enumerate(items):
            if not len(words):
                continue
            if len(words) < span:
                short.setdefault(len(words), []).append((int(gram_hashes(words, len(words))[0]), n))
                continue
            grams = gram_hashes(words, gram)
            kept = winnow(grams, span - gram + 1)
            prints.append(grams[kept])
            places.append(self.starts[n] + kept)
            owners.append(np.full(len(kept), n))
        empty = np.empty(0, np.int64)
        prints = np.concatenate(prints) if prints else empty.astype(np.uint64)
        order = np.argsort(prints, kind="stable")
        self.prints = prints[order]
        self.places = (np.concatenate(places) if places else empty)[order]
        self.owners = (np.concatenate(owners) if owners else empty)[order]
        self.short = {
            size: (np.array([h for h, _ in sorted(rows)], np.uint64), [n for _, n in sorted(rows)])
            for size, rows in short.items()
        }

    def compare(self, words: np.ndarray, document: np.ndarray, hit: np.ndarray, found: list[set]) -> None:
        """Mark the words of a batch of documents that lie in a shared span.

        ``document`` says whose each word is. Fingerprints of the batch that the
        benchmark has are extended word by word to both sides, within document
        and item, and count if the span they grow to is ``span`` words or more.
        """
        grams = gram_hashes(words, self.gram)
        if len(self.prints) and len(grams):
            # windows may reach over the end of a document: that only adds fingerprints
            kept = winnow(grams, self.span - self.gram + 1)
            kept = kept[document[kept] == document[kept + self.gram - 1]]
            low = np.searchsorted(self.prints, grams[kept], "left")
            count = np.searchsorted(self.prints, grams[kept], "right") - low
            self._extend(words, document, hit, found, kept, low, count)
        for size, (hashes, owners) in self.short.items():
            grams = gram_hashes(words, size)
            at = np.flatnonzero(np.isin(grams, hashes))
            at = at[document[at] == document[at + size - 1]]
            for step in range(size):
                hit[at + step] = True
            low = np.searchsorted(hashes, grams[at], "left")
            high = np.searchsorted(hashes, grams[at], "right")
            for doc, a, b in {*zip(document[at].tolist(), low.tolist(), high.tolist(), strict=True)}:
                found[doc].update(self.names[owners[n]] for n in range(a, b))

    def _extend(self, words, document, hit, found, kept, low, count, most: int = 1 << 20) -> None:
        """Extend pairs of places, at most ``most`` at a time."""
        ends = np.cumsum(count)
        done = 0
        while done < len(kept):
            stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + most)))
            part = slice(done, stop)
            reps = count[part]
            here = np.repeat(kept[part], reps)
            within = np.arange(len(here)) - np.repeat(np.cumsum(reps) - reps, reps)
            there = np.repeat(low[part], reps) + within
            done = stop
            if not len(here):
                continue
            doc, item, place = document[here], self.owners[there], self.places[there]
            left = self._grow(words, document, here - 1, place - 1, doc, self.starts[item], -1)
            right = self._grow(
                words, document, here + self.gram, place + self.gram, doc, self.starts[item + 1] - 1, 1
            )
            length = left + self.gram + right
            good = np.flatnonzero(length >= self.span)
            begin, size = here[good] - left[good], length[good]
            marks = np.zeros(len(words) + 1, np.int64)
            np.add.at(marks, begin, 1)
            np.add.at(marks, begin + size, -1)
            hit |= np.cumsum(marks[:-1]) > 0
            for d, n in {*zip(doc[good].tolist(), item[good].tolist(), strict=True)}:
                found[d].add(self.names[n])

    def _grow(self, words, document, here, there, doc, limit, step) -> np.ndarray:
        """How many words on from each pair of places both texts go on alike."""
        grown = np.zeros(len(here), np.int64)
        live = np.arange(len(here))
        while len(live):
            a, b = here[live] + step * grown[live], there[live] + step * grown[live]
            inside = (a >= 0) & (a < len(words)) & ((b - limit[live]) * step <= 0)
            live, a, b = live[inside], a[inside], b[inside]
            alike = (document[a] == doc[live]) & (words[a] == self.words[b])
            live = live[alike]
            grown[live] += 1
        return grown


def index_benchmark(
    benchmark: DataFrame,
    folder: str,
    span: int = SPAN,
    gram: int = GRAM,
    block_words: int = BLOCK_WORDS,
    id_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the benchmark's fingerprints to ``folder`` in blocks; gives their names, ``file``, stored.

    Items are dealt to blocks of about ``block_words`` words by their hash; a task
    builds a block and writes it as a file of its own. Equal rows count once.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_batches(batches):
            words, at = batch_words(texts)
            parts = [words[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_pydict(
                {"item_id": pa.array(keys, pa.int64()), "words": pa.array(parts, pa.binary())}
            )

    items = id_and_text(benchmark, id_col, text_col).mapInArrow(hashed, "item_id long, words binary")
    items = materialize(items.distinct(), "benchmark-words")
    total = items.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0] // 8
    blocks = max(1, -(-total // block_words))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        name, held = None, []

        def close() -> pa.RecordBatch:
            file = f"block-{name:06d}-{TaskContext.get().taskAttemptId()}.pickle"
            with store.open_output_stream(f"{root}/{file}") as out:
                out.write(pickle.dumps(Block(held, span, gram)))
            return pa.RecordBatch.from_pydict({"file": [file]})

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != name and held:
                    yield close()
                    held = []
                name = row["block"]
                held.append((row["item_id"], np.frombuffer(row["words"], np.uint64)))
        if held:
            yield close()

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)))
    dealt = dealt.repartition(blocks, "block").sortWithinPartitions("block", "item_id", "words")
    return materialize(dealt.mapInArrow(build, "file string"), "benchmark-blocks")


_block: dict[str, Block] = {}


def _load(folder: str, name: str) -> Block:
    """A block from the shared folder; a worker remembers the last one only."""
    path = f"{folder}/{name}"
    if path not in _block:
        store, root = open_folder(folder)
        with store.open_input_stream(f"{root}/{name}") as source:
            block = pickle.loads(source.read())
        _block.clear()
        _block[path] = block
    return _block[path]


def compare_texts(texts: list, block: Block | None) -> tuple[np.ndarray, np.ndarray, list[set]]:
    """For a batch of texts: whether each word is hit, where texts begin, items found."""
    words, at = batch_words(texts)
    document = np.repeat(np.arange(len(texts)), np.diff(at))
    hit = np.zeros(len(words), bool)
    found: list[set] = [set() for _ in texts]
    if block:
        block.compare(words, document, hit, found)
    return hit, at, found


def _ranges(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]


_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


# --- several blocks: fingerprints meet by a join --------------------------------


def _block_keys(folder: str):
    """``key, file, size``: the fingerprints and short items of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                block = _load(folder, file)
                # 0: fingerprints; else whole items of so many words
                parts = [(0, block.prints), *((n, hashes) for n, (hashes, _) in block.short.items())]
                for size, keys in parts:
                    keys = np.unique(keys).view(np.int64)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key": pa.array(keys, pa.int64()),
                            "file": pa.array([file] * len(keys), pa.string()),
                            "size": pa.array(np.full(len(keys), size, np.int32), pa.int32()),
                        }
                    )

    return run


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for each of ``FILTER_BITS`` remainders, set where a key has it; 4 MB whatever the keys."""
    place = F.pmod(F.col("key"), F.lit(FILTER_BITS)) + 1
    rows = (
        keys.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        .collect()
    )
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in rows:
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        bits[(row["bucket"] - 1) * len(part) :][: len(part)] = part
    return bits


def _document_keys(bits, sizes: list[int], span: int, gram: int):
    """``row, n_words, keys``: fingerprints of each document that the benchmark may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for rows, texts in text_batches(batches):
            words, at = batch_words(texts)
            document = np.repeat(np.arange(len(texts)), np.diff(at))
            owners, keys = [], []
            for size in sorted({gram, *sizes}):
                grams = gram_hashes(words, size)
                if not len(grams):
                    continue
                places = np.arange(len(grams))
                if size == gram and size not in sizes:
                    places = winnow(grams, span - gram + 1)
                places = places[document[places] == document[places + size - 1]]
                low = (grams[places] & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                places = places[(known[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1]
                owners.append(document[places])
                keys.append(grams[places].view(np.int64))
            owner = np.concatenate([np.empty(0, np.int64), *owners])
            key = np.concatenate([np.empty(0, np.int64), *keys])
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(len(texts) + 1))
            lists = [np.unique(key[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "row": pa.array(rows, pa.int64()),
                    "n_words": pa.array(np.diff(at), pa.int64()),
                    "keys": pa.array(lists, pa.list_(pa.int64())),
                }
            )

    return run


def _compare_by_block(folder: str):
    """Hits of documents that come sorted by block, which is loaded once for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple[str, pa.RecordBatch]]:
            for batch in batches:
                files = batch.column(0).to_pylist()
                cuts = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1]), len(files)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if b > a:
                        yield files[a], batch.slice(a, b - a)

        for file, part in groups():
            block = _load(folder, file)
            for rows, texts in text_batches([part.select(["row", "text"])]):
                hit, at, found = compare_texts(texts, block)
                spans = [_ranges(hit[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": pa.array(rows, pa.int64()),
                        "hits": pa.array(spans, _HITS),
                        "items": pa.array([_names(ids) for ids in found], pa.list_(pa.string())),
                    }
                )

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of word places that may overlap, put together."""
    for batch in batches:
        at = batch.schema.get_field_index("hits")
        out = []
        for hits in batch.column(at).to_pylist():
            spans: list[dict] = []
            for one in sorted(hits or [], key=lambda h: h["start"]):
                if spans and one["start"] <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], one["end"])
                else:
                    spans.append(dict(one))
            out.append(spans)
        yield batch.set_column(at, "hits", pa.array(out, _HITS))


def _hits_by_join(
    rows: DataFrame, blocks: DataFrame, folder: str, span: int, gram: int
) -> tuple[DataFrame, DataFrame]:
    """``row, n_words`` of all rows of a stored table ``row, text``, and ``row, hits, items``
    of those that share a span with some block.

    Fingerprints of documents that the benchmark may have meet its own by a shuffle join; then a document
    goes to the blocks that it shares one with, and no further, and a task loads each of its blocks once.
    """
    spark = rows.sparkSession
    many = blocks.repartition(max(blocks.count(), 1))
    keys = materialize(many.mapInArrow(_block_keys(folder), "key long, file string, size int"), "benchmark-keys")
    # lengths below a span: a handful
    whole = [r["size"] for r in keys.filter("size > 0").select("size").distinct().collect()]
    bits = spark.sparkContext.broadcast(_bitmap(keys))
    read = rows.select("row", "text").mapInArrow(
        _document_keys(bits, whole, span, gram), "row long, n_words long, keys array<long>"
    )
    read = materialize(read, "document-keys")
    where = materialize(keys.groupBy("key").agg(F.collect_set("file").alias("files")), "key-blocks")
    met = hot_join(read.select("row", F.explode("keys").alias("key")), where, ["key"], ["row"])
    pairs = materialize(met.select("row", F.explode("files").alias("file")).distinct(), "document-blocks")
    texts = maybe_in(rows.select("row", "text"), pairs, "row").join(pairs.hint("merge"), "row")
    spread = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    texts = texts.select("file", "row", "text").withColumn("salt", spread)
    texts = texts.repartition("file", "salt").sortWithinPartitions("file", "salt").drop("salt")
    hits = texts.mapInArrow(
        _compare_by_block(folder), "row long, hits array<struct<start:long,end:long>>, items array<string>"
    )
    hits = hits.filter(F.size("hits") > 0).groupBy("row").agg(
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    hits = hits.mapInArrow(_joined, hits.schema)
    return read.select("row", "n_words"), materialize(hits, "document-hits")


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    span: int = SPAN,
    gram: int = GRAM,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Words of documents that lie in a span shared with the benchmark.

    Words are runs of characters other than ASCII signs and spaces, A-Z as a-z.
    A span is ``span`` words in a row, or a whole item of fewer; every one that
    document and item share is found. Per document: ``doc_id, n_words``, ``hits``
    (ranges of word places, end exclusive), ``items`` (the ids found, as strings
    in order; a null id is the empty string), ``contaminated``.

    Winnowing keeps the least hash of ``gram`` words in every ``span - gram + 1``, so
    a shared span has a shared fingerprint; matches are then extended word by word.
    Items too short to have a window are looked up whole. Against a benchmark of one block documents
    are read once without a shuffle; with more, their fingerprints are joined with those
    of the blocks first (``_hits_by_join``), and only documents that share one are compared.

    A null or empty text has no words and no hits; so has every text if the
    benchmark is empty. Null and repeated document ids stay as they are.
    """
    folder = scratch_path(docs.sparkSession, "benchmark")
    blocks = index_benchmark(benchmark, folder, span, gram, block_words)
    files = [r["file"] for r in blocks.limit(2).collect()]
    pairs = id_and_text(docs, id_col, text_col)
    if len(files) > 1:
        rows = materialize(pairs.withColumn("row", F.monotonically_increasing_id()), "documents")
        words, hits = _hits_by_join(rows, blocks, folder, span, gram)
        joined = rows.select("row", "doc_id").join(words, "row").join(hits, "row", "left")
        return joined.select(
            "doc_id",
            "n_words",
            F.coalesce("hits", F.array().cast("array<struct<start:long,end:long>>")).alias("hits"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.col("hits").isNotNull().alias("contaminated"),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _load(folder, files[0]) if files else None
        for keys, texts in text_batches(batches):
            hit, at, found = compare_texts(texts, block)
            hits = [_ranges(hit[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(keys, pa.int64()),
                    "n_words": pa.array(np.diff(at), pa.int64()),
                    "hits": pa.array(hits, _HITS),
                    "items": pa.array([_names(ids) for ids in found], pa.list_(pa.string())),
                    "contaminated": pa.array([bool(x) for x in hits]),
                }
            )

    schema = (
        "doc_id long, n_words long, hits array<struct<start:long,end:long>>,"
        " items array<string>, contaminated boolean"
    )
    return pairs.mapInArrow(run, schema)


def _names(ids: set) -> list[str]:
    return sorted("" if i is None else str(i) for i in ids)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    span: int = SPAN,
    gram: int = GRAM,
    block_words: int = BLOCK_WORDS,
    text_col: str = "text",
) -> DataFrame:
    """Documents that share no span with the benchmark, with all their columns.

    Rows and edge cases as in ``find_contamination``; a null text stays.
    """
    folder = scratch_path(docs.sparkSession, "benchmark")
    blocks = index_benchmark(benchmark, folder, span, gram, block_words)
    files = [r["file"] for r in blocks.limit(2).collect()]
    if len(files) > 1:
        rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "documents")
        texts = rows.select(F.col("__row").alias("row"), F.col(text_col).cast("string").alias("text"))
        _, hits = _hits_by_join(texts, blocks, folder, span, gram)
        return rows.join(hits.select(F.col("row").alias("__row")), "__row", "left_anti").drop("__row")

    def clean(texts: list) -> np.ndarray:
        hit, at, _ = compare_texts(texts, _load(folder, files[0]) if files else None)
        total = np.concatenate([[0], np.cumsum(hit)])
        return total[at[1:]] == total[at[:-1]]

    return filter_rows(docs, text_col, clean)
