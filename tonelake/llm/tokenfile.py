"""Files of token ids with Elias-Fano document boundaries."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import id_and_text, open_folder, text_batches
from .eliasfano import EliasFano
from .tokens import END_ID, encoder

MAGIC = b"TLIDS1\0\0"
# magic, bytes of an id, documents with a null id (they come first), documents, ids
_HEAD = struct.Struct("<8sIQQQ")
FILE_IDS = 1 << 24
FILE_DOCS = 1 << 20
# Documents whose places are selected at once when a file is read through
STRETCH = 4096
_BATCH_CHARS = 1 << 20

MANIFEST = pa.schema(
    [
        ("path", pa.string()), ("first_id", pa.int64()),
        ("part", pa.int64()), ("seq", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64()),
        ("bytes", pa.int64()),
    ]
)
READ = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()), ("ids", pa.binary()),
    ]
)


def file_bytes(doc_ids: list, lengths: np.ndarray, ids: bytes, width: int) -> bytes:
    """One file: header, boundaries, document ids, then the ids end to end.

    Boundaries are the first id's place of each document and the end; both they
    and the document ids ascend, so both are Elias-Fano coded.
    """
    known = [i for i in doc_ids if i is not None]
    head = _HEAD.pack(MAGIC, width, len(doc_ids) - len(known), len(doc_ids), len(ids) // width)
    bounds = EliasFano.build(np.concatenate([[0], np.cumsum(lengths)]))
    return head + bounds.to_bytes() + EliasFano.build(np.array(known, np.int64)).to_bytes() + ids


class TokenFile:
    """A file read back: ``doc_ids`` and, by select, any document's ids."""

    def __init__(self, data: bytes | memoryview):
        self.data = data
        magic, self.width, self.nulls, self.docs, self.ids = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.bounds, at = EliasFano.from_bytes(data, _HEAD.size)
        self.keys, self.at = EliasFano.from_bytes(data, at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.keys.select(i - self.nulls)

    def tokens(self, i: int) -> np.ndarray:
        start, end = self.bounds.select(i), self.bounds.select(i + 1)
        return self._ids(start, end)

    def _ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.data, f"<u{self.width}", end - start, self.at + self.width * start)

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(doc_id, first place, ids)`` of every document in order."""
        for first in range(0, self.docs, STRETCH):
            stop = min(self.docs, first + STRETCH)
            bounds = self.bounds.stretch(first, stop + 1).tolist()
            nulls = max(0, min(stop, self.nulls) - first)
            known = self.keys.stretch(max(0, first - self.nulls), max(0, stop - self.nulls)).tolist()
            keys = [None] * nulls + known
            for key, start, end in zip(keys, bounds[:-1], bounds[1:], strict=True):
                yield key, start, self._ids(start, end)


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    file_ids: int = FILE_IDS,
    file_docs: int = FILE_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode documents in ascending id order into files; gives their manifest.

    ``folder`` must be one that executors and driver share. Documents are sorted
    by range, so files hold ascending ids and follow each other; many documents of one id, or without, are
    shared out like others. A task closes a file when it has ``file_ids`` ids or ``file_docs`` documents
    or more, so it holds one file's ids at most, and one document's beside. Ids take 2 bytes each where the vocabulary allows it.
    A file is written under a name of its own attempt and only named in the
    manifest by the attempt that succeeds; the manifest is stored, so files are
    written once.

    A null or empty text is the end id alone. Null document ids come first;
    repeated ones stay, ordered by their texts' checksum. An empty table gives
    no files.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        enc = encoder(tokenizer)
        width = 2 if max(enc.tokenizer.get_vocab_size(), END_ID + 1) <= 1 << 16 else 4
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        keys, lengths, parts, size, seq = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal keys, lengths, parts, size, seq
            name = f"ids-{task.partitionId():06d}-{seq:06d}-{task.taskAttemptId()}.bin"
            data = file_bytes(keys, np.array(lengths, np.int64), b"".join(parts), width)
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            row = [name, next((k for k in keys if k is not None), None), task.partitionId(), seq, len(keys), size, len(data)]
            keys, lengths, parts, size, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_pylist(
                [dict(zip(MANIFEST.names, row, strict=True))], schema=MANIFEST
            )

        for ids, texts in text_batches(batches, _BATCH_CHARS):
            for key, data in zip(ids, enc.encode(texts), strict=True):
                tokens = np.append(np.frombuffer(data, "<u4"), np.uint32(END_ID))
                keys.append(key)
                lengths.append(len(tokens))
                parts.append(tokens.astype(f"<u{width}").tobytes())
                size += len(tokens)
                if size >= file_ids or len(keys) >= file_docs:
                    yield close()
        if keys:
            yield close()

    sums = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    ordered = id_and_text(docs, id_col, text_col).select(
        "doc_id", "text", sums.alias("sum"), F.monotonically_increasing_id().alias("row")
    )
    by = ["doc_id", "sum", "row"]
    ordered = ordered.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    schema = "path string, first_id long, part long, seq long, docs long, ids long, bytes long"
    manifest = materialize(ordered.mapInArrow(run, schema), "token-manifest")
    # one row a file
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumns(
        {
            "ids_before": F.coalesce(F.sum("ids").over(before), F.lit(0)),
            "docs_before": F.coalesce(F.sum("docs").over(before), F.lit(0)),
        }
    )


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """Every document of the files: id, place of its first id in all, ids and checksum.

    One task for each file at most; ``ids`` is unsigned 32-bit little-endian
    binary. Null document ids come back as null.
    """
    names = READ.names if with_ids else READ.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['path']}") as source:
                    data = memoryview(source.read())
                out: dict[str, list] = {name: [] for name in READ.names}
                held = 0
                for key, start, ids in TokenFile(data):
                    wide = ids.astype("<u4").tobytes()
                    values = (key, row["ids_before"] + start, len(ids), zlib.crc32(wide), wide)
                    for name, value in zip(READ.names, values, strict=True):
                        out[name].append(value)
                    held += len(wide)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pydict(out, READ).select(names)
                        out, held = {name: [] for name in READ.names}, 0
                yield pa.RecordBatch.from_pydict(out, READ).select(names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    schema += ", ids binary" if with_ids else ""
    files = manifest.select("path", "ids_before")
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, 1)
    return files.repartition(max(tasks, files.count())).mapInArrow(run, schema)


def token_file_round_trip(
    spark: SparkSession, docs: DataFrame, tokenizer: str, with_ids: bool = True, **options: object
) -> DataFrame:
    """Write documents to token files in the shared folder and read them back."""
    folder = scratch_path(spark, "token-files")
    manifest = write_token_files(docs, tokenizer, folder, **options)
    return read_token_files(manifest, folder, with_ids)
