"""Packing of documents into windows by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, text_batches
from .tokens import END_ID, encoder

WINDOW = 2048
# Fill levels of a window, and the most windows that a partition holds open
LEVELS = 32
MAX_OPEN = 4096
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
    " sequence_id long, offset long"
)
_BATCH_CHARS = 1 << 20


class SquareSumPacker:
    """Online packing of one partition's documents.

    Fill levels are ``step`` tokens wide. ``counts[h]`` is the number of windows open at
    level ``h``. A document goes where the sum of the squared counts then is least:
    into a new window (its level gains one) or into one of level h (h loses one, the
    level reached gains one; a full window leaves the counts). Ties go to the fullest
    level. Where it would need another window at a level that has some, it is cut at the
    end of an open one, if that doesn't raise the sum: this window leaves the counts and the rest,
    which counts like a new window, is placed as a document of its own. Documents longer
    than a window fill whole windows first.

    When the partition ends, or more than ``max_open`` windows are open, these are
    laid end to end and cut anew, and what is left over at last is cut at powers
    of two, so that only whole and power-of-two windows exist. So no more than
    ``max_open`` windows of ids are held; by the rule a few dozen are open.

    A piece is ``(doc_id, doc_tokens, start, ids)``, ids as 4 bytes each.
    """

    def __init__(
        self, partition: int, window: int = WINDOW, max_open: int = MAX_OPEN, levels: int = LEVELS
    ):
        self.window = window
        self.max_open = max_open
        self.step = -(-window // levels)
        self.next_id = partition << 40
        self.counts = [0] * (window // self.step + 1)
        # (fill, pieces) of the open windows by level
        self.windows: list[list[tuple[int, list]]] = [[] for _ in self.counts]
        self.open = 0

    def place(self, size: int) -> int | None:
        """Level of the window that takes ``size`` tokens, or their first; None is a new one."""
        counts, step, window = self.counts, self.step, self.window
        best, least = None, 2 * counts[size // step] + 1
        cut, cut_least = None, 1
        for level in range(len(counts) - 1, -1, -1):
            have = counts[level]
            if not have:
                continue
            fill = self.windows[level][-1][0] + size
            after = fill % window // step
            if fill == window:
                change = 1 - 2 * have
            elif after == level:
                change = 0
            else:
                change = 2 - 2 * have + 2 * counts[after]
            if fill <= window:
                if change < least:
                    best, least = level, change
            elif change < cut_least:
                cut, cut_least = level, change
        return cut if least > 1 and cut is not None else best

    def add(self, piece: tuple) -> list[tuple]:
        """Rows ``(piece, sequence, offset)`` of the windows that this piece fills."""
        key, total, start, data = piece
        width, out = 4 * self.window, []
        while len(data) >= width:
            out += self._close([(key, total, start, data[:width])])
            start, data = start + self.window, data[width:]
        while data:
            level = self.place(len(data) // 4)
            fill, pieces = (0, []) if level is None else self.windows[level].pop()
            if level is not None:
                self.counts[level] -= 1
                self.open -= 1
            room = self.window - fill
            part, data = data[: 4 * room], data[4 * room :]
            pieces.append((key, total, start, part))
            start += len(part) // 4
            fill += len(part) // 4
            if fill == self.window:
                out += self._close(pieces)
                continue
            self.counts[fill // self.step] += 1
            self.windows[fill // self.step].append((fill, pieces))
            self.open += 1
        if self.open > self.max_open:
            for rows in self.finish():
                out += rows
        return out

    def _close(self, pieces: list) -> list[tuple]:
        offset, out = 0, []
        for piece in pieces:
            out.append((piece, self.next_id, offset))
            offset += len(piece[3]) // 4
        self.next_id += 1
        return out

    def _room(self, left: int) -> int:
        return min(self.window, 1 << (left.bit_length() - 1)) if left else 0

    def finish(self) -> Iterator[list[tuple]]:
        """Close the open windows, the fullest first; the rows of each window made."""
        left = sum(fill for held in self.windows for fill, _ in held)
        filled, room = [], self._room(left)
        for level in range(len(self.windows) - 1, -1, -1):
            for _, pieces in self.windows[level]:
                for key, total, start, data in pieces:
                    while data:
                        part = data[: 4 * room]
                        filled.append((key, total, start, part))
                        n = len(part) // 4
                        start, data, room, left = start + n, data[4 * n :], room - n, left - n
                        if not room:
                            yield self._close(filled)
                            filled, room = [], self._room(left)
            self.windows[level] = []
        self.counts = [0] * len(self.counts)
        self.open = 0


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    levels: int = LEVELS,
    max_open: int = MAX_OPEN,
) -> DataFrame:
    """Pieces of documents and their places in windows of ``window`` tokens.

    One row per piece, see ``PIECES``; ``with_ids`` adds ``ids``, the piece's
    ids as little-endian unsigned 32-bit binary. Every partition of ``docs`` is
    packed on its own, without a shuffle; it holds the pieces of the windows
    that are open, never texts or ids of closed ones. Windows are full, or hold
    a power of two tokens (at most ``log2(window)`` of those a partition), so
    none needs padding.

    A null or empty text is the end id alone. Null and repeated document ids
    stay as they are: each row is a document. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = SquareSumPacker(TaskContext.get().partitionId(), window, max_open, levels)
        enc = encoder(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for keys, texts in text_batches(batches, _BATCH_CHARS):
            rows = []
            for key, data in zip(keys, enc.encode(texts), strict=True):
                data += end
                rows += packer.add((key, len(data) // 4, 0, data))
            yield _rows(rows, with_ids)
        for rows in packer.finish():
            yield _rows(rows, with_ids)

    schema = PIECES + (", ids binary" if with_ids else "")
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    ids = [piece[3] for piece, _, _ in rows]
    cols = {
        "doc_id": [piece[0] for piece, _, _ in rows],
        "start": [piece[2] for piece, _, _ in rows],
        "length": [len(data) // 4 for data in ids],
        "ids_crc32": list(map(zlib.crc32, ids)),
        "doc_tokens": [piece[1] for piece, _, _ in rows],
        "sequence_id": [key for _, key, _ in rows],
        "offset": [offset for _, _, offset in rows],
    }
    arrays = {name: pa.array(values, pa.int64()) for name, values in cols.items()}
    if with_ids:
        arrays["ids"] = pa.array(ids, pa.binary())
    return pa.RecordBatch.from_pydict(arrays)
