"""Spelling variants: words one edit apart, by dense tiles of padded code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import hot_join

MIN_LENGTH = 5
MIN_COUNT = 3
# A form is used at least so many times as often as its variant.
RATIO = 2
WORD = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words of a tile's side, code points of one, and words that one task compares with each other
TILE = 256
TILE_CELLS = 1 << 20
BLOCK = 4096


def word_counts(
    docs: DataFrame,
    damage_every: int | None = None,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``word, n``: runs of letters of U+0041 to U+00FF in whole texts, A-Z as a-z.

    With ``damage_every`` a run whose crc32 of ``id:run`` it divides loses the code point at
    that crc modulo its length (a null id is empty there). Words that are then shorter than
    ``min_length`` code points or rarer than ``min_count`` are left out. A null or empty text has no
    words; each row counts, repeated ones too; an empty table gives no rows. Counted
    before the shuffle, so a frequent word is one row a task.
    """
    runs = docs.select(
        F.col(id_col).cast("string").alias("id"),
        F.explode(
            F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER), F.lit(WORD), 0)
        ).alias("run"),
    )
    word = F.col("run")
    if damage_every:
        crc = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run"))
        at = (F.col("crc") % F.length("run") + 1).cast("int")
        runs = runs.withColumn("crc", crc)
        word = F.when(
            F.col("crc") % damage_every == 0, F.overlay("run", F.lit(""), at, F.lit(1))
        ).otherwise(word)
    return (
        runs.select(word.alias("word"))
        .filter(F.length("word") >= min_length)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count)
    )


def _padded(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points plus one, by column, aligned left and aligned right; 0 is padding."""
    points = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4") for w in words]
    left = np.zeros((len(words), width), np.uint32)
    right = np.zeros((len(words), width), np.uint32)
    for row, own in enumerate(points):
        left[row, : len(own)] = own
        left[row, : len(own)] += 1
        right[row, width - len(own) :] = left[row, : len(own)]
    if left.max(initial=0) < 1 << 16:
        left, right = left.astype(np.uint16), right.astype(np.uint16)
    return np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row of one block and each of another."""
    same = np.ones((a.shape[1], b.shape[1]), bool)
    out = np.zeros(same.shape, np.uint16 if len(a) < 1 << 16 else np.uint32)
    for column, other in zip(a, b, strict=True):
        same &= column[:, None] == other[None, :]
        if not same.any():
            break
        out += same
    return out


class Tiles:
    """Comparison of the words of some groups that share a longer length, side and cell."""

    def __init__(self, rows: list[tuple], longest: int, ends: bool):
        # rows: group, word, n, block
        self.longest, self.ends = longest, ends
        self.words = [r[1] for r in rows]
        self.counts = np.array([r[2] for r in rows], np.int64)
        self.group = np.array([r[0] for r in rows], np.int64)
        self.block = np.array([r[3] for r in rows], np.int64)
        self.full = np.array([len(w) == longest for w in self.words])

    def near(self, across: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (first before second) that differ by one edit; ``across`` marks groups of two blocks."""
        step = max(2, min(TILE, TILE_CELLS // max(self.longest, 1)))
        starts = range(0, len(self.words), step)
        sides = [_padded(self.words[i : i + step], self.longest) for i in starts]
        key, firsts, seconds = self.longest // 2, [], []
        for x, i in enumerate(starts):
            a = slice(i, i + step)
            for y in range(x, len(sides)):
                j = y * step
                b = slice(j, j + step)
                if self.group[a][-1] < self.group[j]:
                    break
                asked = self.group[a][:, None] == self.group[b][None, :]
                asked &= self.full[a][:, None] | self.full[b][None, :]
                asked &= (self.block[a][:, None] != self.block[b][None, :]) | ~across[a][:, None]
                if x == y:
                    asked = np.triu(asked, 1)
                if not asked.any():
                    continue
                before = _common(sides[x][0], sides[y][0])
                after = _common(sides[x][1][::-1], sides[y][1][::-1])
                hits = asked & (before + after >= self.longest - 1)
                if self.ends:  # those that begin alike are met there
                    hits &= before < key
                p, q = np.nonzero(hits)
                firsts.append(p + i)
                seconds.append(q + j)
        empty = np.empty(0, np.int64)
        return np.concatenate([empty, *firsts]), np.concatenate([empty, *seconds])

    def summary(self, across: np.ndarray) -> list[tuple]:
        """``(word, near words, largest count among them, the first such word)``."""
        p, q = self.near(across)
        if not len(p):
            return []
        p, q = np.concatenate([p, q]), np.concatenate([q, p])
        order = sorted(range(len(self.words)), key=lambda i: (-self.counts[i], self.words[i]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        best = np.full(len(order), len(order))
        np.minimum.at(best, p, rank[q])
        n = np.bincount(p, minlength=len(order))
        return [
            (self.words[i], int(n[i]), int(self.counts[order[best[i]]]), self.words[order[best[i]]])
            for i in np.flatnonzero(n).tolist()
        ]


_NEAR = pa.schema(
    [("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())]
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each word within its groups, from rows sorted by group."""

    def tiles() -> Iterator[tuple[tuple, list]]:
        kind, group, rows, number = None, None, [], 0
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for ends, longest, key, i, j, block, word, n in zip(*cols, strict=True):
                if (ends, longest, key, i, j) != group:
                    number += 1
                    # whole groups of one kind share a tile until it is full
                    if rows and (kind != (ends, longest) or len(rows) >= TILE):
                        yield kind, rows
                        rows = []
                    kind, group = (ends, longest), (ends, longest, key, i, j)
                rows.append((number, word, n, block, i != j))
        if rows:
            yield kind, rows

    out: list[tuple] = []
    for (ends, longest), rows in tiles():
        if len(rows) < 2:
            continue
        across = np.array([r[4] for r in rows])
        out += Tiles([r[:4] for r in rows], longest, ends).summary(across)
        if len(out) > 5000:
            yield _batch(out)
            out = []
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_NEAR)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _NEAR, strict=True)], schema=_NEAR
    )


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, n_near, best_n, best``: words one edit away, how many and the most used.

    ``words`` is a stored table ``(word, n)`` of distinct words. Of two words one inserted, deleted or
    replaced code point apart, M being the longer length, the common prefix and the common
    suffix reach M - 1 together, so one of them reaches half of M. So words are
    grouped by their first and by their last M // 2 code points, M being their own length
    or one more; groups are laid out as padded matrices of code points and compared tile by tile.
    A pair that shares both ends counts at its beginning. A group of more than ``block`` words is
    cut into blocks, each two of which are a task's work; nothing is left out. Pairs are
    summed up in the tile, so what is shuffled is a row for each word and tile.
    """
    def keyed(ends: bool, more: int):
        longest = F.length("word") + more
        half = F.floor(longest / 2).cast("int")
        key = F.right("word", half) if ends else F.left("word", half)
        return F.struct(F.lit(ends).alias("ends"), longest.alias("longest"), key.alias("key"))

    keys = F.array(*[keyed(ends, more) for ends in (False, True) for more in (0, 1)])
    rows = words.filter(F.length("word") > 0).select("word", "n", F.inline(keys))
    group = ["ends", "longest", "key"]
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block)
    sizes = sizes.select(*group, F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    rows = hot_join(rows, materialize(sizes, "large-groups"), group, ["word"], "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = rows.select(
        *group, F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"),
        "block", "word", "n",
    )
    cell = [*group, "i", "j"]
    cells = cells.repartition(*cell).sortWithinPartitions(*cell)
    found = cells.mapInArrow(_compare, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), first.alias("first"))
        .select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))
    )


def _roots(links: DataFrame) -> DataFrame:
    """``word, root``: the last form that is reached from each word that has one.

    Every round doubles the steps taken. Counts double at least from form to form, so there
    are no loops, and a handful of rounds.
    """
    up = links.select("word", F.col("form").alias("root"))
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = materialize(up.join(further, "root", "left").select("word", "root", "next"), "forms")
        if up.filter("next IS NOT NULL").isEmpty():
            return up.select("word", "root")
        up = up.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of a table ``(word, n)``.

    A word's ``form`` is the most used word one edit away (ties: the first in code-point order), if that is
    used ``ratio`` times as often or more, else null; ``root`` is where following forms ends,
    the word itself if it has none. ``n_near`` counts the words one edit away, 0 if there are none.
    Null words have no part, repeated ones are one word with their counts added up, an
    empty word has no form. An empty table gives no rows; other columns may have any name.
    """
    if ratio < 2:
        raise ValueError("a form must be used at least twice as often")
    words = words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(words, "words")
    near = near_words(words)
    form = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n"),
    )
    formed = materialize(formed, "word-forms")
    roots = _roots(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
