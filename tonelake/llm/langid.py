"""Language of texts by Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import filter_rows, id_and_text, mix, text_batches

ORDER = 4
UNKNOWN = "und"
# Bounds of the fit: about so many texts a language, so many languages, and model
# cells (n-grams of the highest order times languages).
SAMPLE_TEXTS = 1500
MAX_LANGUAGES = 256
MAX_CELLS = 1 << 24
# A text is rejected if its cross-entropy is so many bits, and so many deviations more,
# over its language's mean: passages of another language or repeated words stay below.
MARGIN_BITS = 1.5
DEVIATIONS = 8.0
_BITS = np.uint64(16)
_PIECE = 1 << 18
_SPACE = 32
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(1 << 16)]))
    return _letters[0]


def letter_codes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts in a row, and where each begins (one entry more than texts).

    Lower-case letters and, for any run of other characters after a letter, one
    space. A code has 16 bits; the rest of Unicode shares the last one.
    """
    line = "\0".join(t.replace("\0", " ").lower() if t else "" for t in texts)
    wide = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
    high = wide > 0xFFFF
    codes = np.minimum(wide, 0xFFFF).astype(np.uint64)
    letter = _letter_table()[codes.astype(np.int64)]
    if high.any():
        values, back = np.unique(wide[high], return_inverse=True)
        letter[high] = np.array([chr(c).isalpha() for c in values.tolist()])[back]
    parts = wide == 0
    gap = ~letter & ~parts
    keep = letter.copy()
    keep[1:] |= gap[1:] & letter[:-1]
    codes[gap] = _SPACE
    place = np.concatenate([[0], np.cumsum(keep)])
    ends = np.append(np.flatnonzero(parts), len(wide))
    return codes[keep], np.concatenate([[0], place[ends]])


def _keys(codes: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Each code with the ``order - 1`` before it in one integer; spaces before a text."""
    depth = np.arange(len(codes)) - np.repeat(at[:-1], np.diff(at))
    key = codes.copy()
    for back in range(1, order):
        before = np.full(len(codes), np.uint64(_SPACE))
        before[back:] = codes[:-back] if back < len(codes) else codes[:0]
        before[depth < back] = _SPACE
        key |= before << (np.uint64(back) * _BITS)
    return key


class HashTable:
    """Keys by their hashes in ascending order; an index of the hashes' first bits."""

    def __init__(self, keys: np.ndarray):
        hashes = mix(keys.astype(np.uint64))
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        bits = max(1, min(24, int(len(keys)).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        edges = np.arange((1 << bits) + 1, dtype=np.float64) * 2.0 ** (64 - bits)
        self.first = np.searchsorted(self.hashes, edges[:-1].astype(np.uint64)).astype(np.int32)
        self.first = np.append(self.first, np.int32(len(keys)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the sorted arrays, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.hashes):
            return out
        hashes = mix(keys)
        slot = (hashes >> self.shift).astype(np.int64)
        place, end = self.first[slot], self.first[slot + 1]
        left = np.flatnonzero(place < end)
        place, end, hashes = place[left], end[left], hashes[left]
        while len(left):
            same = self.hashes[place] == hashes
            out[left[same]] = place[same]
            on = ~same & (place + 1 < end)
            left, place, end, hashes = left[on], place[on] + 1, end[on], hashes[on]
        return out


@dataclass
class LanguageModel:
    """Interpolated Kneser-Ney models of all languages over shared tables.

    For each order, ``grams`` finds an n-gram that some language has, with the
    log2 probability of its last character in every language, smoothing done;
    ``contexts`` finds a context, with log2 of the weight its language leaves to
    the order below.
    """

    languages: list[str]
    grams: list[tuple[HashTable, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[HashTable, np.ndarray]] = field(default_factory=list)
    floor: float = -16.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    per_char: np.ndarray | None = None

    @classmethod
    def fit(cls, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> LanguageModel:
        """From each language's n-grams of the highest order and their counts."""
        model = cls(languages)
        levels = []  # by language: from the highest order down, (keys, counts)
        for keys, count in counts:
            keys, count = keys.astype(np.uint64), count.astype(np.float64)
            own = [(keys, count)]
            for n in range(order - 1, 0, -1):
                # continuation counts: how many different characters precede it
                suffix = own[-1][0] & np.uint64((1 << (16 * n)) - 1)
                kinds, times = np.unique(suffix, return_counts=True)
                own.append((kinds, times.astype(np.float64)))
            levels.append(own[::-1])
        letters = len(np.unique(np.concatenate([own[0][0] for own in levels]))) + 1
        model.floor = -float(np.log2(letters))
        lower: tuple[np.ndarray, np.ndarray] | None = None
        for n in range(1, order + 1):
            every = np.unique(np.concatenate([own[n - 1][0] for own in levels]))
            outer = np.unique(every >> _BITS)
            prob = np.zeros((len(every), len(languages)))
            weight = np.ones((len(outer), len(languages)))
            context = np.searchsorted(outer, every >> _BITS)
            if lower is None:
                below = np.full(prob.shape, 1 / letters)
            else:
                below = lower[1][np.searchsorted(lower[0], every & np.uint64((1 << (16 * (n - 1))) - 1))]
            for k, own in enumerate(levels):
                keys, count = own[n - 1]
                ones, twos = (count == 1).sum(), (count == 2).sum()
                cut = ones / (ones + 2 * twos) if ones and twos else 0.5
                at = np.searchsorted(every, keys)
                total = np.bincount(context[at], count, len(outer))
                kinds = np.bincount(context[at], minlength=len(outer))
                seen = total > 0
                weight[seen, k] = cut * kinds[seen] / total[seen]
                prob[at, k] = np.maximum(count - cut, 0) / total[context[at]]
            prob += weight[context] * below
            lower = (every, prob)
            table, parts = HashTable(every), HashTable(outer)
            model.grams.append((table, np.log2(prob).astype(np.float32)[table.order]))
            model.contexts.append((parts, np.log2(weight).astype(np.float32)[parts.order]))
        return model

    def surprise(self, keys: np.ndarray) -> np.ndarray:
        """Log2 probability of each key's last character, a column per language."""
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        left = np.arange(len(keys))
        for n in range(len(self.grams), 0, -1):
            table, prob = self.grams[n - 1]
            place = table.find(keys)
            hit = place >= 0
            out[left[hit]] += prob[place[hit]]
            left, keys = left[~hit], keys[~hit]
            if not len(left):
                return out
            parts, weight = self.contexts[n - 1]
            place = parts.find(keys >> _BITS)
            known = place >= 0
            out[left[known]] += weight[place[known]]
            keys = keys & np.uint64((1 << (16 * (n - 1))) - 1)
        out[left] += self.floor
        return out

    def entropies(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of every text in every language, and the characters."""
        codes, at = letter_codes(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        size = np.diff(at)
        for start in range(0, len(codes), _PIECE):
            stop = min(len(codes), start + _PIECE)
            # the codes before a piece are its first contexts
            lead = min(start, ORDER - 1)
            inner = np.clip(at, start - lead, stop) - (start - lead)
            piece = self.surprise(_keys(codes[start - lead : stop], inner, len(self.grams)))
            total = np.concatenate([np.zeros((1, piece.shape[1])), np.cumsum(piece[lead:], axis=0, dtype=np.float64)])
            cut = np.clip(at, start, stop) - start
            sums -= total[cut[1:]] - total[cut[:-1]]
        return sums / np.maximum(size, 1)[:, None], size

    def calibrate(self, entropy: np.ndarray, size: np.ndarray) -> None:
        """Learn each language's usual cross-entropy from texts that were not counted."""
        k = len(self.languages)
        self.mean, self.spread, self.per_char = np.full(k, np.inf), np.zeros(k), np.zeros(k)
        best = entropy.argmin(1)
        for n in range(k):
            own = (best == n) & (size > 0)
            if own.sum() < 8:
                continue  # too few to judge: nothing is rejected
            h, m = entropy[own, n], size[own]
            self.mean[n] = np.average(h, weights=m)
            self.per_char[n] = np.mean((h - self.mean[n]) ** 2 * np.minimum(m, 200))
            self.spread[n] = np.mean((h[m >= np.median(m)] - self.mean[n]) ** 2)

    def predict(self, texts: list) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, whether rejected, and cross-entropy of each text.

        The score is the probability of the language among all, from the
        cross-entropies over the text's length, at most 50 characters of it.
        """
        if not self.languages:
            size = np.diff(letter_codes(texts)[1])
            none = np.zeros(len(texts))
            return [UNKNOWN] * len(texts), none, size == 0, none
        entropy, size = self.entropies(texts)
        best = entropy.argmin(1)
        bits = entropy[np.arange(len(texts)), best]
        weight = np.exp2(-(entropy - bits[:, None]) * np.minimum(size, 50)[:, None])
        score = np.where(size > 0, 1 / weight.sum(1), 0.0)
        rejected = size == 0
        if self.mean is not None:
            margin = self.spread[best] + self.per_char[best] / np.maximum(size, 1)
            rejected = rejected | (
                bits > self.mean[best] + MARGIN_BITS + DEVIATIONS * np.sqrt(margin)
            )
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), size.tolist(), strict=True)]
        return names, score, rejected, np.where(size > 0, bits, 0.0)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows never learned from: crc32 of the id as text is 0 modulo ``folds``; null is ''."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == 0


def train_language_model(
    docs: DataFrame,
    sample_texts: int = SAMPLE_TEXTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """Fit on the rows with text and language that are not held out.

    A classifier's bounded sample: about ``sample_texts`` different whole texts of each
    language (chosen by a hash of the text; copies of one count once), nine tenths of
    them counted, one tenth for calibration. N-grams are counted in tasks and added up by Spark; what
    reaches the driver is the counts, of each language its most frequent ones up to ``MAX_CELLS``
    divided by the square of the number of languages, whatever other languages hold, and
    calibration rows. At most ``MAX_LANGUAGES`` languages, the most frequent. No rows give a model
    without languages; null texts and languages, and repeated rows, need no care.
    """
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    usable = docs.filter(F.col(lang_col).isNotNull() & text.isNotNull() & ~held_out(id_col)).select(
        lang.alias("lang"), text.alias("text"), F.xxhash64(text, F.lit("sample")).alias("draw")
    )
    counts = usable.groupBy("lang").agg(
        F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("draw", 0.02).alias("texts")
    )
    top = counts.orderBy(F.desc("rows"), "lang").limit(MAX_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in top)
    if not languages:
        return LanguageModel([])
    share = {r["lang"]: min(1.0, sample_texts / max(r["texts"], 1)) for r in top}
    chances = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    drawn = F.pmod(F.col("draw"), F.lit(1_000_000)) / 1_000_000 < chances[F.col("lang")]
    # texts are cut down before the shuffle, where copies meet
    sample = materialize(
        usable.filter(drawn)
        .groupBy("lang", "draw", F.xxhash64("text").alias("calibration"))
        .agg(F.first("text").alias("text"))
        .select("lang", "text", (F.pmod("calibration", F.lit(10)) == 0).alias("calibrates")),
        "language-sample",
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, texts in text_batches(batches):
            for name in set(names):
                codes, at = letter_codes([t for n, t in zip(names, texts, strict=True) if n == name])
                keys, times = np.unique(_keys(codes, at, ORDER), return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([name] * len(keys), pa.string()), "gram": keys.view(np.int64), "n": times}
                )

    most = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    grams = (
        sample.filter(~F.col("calibrates"))
        .select("lang", "text")
        .mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("place", F.row_number().over(most))
        .filter(F.col("place") <= max(1, MAX_CELLS // len(languages) ** 2))
        .drop("place")
        .toArrow()
    )
    lang, key, n = (np.array(grams.column(c)) for c in ("lang", "gram", "n"))
    languages = [x for x in languages if (lang == x).any()]
    if not languages:
        return LanguageModel([])
    found = []
    for name in languages:
        own = key[lang == name].view(np.uint64)
        order = np.argsort(own)
        found.append((own[order], n[lang == name][order]))
    model = LanguageModel.fit(languages, found)
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches):
            entropy, size = spread.value.entropies(texts)
            yield pa.RecordBatch.from_pydict(
                {"entropy": pa.array(entropy.tolist(), pa.list_(pa.float64())), "size": pa.array(size, pa.int64())}
            )

    rows = (
        sample.filter("calibrates").select("lang", "text").mapInArrow(judge, "entropy array<double>, size long").toArrow()
    )
    if rows.num_rows:
        model.calibrate(np.array(rows["entropy"].to_pylist()), np.array(rows["size"]))
    return model


def detect_language(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Language of every whole text: ``doc_id, lang_pred, score, rejected, bits_per_char``.

    Texts that are null or have no letter are ``und`` with score 0, and rejected.
    Other texts get the language of least cross-entropy per character (ties: the
    first by name), and are rejected if it lies far above what is usual for that
    language and length. A model without languages says ``und`` and rejects only
    texts without letters. One row per row, in one pass without a shuffle; the model, of
    bounded size, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_batches(batches):
            names, score, rejected, bits = shared.value.predict(texts)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(keys, pa.int64()),
                    "lang_pred": names,
                    "score": score,
                    "rejected": rejected,
                    "bits_per_char": bits,
                }
            )

    schema = "doc_id long, lang_pred string, score double, rejected boolean, bits_per_char double"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def keep_known_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The documents that ``detect_language`` doesn't reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_rows(docs, text_col, lambda texts: ~shared.value.predict(texts)[2])
