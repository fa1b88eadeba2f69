"""Token ids of texts by a public tokenizer file, each distinct word encoded once."""

from __future__ import annotations

import os
import re

import numpy as np

END_ID = 1
CACHE_WORDS = 800_000
_GAP = re.compile(r"[ \t\r\n]+")
# a word of Latin letters, each a code point of its own, and the signs after it
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!#$%&()*,./:;?]*)")
# Bytes from 128 on that byte-level models write as another character than that of their number
_BYTE_LEVEL = {b: 162 + b for b in range(128, 161)} | {173: 323}
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes.

    This kind of tokenizer splits at white space and drops it, so a text's ids
    are the ids of its pieces between white space, one after the other; nor does
    a token join a letter with the signs after it. Each distinct piece is encoded
    by the library once and remembered, up to ``CACHE_WORDS`` in two generations: when
    the younger is full the older goes, with the words that weren't met since. Plain words need
    no rules of normalisation but lower case, so they go to the model at once, as the characters
    that stand for their bytes; signs after a word are a piece of their own.
    Strings of special tokens in a text are read as the library reads them.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, key in self.tokenizer.get_vocab().items():
            self.last[key] = token.endswith("</w>")
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        probe = ["ab", "éàņ", ".##)"]
        if self._ids(["ab éàņ.##)"])[0] != b"".join(self._ids(probe)) or self._plain(
            probe[:2]
        ) != self._ids(probe[:2]):
            raise ValueError("this tokenizer keeps white space; its texts can't be cut into words")

    def _ids(self, pieces: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in done]

    def _plain(self, words: list[str]) -> list[bytes]:
        """Lower-case plain words in one line; each ends at a word-end token."""
        line = " ".join(words)
        if not line.isascii():
            line = line.encode().decode("latin-1").translate(_BYTE_LEVEL)
        line = self.bare.encode_batch_fast([line], add_special_tokens=False)[0]
        ids = np.array(line.ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._ids(words)
        data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, pieces: list[str]) -> None:
        known = self.known
        plain, rest = [], []
        for piece in pieces:
            match = _PLAIN.fullmatch(piece)
            if match:
                plain.append((piece, match[1].lower(), match[2]))
            else:
                rest.append(piece)
        words = list({word for _, word, _ in plain if word not in known})
        rest += {signs for _, _, signs in plain if signs not in known}
        for group, how in ((words, self._plain), (rest, self._ids)):
            for i in range(0, len(group), 512):
                part = group[i : i + 512]
                known.update(zip(part, how(part), strict=True))
        for piece, word, signs in plain:
            known[piece] = known[word] + known[signs]

    def _pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return _GAP.split(text)  # str.split() takes these for white space
        return text.split()

    def encode(self, texts: list) -> list[bytes]:
        """Ids of each text; null has none. Give a bounded batch at a time."""
        pieces = [self._pieces(text) for text in texts]
        new = set().union(*pieces).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS // 2:
            new = set().union(*pieces)
            self.known, self.older = {"": b""}, self.known
        known, older = self.known, self.older
        for piece in new & older.keys():
            known[piece] = older[piece]
        self._learn([piece for piece in new if piece not in known])
        return [b"".join(map(known.__getitem__, p)) for p in pieces]


def encoder(path: str) -> WordEncoder:
    """One per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
