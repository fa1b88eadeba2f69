"""Secrets in texts: keyword automaton, anchored patterns, checksums."""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, text_batches

# Kinds in their order of listing; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
BASE = 3
# Fixed patterns, each matched at a place where its keyword begins.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
JWT_RUN = re.compile(r"eyJ[A-Za-z0-9_-]*")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
VALUE_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
# Keywords of hex runs: all strings of so many digits
HEX_STEP = 4
_UPPER = {c: c + 32 for c in range(65, 91)}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_built: list = []


def _automaton():
    """Keywords of all kinds; built once in each Python worker."""
    if not _built:
        import ahocorasick

        words = ahocorasick.Automaton()
        for word in ASSIGN_WORDS:
            words.add_word(word, (0, len(word)))
        words.add_word("akia", (1, 4))
        for digits in itertools.product("0123456789abcdef", repeat=HEX_STEP):
            words.add_word("".join(digits), (2, HEX_STEP))
        for letter in "pousr":
            words.add_word(f"gh{letter}_", (3, 4))
        words.add_word("npm_", (4, 4))
        words.add_word("eyj", (5, 3))
        words.make_automaton()
        _built.append(words)
    return _built[0]


def crc62(token: str) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of the random part."""
    body, check = token[4:-6], token[-6:]
    left, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        left, digit = divmod(left, 62)
        digits = _BASE62[digit] + digits
    return digits == check


def jwt_header(token: str) -> bool:
    """Whether the first part is a JSON object that names an algorithm."""
    part = token.split(".", 1)[0]
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):  # no JSON, or nested too deep to be a header
        return False
    return isinstance(head, dict) and "alg" in head


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of all secrets, sorted; code points, end exclusive.

    One pass of the automaton over the text in lower case (A-Z only, so places
    stay) tells where a pattern may begin; patterns are tried there alone. As each
    kind's keywords come in order, its matches are the leftmost that do not overlap,
    including those too short to be reported, which are dropped afterwards.
    """
    if not text:
        return []
    low = text.lower() if text.isascii() else text.translate(_UPPER)
    upto = [0] * len(KINDS)
    found = []
    for last, (kind, size) in _automaton().iter(low):
        start = last + 1 - size
        if start < upto[kind]:
            continue
        if kind == 0:
            match = ASSIGN.match(text, start)
            good = match and len(match[2]) >= VALUE_LENGTH
        elif kind == 1:
            match = ACCESS.match(text, start)
            good = match and match.end() - start >= ACCESS_LENGTH
        elif kind == 2:
            # a keyword inside a run only shows up first at its beginning
            match = HEX.match(text, start)
            good = match and match.end() - start >= HEX_LENGTH
        elif kind == 5:
            match = JWT.match(text, start)
            good = match and jwt_header(match[0])
            run = None if match else JWT_RUN.match(text, start)
            if run:  # what follows the run is no token's end for later starts in it either
                upto[kind] = run.end()
        else:
            match = (GITHUB if kind == 3 else NPM).match(text, start)
            good = match and crc62(match[0])
        if match:
            upto[kind] = match.end()
            if good:
                found.append((start, kind, match.end()))
    found.sort()
    return found


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every text: counts by kind and the spans.

    ``n_assign, n_access, n_hex`` (base kinds), ``n_checked`` (kinds with a
    checksum or a header that is validated), ``base_sha256`` over the base spans and
    ``spans`` of all, both as ``kind:start:end`` by start, then kind, with commas
    between. A null or empty text has none. One row per row; null and repeated ids
    stay, and an empty table gives no rows. A text of any length is scanned whole in time
    in proportion to its length. One narrow pass over the table, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_batches(batches):
            spans = [scan(text) for text in texts]
            said = [[f"{KINDS[k]}:{a}:{b}" for a, k, b in row] for row in spans]
            base = [[s for s, (_, k, _) in zip(x, row, strict=True) if k < BASE] for x, row in zip(said, spans, strict=True)]
            count = lambda kinds: [sum(k in kinds for _, k, _ in row) for row in spans]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(keys, pa.int64()),
                    "n_assign": pa.array(count({0}), pa.int64()),
                    "n_access": pa.array(count({1}), pa.int64()),
                    "n_hex": pa.array(count({2}), pa.int64()),
                    "base_sha256": [hashlib.sha256(",".join(b).encode()).hexdigest() for b in base],
                    "spans": [",".join(s) for s in said],
                    "n_checked": pa.array(count({3, 4, 5}), pa.int64()),
                }
            )

    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long,"
        " base_sha256 string, spans string, n_checked long"
    )
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
