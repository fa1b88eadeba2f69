"""Replacement of the entries of a table in text: one pass, leftmost, longest."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Mapping
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as lx

# Set around matches for a moment; no character, so no text has it.
MARK = "\uFDD0"
_PAIR, _NEXT = "\x1e", "\x1f"
MAX_ENTRIES = 20_000
JOIN_VARIANT = "\uFE0F"


def _char(c: str) -> str:
    return f"\\x{{{ord(c):X}}}"


def _char_class(chars: Iterable[str]) -> str:
    """The characters as a class of ranges."""
    codes, parts = sorted(map(ord, chars)), []
    for code in codes:
        if parts and parts[-1][1] == code - 1:
            parts[-1][1] = code
        else:
            parts.append([code, code])
    return "[" + "".join(_char(chr(a)) + (f"-{_char(chr(b))}" if b > a else "") for a, b in parts) + "]"


def _told_first(chars: Iterable[str]) -> str:
    """A look ahead for one of the ASCII characters among ``chars``, or any other than ASCII."""
    low = "".join(_char(c) for c in sorted(set(chars)) if ord(c) < 0x80)
    return f"(?=[{low}\\x{{80}}-\\x{{10FFFF}}])"


def trie_pattern(phrases: Iterable[str], after_each: str = "") -> str:
    """A pattern that takes the longest of the phrases that begins at a place.

    Phrases with a common beginning share it, so a place is tried once for each character and not once
    for each phrase. ``after_each`` may follow any character.
    """
    root: dict = {}
    for phrase in phrases:
        node = root
        for c in phrase:
            node = node.setdefault(c, {})
        node[""] = {}

    def of(node: dict) -> str:
        ends = [c for c, child in node.items() if c and set(child) == {""}]
        parts = [
            _char(c) + after_each + "(?:" + of(child) + ")" + ("?" if "" in child else "")
            for c, child in sorted(node.items())
            if c and set(child) != {""}
        ]
        if ends:
            parts.append(_char_class(ends) + after_each)
        return "|".join(parts)

    return of(root)


def as_map(table: Mapping[str, str]) -> Column:
    """A table as a constant map column."""
    return F.str_to_map(F.lit(map_text(table)), F.lit(_NEXT), F.lit(_PAIR))


def map_text(table: Mapping[str, str]) -> str:
    return _NEXT.join(f"{k}{_PAIR}{v}" for k, v in table.items())


def swap(text: Column, pattern: str, render: Callable[[Column], Column]) -> Column:
    """``text`` with each match as ``render`` gives it; a match it gives null for stays."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK)
    return F.array_join(
        F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.coalesce(render(p), p)).otherwise(p)), ""
    )


def read_phrases(table: DataFrame, phrase: str, name: str, limit: int = MAX_ENTRIES) -> dict[str, str]:
    """A lexicon table of two columns as a dictionary; of more than ``limit`` rows it is refused.

    Rows with a null or empty phrase or a null name are left out; of several names the least counts.
    """
    rows = (
        table.filter(F.length(phrase) > 0).groupBy(phrase).agg(F.min(name)).limit(limit + 1).collect()
    )
    if len(rows) > limit:
        raise ValueError(f"a lexicon has {limit} entries at most")
    return {key: value for key, value in rows if value is not None}


# --- emoji ----------------------------------------------------------------------


@cache
def emoji_names() -> dict[str, str]:
    """Names by rule: the Unicode name in small letters, but for those in the seed table.

    Of one code point from the emoji blocks, and keycaps.
    """
    names = {}
    for first, last in lx.EMOJI_BLOCKS:
        for code in range(first, last + 1):
            name = unicodedata.name(chr(code), "")
            if name:
                names[chr(code)] = name.lower().replace(" ", "_")
    names |= {c + "\u20E3": f"keycap_{c}" for c in "0123456789#*"}
    return names | lx.EMOJI_NAMES | lx.SKIN_TONES


@cache
def _emoji_parts(entries: tuple[tuple[str, str], ...]) -> tuple[str, str, dict[str, str]]:
    """What a row must hold, the pattern of all sequences, and their names."""
    names = {k.replace(JOIN_VARIANT, ""): v for k, v in entries}
    names.pop("", None)
    variant = f"{_char(JOIN_VARIANT)}?"
    tones = _char_class(lx.SKIN_TONES)
    # a class of many ranges is slow to refuse a character, and most are of ASCII: these are told first
    held = {k[0] if ord(k[0]) > 0x7F else k[-1] for k in names}
    needs = _told_first(held) + _char_class(held) if names else "(?!)"
    whole = (
        f"{_told_first(k[0] for k in names)}(?:{trie_pattern(names, variant)})(?:{tones}{variant})?"
        if names else "(?!)"
    )
    return needs, whole, names


def emoji_parts(lexicon: Mapping[str, str] | None = None) -> tuple[str, str, dict[str, str]]:
    return _emoji_parts(tuple(sorted((emoji_names() if lexicon is None else lexicon).items())))


# --- contractions -----------------------------------------------------------------


@cache
def contraction_table() -> dict[str, str]:
    """Contractions by rule, irregular ones and slang; keys in small letters."""
    table = dict(lx.ENDINGS)
    table |= {f"{w}'s": f"{w} is" for w in lx.IS_AFTER}
    table |= {f"{stem}nt": f"{stem} not" for stem in lx.BARE_NOT_STEMS}
    return table | lx.IRREGULAR_CONTRACTIONS | lx.SLANG


@cache
def contraction_patterns(entries: tuple[tuple[str, str], ...]) -> tuple[str, str]:
    """Patterns of all entries, and of those without an apostrophe."""
    table = dict(entries)
    words = [k for k in table if k not in lx.ENDINGS]

    def of(keys: list[str]) -> str:
        first = "".join(sorted({k[0] for k in keys if k[0].isalpha()}))
        inside = trie_pattern(keys)
        return rf"(?:\b(?=[{first}])(?:{inside})\b)" if first else "(?!)"

    lead = [k for k in words if not k[0].isalpha()]
    ends = [k for k in table if k in lx.ENDINGS]
    parts = [of([k for k in words if k[0].isalpha()])]
    if lead:
        parts.append(rf"(?:(?<![A-Za-z])(?:{trie_pattern(lead)})\b)")
    if ends:
        parts.append(rf"(?:(?:{trie_pattern(ends)})\b)")
    bare = [k for k in words if "'" not in k and k[0].isalpha()]
    return "(?i)" + "|".join(parts), "(?i)" + (of(bare) if bare else "(?!)")
