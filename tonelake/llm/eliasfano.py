"""Elias-Fano coding of ascending integers, with a select index."""

from __future__ import annotations

import struct

import numpy as np

# Every so manieth one-bit of the upper part has its position stored.
SAMPLE = 256
_HEAD = struct.Struct("<QQqBI")  # count, upper bytes, smallest, low bits, samples


class EliasFano:
    """``values[i]`` of an ascending sequence, in about 2 + log2(span / n) bits each.

    The low bits of each value lie packed side by side; the rest, counted up in
    unary, is a bit string with a one for each value. The i-th value's upper part
    is the position of the i-th one (select) less i. A position is stored for
    every ``SAMPLE``-th one in 32 bits (a file holds fewer than 2**31 values), so a
    select looks at a short stretch only.
    """

    def __init__(self, count: int, least: int, width: int, low: bytes, high: bytes, marks: np.ndarray):
        self.count, self.least, self.width = count, least, width
        self.low, self.high, self.marks = low, high, marks

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, 0, b"", b"", np.empty(0, "<u4"))
        if (values[1:] < values[:-1]).any():
            raise ValueError("values must ascend")
        least = int(values[0])
        rest = values.astype(np.uint64) - np.uint64(least % (1 << 64))
        width = max(0, (int(rest[-1]) // n).bit_length() - 1)
        low = _pack(rest & np.uint64((1 << width) - 1), width)
        ones = (rest >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, least, width, low, np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.count, len(self.high), self.least, self.width, len(self.marks))
        return head + self.marks.astype("<u4").tobytes() + self.high + self.low

    @classmethod
    def from_bytes(cls, data: bytes | memoryview, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence stored at ``at``, and where it ends."""
        count, upper, least, width, samples = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        marks = np.frombuffer(data, "<u4", samples, at)
        at += 4 * samples
        high = bytes(data[at : at + upper])
        at += upper
        size = (count * width + 7) // 8
        return cls(count, least, width, bytes(data[at : at + size]), high, marks), at + size

    def select(self, i: int) -> int:
        """The i-th value, from the nearest stored position on."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        at = int(self.marks[i // SAMPLE])
        left = i % SAMPLE
        while left:  # the left-th one after position at
            first = (at + 1) // 8
            piece = np.frombuffer(self.high, np.uint8, min(512, len(self.high) - first), first)
            ones = first * 8 + np.flatnonzero(np.unpackbits(piece, bitorder="little"))
            ones = ones[ones > at]
            if len(ones) >= left:
                at, left = int(ones[left - 1]), 0
            else:
                left -= len(ones)
                at = first * 8 + 8 * len(piece) - 1
        return ((at - i) << self.width) + self._low(i) + self.least

    def _low(self, i: int) -> int:
        start = i * self.width
        stop = start + self.width
        piece = int.from_bytes(self.low[start // 8 : (stop + 7) // 8], "little")
        return (piece >> (start % 8)) & ((1 << self.width) - 1)

    def stretch(self, first: int, stop: int) -> np.ndarray:
        """Values ``first`` to ``stop - 1`` by one select: from the stored position before the first on."""
        if not 0 <= first <= stop <= self.count:
            raise IndexError((first, stop))
        if first == stop:
            return np.empty(0, np.int64)
        mark = first // SAMPLE
        begin = int(self.marks[mark])
        after = (stop - 1) // SAMPLE + 1
        end = int(self.marks[after]) if after < len(self.marks) else 8 * len(self.high)
        piece = np.frombuffer(self.high, np.uint8, (end + 7) // 8 - begin // 8, begin // 8)
        ones = np.flatnonzero(np.unpackbits(piece, bitorder="little")) + begin // 8 * 8
        ones = ones[np.searchsorted(ones, begin) :][first - mark * SAMPLE : stop - mark * SAMPLE]
        upper = (ones - np.arange(first, stop)).astype(np.uint64) << np.uint64(self.width)
        total = upper + _unpack(self.low, self.width, first, stop)
        return (total + np.uint64(self.least % (1 << 64))).astype(np.int64)

    def values(self) -> np.ndarray:
        """All values in order."""
        return self.stretch(0, self.count)


# Values packed at once; a multiple of 8, so that each piece ends with a byte
_PIECE = 1 << 16


def _pack(values: np.ndarray, width: int) -> bytes:
    shifts = np.arange(width, dtype=np.uint64)
    out = []
    for at in range(0, len(values) if width else 0, _PIECE):
        bits = ((values[at : at + _PIECE, None] >> shifts) & np.uint64(1)).astype(np.uint8)
        out.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(out)


def _unpack(data: bytes, width: int, first: int, stop: int) -> np.ndarray:
    out = np.zeros(stop - first, np.uint64)
    weights = np.uint64(1) << np.arange(width, dtype=np.uint64)
    for at in range(first, stop if width else first, _PIECE):
        upto = min(stop, at + _PIECE)
        begin = at * width
        piece = np.frombuffer(data, np.uint8, (upto * width + 7) // 8 - begin // 8, begin // 8)
        bits = np.unpackbits(piece, bitorder="little")[begin % 8 :][: (upto - at) * width]
        out[at - first : upto - first] = bits.reshape(upto - at, width).astype(np.uint64) @ weights
    return out
