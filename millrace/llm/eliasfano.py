"""Elias-Fano lists of ascending numbers: 2 + log2(universe / n) bits each, with any single one at hand.

The low bits of each number stand side by side; what is above them is written in unary, one set bit a number, at bit
(high + rank).  The i-th number needs the i-th set bit: the place of every 256th is kept in 32 bits, and the bits behind it
are counted byte by byte from there.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
#: n, low bits, bytes of the low part, bytes of the unary part; the samples follow from n.
_HEAD = struct.Struct("<QQQQ")
#: Numbers whose bits are spread out at once.
_CHUNK = 1 << 16


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest `width` bits of each number, end to end, least significant first."""
    if not width:
        return np.zeros(0, np.uint8)
    places = np.arange(width, dtype=np.uint64)
    # A chunk is a multiple of eight numbers, so each but the last ends at a byte.
    parts = [np.packbits(((values[i : i + _CHUNK, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for i in range(0, len(values), _CHUNK)]
    return np.concatenate([*parts, np.zeros(0, np.uint8)])


def _unpacked(packed: np.ndarray, width: int, first: int, n: int) -> np.ndarray:
    """Numbers first to first + n of what _packed made."""
    out = np.zeros(n, np.uint64)
    if width:
        for i in range(0, n, _CHUNK):
            m = min(_CHUNK, n - i)
            at = (first + i) * width
            bits = np.unpackbits(packed[at >> 3 : (at + m * width + 7) >> 3], bitorder="little")[at & 7 : (at & 7) + m * width]
            out[i : i + m] = bits.reshape(m, width).astype(np.uint64) @ (np.uint64(1) << np.arange(width, dtype=np.uint64))
    return out


def encode(values: np.ndarray) -> bytes:
    """Ascending (not strictly) unsigned 64-bit numbers as bytes."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return _HEAD.pack(0, 0, 0, 0)
    if (values[1:] < values[:-1]).any():
        raise ValueError("the numbers must ascend")
    width = max(0, (int(values[-1]) // n).bit_length() - 1)
    places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    unary = np.zeros(int(places[-1]) + 1, np.uint8)
    unary[places] = 1
    if len(unary) >= 1 << 32:
        raise ValueError("too many numbers for one list")
    low, high = _packed(values, width), np.packbits(unary, bitorder="little")
    return _HEAD.pack(n, width, len(low), len(high)) + low.tobytes() + high.tobytes() + places[::SAMPLE].astype("<u4").tobytes()


class EliasFano:
    """A list that encode() made; the bytes are used as they are."""

    def __init__(self, raw: bytes) -> None:
        self.n, self.width, low, high = _HEAD.unpack_from(raw)
        at = _HEAD.size
        self._low = np.frombuffer(raw, np.uint8, low, at)
        self._high = np.frombuffer(raw, np.uint8, high, at + low)
        self._samples = np.frombuffer(raw, "<u4", -(-self.n // SAMPLE), at + low + high)
        self.size = at + low + high + 4 * len(self._samples)

    def __len__(self) -> int:
        return self.n

    def _select(self, i: int) -> int:
        """The place of set bit i."""
        place, left = int(self._samples[i // SAMPLE]), i % SAMPLE
        byte, skip = place >> 3, (0xFF << (place & 7)) & 0xFF
        while True:
            part = self._high[byte : byte + SAMPLE].copy()
            part[0] &= skip
            upto = np.cumsum(np.bitwise_count(part), dtype=np.int64)
            if left < upto[-1]:
                k = int(np.searchsorted(upto, left, side="right"))
                left -= int(upto[k - 1]) if k else 0
                return 8 * (byte + k) + int(np.flatnonzero(np.unpackbits(part[k : k + 1], bitorder="little"))[left])
            byte, left, skip = byte + len(part), left - int(upto[-1]), 0xFF

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return ((self._select(i) - i) << self.width) | int(_unpacked(self._low, self.width, i, 1)[0])

    def all(self) -> np.ndarray:
        """Every number, as unsigned 64-bit."""
        places = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[: self.n]
        return ((places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)) | _unpacked(self._low, self.width, 0, self.n)

    def first_not_below(self, value: int) -> int:
        """The rank of the first number that isn't below value; n if all are."""
        a, b = 0, self.n
        while a < b:
            m = (a + b) // 2
            if self[m] < value:
                a = m + 1
            else:
                b = m
        return a
