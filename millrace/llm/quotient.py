"""Counting quotient filters over whole keys: sorted, compact, without loss.

A key of `bits` bits (and further 64-bit columns, if it is wider) is first sent through a one-to-one map of such keys, which
spreads keys evenly.  The high bits of the result, its quotient, aren't stored: one bit says that a quotient occurs, and one bit
closes the run of slots that belong to it.  A slot holds the rest of the result, the whole remainder, so the key can be had back.
A count above one follows in further slots, as digits, marked by a bit.  Slots stand in ascending order, so filters
of one kind merge as sorted lists do, and their counts add up.
"""

from __future__ import annotations

import struct
from itertools import pairwise

import numpy as np

#: Fixed odd multipliers of the map.
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_HEAD = "<BBBBQQQ"
Keys = tuple[np.ndarray, ...]


def permuted(keys: np.ndarray, bits: int) -> np.ndarray:
    """A one-to-one map of the numbers below 2^bits."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64(bits - bits // 2)
    for odd in _ODD:
        keys = (keys ^ (keys >> half)) * np.uint64(odd) & mask
    return keys ^ (keys >> half)


def restored(keys: np.ndarray, bits: int) -> np.ndarray:
    """What permuted() has mapped to keys: a shift by half the bits or more undoes itself, an odd factor has an inverse."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64(bits - bits // 2)
    keys = keys ^ (keys >> half)
    for odd in reversed(_ODD):
        keys = keys * np.uint64(pow(odd, -1, 1 << 64)) & mask
        keys = keys ^ (keys >> half)
    return keys


def added(keys: Keys, counts: np.ndarray | None = None) -> tuple[Keys, np.ndarray]:
    """Keys in ascending order, each once, with the sum of their counts (one each, if there are none)."""
    n = len(keys[0])
    if len(keys) == 1 and counts is None:
        keys = (np.sort(keys[0]),)
    elif n:
        order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])  # merges runs that are sorted already
        keys, counts = tuple(k[order] for k in keys), None if counts is None else counts[order]
    if not n:
        return keys, np.zeros(0, np.uint64)
    heads = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
    if counts is None:
        sums = np.diff(np.append(heads, n)).astype(np.uint64)
    else:
        sums = np.add.reduceat(counts, heads)
    return tuple(k[heads] for k in keys), sums


def encode(keys: Keys, counts: np.ndarray, bits: int) -> bytes:
    """A filter of mapped keys, ascending and each once; the first column has `bits` bits, the others 64."""
    n = len(counts)
    # About a quotient for every key, and remainders of whole bytes.
    width = min(8, max(1, -(-(bits - max(0, n.bit_length() - 1)) // 8)))
    left = max(0, bits - 8 * width)
    first = keys[0]
    more = counts - np.uint64(1)
    digits = np.zeros(n, np.int64)
    for k in range(-(-8 // width)):
        digits += (more >> np.uint64(8 * width * k) > 0) if 8 * width * k < 64 else 0
    place = np.arange(n) + np.concatenate([[0], np.cumsum(digits)[:-1]]).astype(np.int64) if n else digits
    slots = int(n + digits.sum())
    value, extension = np.zeros(slots, np.uint64), np.zeros(slots, np.uint8)
    mask = np.uint64((1 << (8 * width)) - 1)
    value[place] = first & mask
    for k in range(int(digits.max()) if n else 0):
        has = digits > k
        at = place[has] + 1 + k
        value[at], extension[at] = (more[has] >> np.uint64(8 * width * k)) & mask, 1
    quotient = (first >> np.uint64(8 * width)).astype(np.int64) if width < 8 else np.zeros(n, np.int64)
    ends = np.zeros(slots, np.uint8)
    last = np.flatnonzero(np.append(quotient[1:] != quotient[:-1], True)) if n else quotient
    ends[place[last] + digits[last]] = 1
    occupied = np.zeros(1 << left, np.uint8)
    occupied[quotient] = 1
    parts = [np.packbits(x, bitorder="little").tobytes() for x in (occupied, ends, extension)]
    remainders = value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return struct.pack(_HEAD, bits, width, left, len(keys) - 1, n, slots, 0) + b"".join(parts) + remainders + b"".join(k.astype("<u8").tobytes() for k in keys[1:])


class Filter:
    def __init__(self, raw: bytes) -> None:
        self.bits, self.width, self.left, self.more, self.n, self.slots, _ = struct.unpack_from(_HEAD, raw)
        at = struct.calcsize(_HEAD)
        bitmaps = []
        for n in (1 << self.left, self.slots, self.slots):
            bitmaps.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at), bitorder="little")[:n])
            at += -(-n // 8)
        self._occupied, self._ends, self._extension = bitmaps
        padded = np.zeros((self.slots, 8), np.uint8)
        padded[:, : self.width] = np.frombuffer(raw, np.uint8, self.slots * self.width, at).reshape(-1, self.width)
        self._value = padded.reshape(-1).view("<u8").astype(np.uint64)
        at += self.slots * self.width
        self._rest = tuple(np.frombuffer(raw, "<u8", self.n, at + 8 * self.n * k).astype(np.uint64) for k in range(self.more))

    def _counts(self, heads: np.ndarray, upto: int) -> np.ndarray:
        """The counts of the keys whose slots start at heads and end before the next, or before upto."""
        stops = np.append(heads[1:], upto)
        counts = np.ones(len(heads), np.uint64)
        k = 1
        while (has := np.flatnonzero(stops - heads > k)).size:
            counts[has] += self._value[heads[has] + k] << np.uint64(8 * self.width * (k - 1))
            k += 1
        return counts

    def entries(self) -> tuple[Keys, np.ndarray]:
        """All mapped keys in ascending order, and their counts."""
        heads = np.flatnonzero(self._extension == 0)
        run = np.cumsum(self._ends) - self._ends
        quotient = np.flatnonzero(self._occupied).astype(np.uint64)[run[heads]] if self.n else np.zeros(0, np.uint64)
        first = self._value[heads]
        if self.width < 8:
            first = first | (quotient << np.uint64(8 * self.width))
        return (first, *self._rest), self._counts(heads, self.slots)

    def count(self, key: int) -> int:
        """The count of one mapped key of one column: its quotient's run is found by rank and select, and its slots are looked through."""
        if self.more:
            raise ValueError("a key of several columns is found by entries()")
        quotient, remainder = key >> (8 * self.width), np.uint64(key & ((1 << (8 * self.width)) - 1))
        if quotient >= len(self._occupied) or not self._occupied[quotient]:
            return 0
        rank = int(self._occupied[:quotient].sum())
        ends = np.flatnonzero(self._ends)
        a, b = (int(ends[rank - 1]) + 1 if rank else 0), int(ends[rank]) + 1
        heads = a + np.flatnonzero(self._extension[a:b] == 0)
        at = np.flatnonzero(self._value[heads] == remainder)
        return int(self._counts(heads, b)[at[0]]) if len(at) else 0


def merged(filters: list[bytes]) -> tuple[Keys, np.ndarray]:
    """The entries of several filters of one kind, with the sums of their counts."""
    parts = [Filter(f).entries() for f in filters]
    return added(tuple(np.concatenate(k) for k in zip(*(p[0] for p in parts), strict=True)), np.concatenate([p[1] for p in parts]))


def by_range(keys: np.ndarray, bits: int, ranges: int) -> list[tuple[int, int, int]]:
    """(range, first, last) of ascending keys: where those with each value of their highest `ranges` bits stand."""
    top = keys >> np.uint64(bits - ranges) if ranges else np.zeros(len(keys), np.uint64)
    cuts = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1], [True]])) if len(keys) else []
    return [(int(top[a]), int(a), int(b)) for a, b in pairwise(cuts)]
