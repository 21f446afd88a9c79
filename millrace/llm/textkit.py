"""Array helpers shared by the text operators; they run inside Spark tasks on one slice of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Most text bytes that one numpy pass looks at; bounds a worker's memory whatever the Arrow batch holds.
SLICE_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15 & ~7 | 5)  # odd, 5 mod 8: powers keep a long period
_tables = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _tables.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << int(n - 1).bit_length()
        inverse = pow(int(_MULT), -1, 2**64)
        for base, name in ((_MULT, "_powers"), (np.uint64(inverse), "_inverses")):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows: (first row, row after the last, bytes, row offsets in them).

    A null counts as the empty text.  A run holds `most` bytes, or one longer text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + most, side="right")) - 1)
        last = min(last, n)
        yield first, last, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


#: Bytes of a word, and of a term: letters, digits and all beyond ASCII.
WORD = ~_SPACE
TERM = np.zeros(256, dtype=bool)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, offs: np.ndarray, lower: bool = True, of: np.ndarray = WORD, upto: int = 0, table: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ (or runs of the bytes in `of`) of each row: (64-bit hash of each word, its row's word range as offsets, word byte starts).

    Words never run from a row into the next.  upto: only that many first bytes of each word are hashed.  table: the
    bytes' values, another hash function for each.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), np.zeros(0, np.int64)
    solid = of[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    edges = offs[1:-1]
    edges = edges[edges < n]
    starts[edges] = solid[edges]
    begin = np.flatnonzero(starts)
    ends = np.zeros(n + 1, dtype=bool)
    ends[1:] = solid
    ends[1:n] &= ~solid[1:] | starts[1:]
    end = np.flatnonzero(ends)
    if upto:
        end = np.minimum(end, begin + upto)
    up, down = powers(n + 1)
    values = table[_LOWER[data]] if lower else table[data]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    hashes = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return hashes, np.searchsorted(begin, offs), begin


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def per_slice(texts: pa.Array, most: int = SLICE_BYTES):
    """`slices` with the words of each run of rows: (first, last, word hashes, word offsets by row)."""
    for first, last, data, offs in slices(texts, most):
        hashes, at, _ = words(data, offs)
        yield first, last, hashes, at
