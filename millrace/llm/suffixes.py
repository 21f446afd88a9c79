"""Two-stage suffix sorting of many short byte strings at once, in numpy: one block of a Spark task's rows at a time.

Only suffixes that are smaller than their successors (type S) are sorted directly.  All others are induced: a scan of
the buckets (one per first byte) in order finds, before each suffix, the longer one that starts a byte earlier; if that is
greater than its successor (type L) it is next in its own bucket.  A bucket is scanned as a whole, not byte by byte.
"""

from __future__ import annotations

import numpy as np


def word_table(text: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)]).astype(np.uint64)
    n = len(text) + depth + 8
    out = padded[:n] << np.uint64(56)
    for k in range(1, 8):
        out |= padded[k : n + k] << np.uint64(56 - 8 * k)
    return out


def _masked(words: np.ndarray, depth: int, k: int) -> np.ndarray:
    """Word k of a key of `depth` bytes: what lies beyond the key is cleared."""
    left = 8 * (depth - 8 * k)
    return words if left >= 64 else words & ~np.uint64((1 << (64 - left)) - 1)


def sort_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of their first `depth` bytes, by refining what eight more bytes leave tied."""
    at = at[np.argsort(words[at], kind="stable")]
    first = words[at]
    same = np.flatnonzero(first[1:] == first[:-1])
    for k in range(1, -(-depth // 8)):
        if not len(same):
            break
        tied = np.zeros(len(at), dtype=bool)
        tied[same] = tied[same + 1] = True
        where = np.flatnonzero(tied)
        new = np.ones(len(where), dtype=bool)
        new[1:] = (np.diff(where) > 1) | ~np.isin(where[1:] - 1, same, assume_unique=True)
        group = np.cumsum(new)
        key = _masked(words[at[where] + 8 * k], depth, k)
        order = np.lexsort((key, group))
        at[where] = at[where[order]]
        group, key = group[order], key[order]
        equal = (group[1:] == group[:-1]) & (key[1:] == key[:-1])
        same = where[:-1][equal]
    return at


def sort_suffixes(text: np.ndarray, begin: np.ndarray, need: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes that start in [begin, need) of each string [begin, end), by their first `depth` bytes at least.

    Strings lie end to end in text.  Returns the positions in order, and the word table.
    """
    n = len(text)
    words = word_table(text, depth)
    last = np.zeros(n + 1, dtype=bool)
    last[end - 1] = True
    # Type S: the first differing pair after a run of equal bytes rises.  A string's end is below every byte.
    differs = np.ones(n, dtype=bool)
    differs[:-1] = text[:-1] != text[1:]
    differs |= last[:n]
    rises = np.zeros(n, dtype=bool)
    rises[:-1] = text[:-1] < text[1:]
    rises &= ~last[:n]
    stop = np.flatnonzero(differs)
    small = rises[stop[np.searchsorted(stop, np.arange(n))]]
    # What is needed reaches up to the first S from the last needed start on, or up to the string's end.
    at_s = np.append(np.flatnonzero(small), n)
    upto = np.minimum(at_s[np.searchsorted(at_s, need - 1)], end)
    wanted = np.zeros(n + 1, dtype=np.int32)
    np.add.at(wanted, begin, 1)
    np.add.at(wanted, np.minimum(upto + 1, end), -1)
    wanted = np.cumsum(wanted[:n]) > 0
    large = wanted & ~small
    direct = sort_directly(words, np.flatnonzero(wanted & small), depth)
    heads = text[direct]
    edges = np.searchsorted(heads, np.arange(257))

    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(found: np.ndarray, own: int) -> np.ndarray:
        """Deal the L suffixes before `found` to their buckets; those of bucket `own` come back."""
        before = found - 1
        before = before[(before >= 0) & large[before]]
        before = before[~last[before]] if own >= 0 else before
        heads = text[before]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        cuts = np.flatnonzero(heads[1:] != heads[:-1]) + 1
        mine = before[:0]
        for part in np.split(before, cuts) if len(before) else ():
            if (c := text[part[0]]) == own:
                mine = part
            else:
                waiting[c].append(part)
        return mine

    induce(upto[upto == end], -1)
    out = []
    for c in range(256):
        found = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        while len(found):
            out.append(found)
            found = induce(found, c)
        found = direct[edges[c] : edges[c + 1]]
        if len(found):
            out.append(found)
            induce(found, c)
    starts = np.zeros(n + 1, dtype=np.int32)
    np.add.at(starts, begin, 1)
    np.add.at(starts, need, -1)
    asked = np.cumsum(starts[:n]) > 0
    order = np.concatenate(out) if out else direct
    return order[asked[order]], words


def same_as_before(order: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """For each sorted suffix but the first: whether it shares `depth` bytes with the one before."""
    pairs = np.arange(1, len(order))
    for k in range(-(-depth // 8)):
        x = _masked(words[order[pairs] + 8 * k], depth, k)
        y = _masked(words[order[pairs - 1] + 8 * k], depth, k)
        pairs = pairs[x == y]
    out = np.zeros(max(0, len(order) - 1), dtype=bool)
    out[pairs - 1] = True
    return out
