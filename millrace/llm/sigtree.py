"""Signature trees over token sets: exact overlap joins with pruning by bitmaps and sizes; numpy, one small block at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

LEAF, FAN = 8, 8


@dataclass
class Node:
    """Sets [first, last) in tree order; the OR of their bitmaps, their size range, most tokens that share a bit with another."""

    first: int
    last: int
    bits: np.ndarray
    least: int
    most: int
    excess: int
    children: list[Node]


class Forest:
    """Which sets are already linked, directly or through others."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def width_of(size: int) -> int:
    """Bits of a set's own bitmap: a power of two, about two for each token."""
    return 1 << max(8, min(16, int(2 * size - 1).bit_length()))


def bitmap(s: np.ndarray, width: int) -> np.ndarray:
    row = np.zeros(width, dtype=np.uint8)
    row[(s >> np.uint64(20)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(row).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of a smaller width: what falls on one bit there is OR-ed."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def size_classes(sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Sets by the width of their own bitmaps: (sets in order of size, how many of them have that width, the width).

    After a class's own sets stand those of wider classes that are small enough to be similar to one of them, so a pair is
    compared at the width of its smaller set and a few short sets don't blur the bitmaps of long ones.
    """
    order = np.argsort(sizes, kind="stable")
    widths = np.array([width_of(int(s)) for s in sizes[order]])
    for width in np.unique(widths):
        own = order[widths == width]
        upper = order[(widths > width) & (percent * sizes[order] <= 100 * sizes[own[-1]])]
        if len(own) + len(upper) > 1:
            yield np.concatenate([own, upper]), len(own), int(width)


def build(bits: np.ndarray, sizes: np.ndarray) -> Node:
    """A tree over sets in order of size, by their bitmaps of one width."""
    excess = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    n = len(sizes)
    level = [Node(i, j, np.bitwise_or.reduce(bits[i:j]), int(sizes[i]), int(sizes[j - 1]), int(excess[i:j].max()), []) for i in range(0, n, LEAF) for j in (min(i + LEAF, n),)]
    while len(level) > 1:
        groups = [level[i : i + FAN] for i in range(0, len(level), FAN)]
        level = [Node(g[0].first, g[-1].last, np.bitwise_or.reduce([x.bits for x in g]), g[0].least, g[-1].most, max(x.excess for x in g), g) for g in groups]
    return level[0]


def expand(x: Node, y: Node) -> Iterator[tuple[Node, Node]]:
    """The pairs of children of a pair of nodes; of a node with itself, each pair once."""
    if x is y:
        return ((x.children[i], x.children[j]) for i in range(len(x.children) - 1, -1, -1) for j in range(len(x.children) - 1, i - 1, -1))
    return ((p, q) for p in x.children or [x] for q in y.children or [y])


def may_link(x: Node, y: Node, percent: int) -> bool:
    """Whether any pair below can reach the Jaccard similarity: its overlap must be percent/(100+percent) of both sizes' sum."""
    if 100 * x.most < percent * y.least or 100 * y.most < percent * x.least:
        return False
    shared = int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.excess, y.excess)
    return min(shared, x.most, y.most) * (100 + percent) >= percent * (x.least + y.least)


def traverse(bits: np.ndarray, sizes: np.ndarray, percent: int, own: int, skip: Callable[[Node, Node], bool]) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """Leaf pairs of a tree with itself: (first, last, first, last, which of their pairs bitmaps and sizes don't rule out).

    Each pair of sets comes once, and none of two sets beyond the first `own`.  skip is asked for node pairs before they are opened.
    """
    excess = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    root = build(bits, sizes)
    stack = [(root, root)]
    while stack:
        x, y = stack.pop()
        if (x.first >= own and y.first >= own) or not may_link(x, y, percent) or skip(x, y):
            continue
        if x.children or y.children:
            stack.extend(expand(x, y))
            continue
        i, j = np.arange(x.first, x.last)[:, None], np.arange(y.first, y.last)[None, :]
        shared = np.bitwise_count(bits[x.first : x.last, None] & bits[None, y.first : y.last]).sum(axis=2).astype(np.int64) + np.minimum(excess[i], excess[j])
        near = np.minimum(shared, np.minimum(sizes[i], sizes[j])) * (100 + percent) >= percent * (sizes[i] + sizes[j])
        near &= (i < j) if x is y else True
        near &= np.minimum(i, j) < own
        if near.any():
            yield x.first, x.last, y.first, y.last, near


def partners(maps: list[np.ndarray], sizes: np.ndarray, percent: int, side: np.ndarray | None = None, label: np.ndarray | None = None) -> np.ndarray:
    """Which sets may have a similar one among the others, as far as bitmaps tell: on the other side, if sides are given, and
    of another label, if labels are.

    No set that has one is left out.
    """
    found = np.zeros(len(maps), dtype=bool)
    for order, own, width in size_classes(sizes, percent):
        bits = np.stack([folded(maps[i], width // 64) for i in order])
        done = found[order]
        for a, b, c, d, near in traverse(bits, sizes[order], percent, own, lambda x, y: done[x.first : x.last].all() and done[y.first : y.last].all()):
            for of in (side, label):
                if of is not None:
                    near &= of[order[a:b], None] != of[None, order[c:d]]
            done[a:b] |= near.any(axis=1)
            done[c:d] |= near.any(axis=0)
        found[order] |= done
    return found


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Elements two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def links(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, label: np.ndarray | None = None, spanning: bool = True) -> Iterator[tuple[int, int]]:
    """Pairs of sets with 100 * |intersection| >= percent * |union|, by dual traversals of one tree for each size class.

    spanning: only as many pairs as connect what is linked; pairs and node pairs that are connected already are passed over,
    and so are sets with one label, if labels are given.  side: if given, only pairs on different sides count.
    """
    known = Forest(len(sets))
    if label is not None and spanning:
        first: dict[int, int] = {}
        for i, x in enumerate(label.tolist()):
            known.join(i, first.setdefault(x, i))
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    for order, own, width in size_classes(sizes, percent):

        def connected(x: Node, y: Node, order: np.ndarray = order) -> bool:
            top = known.find(int(order[x.first]))
            return spanning and all(known.find(int(i)) == top for n in (x, y) for i in order[n.first : n.last])

        bits = np.stack([bitmap(sets[i], 2 * width) for i in order])
        for a, _, c, _, near in traverse(bits, sizes[order], percent, own, connected):
            for p, q in zip(*np.nonzero(near), strict=True):
                i, j = int(order[a + p]), int(order[c + q])
                if (side is not None and side[i] == side[j]) or (spanning and known.find(i) == known.find(j)):
                    continue
                both = overlap(sets[i], sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    known.join(i, j)
                    yield i, j
