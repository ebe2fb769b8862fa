"""Signature trees over sets, and the links that a dual traversal of two of them finds.

A leaf holds a set's token bitmap and size. A node above holds the OR of its children's bitmaps and the range of their
sizes. Two nodes can hide a link only if some sizes of theirs are near enough and the bits that both have leave room for
the overlap that these sizes need; other node pairs are cut off with all that is below them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 8
MOST_BITS = 1 << 14  # of a bitmap that travels
PAIRS = 1 << 16  # node pairs looked at together


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The tokens' marks in so many bits (a power of two, at least 64)."""
    line = np.zeros(bits, bool)
    line[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(line).view(np.uint64)


def width_for(size: int) -> int:
    """Bits of a set's own bitmap: twice its size or more, up to MOST_BITS; sizes within a factor of two differ by one step."""
    return int(min(MOST_BITS, max(64, 1 << (2 * size - 1).bit_length())))


def fold(maps: np.ndarray) -> np.ndarray:
    """The same sets' bitmaps in half the bits: a token's bit is its hash modulo the width."""
    half = maps.shape[1] // 2
    return maps[:, :half] | maps[:, half:]


class SignatureTree:
    def __init__(self, maps: np.ndarray, sizes: np.ndarray, order: np.ndarray):
        """maps: a bitmap of 64-bit words for each leaf; order: the set number of each leaf."""
        self.order = order
        full = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        #: Level by level from the leaves: bitmap, least and largest size, most tokens beyond the set bits of one leaf.
        self.levels = [(maps, sizes, sizes, sizes - full)]
        while len(maps) > FANOUT:
            cuts = np.arange(0, len(maps), FANOUT)
            _, low, high, slack = self.levels[-1]
            maps = np.bitwise_or.reduceat(maps, cuts, axis=0)
            self.levels.append((maps, np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(slack, cuts)))

    @classmethod
    def of_sets(cls, sets: list[np.ndarray], bits: int) -> SignatureTree:
        """Sets must be sorted hash arrays, none empty. Leaves are ordered by least hash, which brings alike sets together."""
        order = np.array(sorted(range(len(sets)), key=lambda k: (int(sets[k][0]), len(sets[k]))), np.int64)
        return cls(np.stack([bitmap(sets[k], bits) for k in order]), np.array([len(sets[k]) for k in order], np.int64), order)

    def owners(self, label: np.ndarray) -> list[np.ndarray]:
        """Level by level the label that all leaves of a node share, or -1."""
        out = [label[self.order]]
        for _ in self.levels[1:]:
            cuts = np.arange(0, len(out[-1]), FANOUT)
            low, high = np.minimum.reduceat(out[-1], cuts), np.maximum.reduceat(out[-1], cuts)
            out.append(np.where(low == high, low, -1))
        return out


def possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, need: int) -> np.ndarray:
    """Which node pairs can hold sets with 100 * intersection >= need * union."""
    (maps_a, low_a, high_a, slack_a), (maps_b, low_b, high_b, slack_b) = a, b
    keep = (100 * high_a[i] >= need * low_b[j]) & (100 * high_b[j] >= need * low_a[i])
    i, j = i[keep], j[keep]
    common = np.bitwise_count(maps_a[i] & maps_b[j]).sum(axis=1, dtype=np.int64)
    most = np.minimum(common + np.minimum(slack_a[i], slack_b[j]), np.minimum(high_a[i], high_b[j]))
    keep[keep] = (100 + need) * most >= need * (low_a[i] + low_b[j])
    return keep


def leaf_pairs(a: SignatureTree, b: SignatureTree, need: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal: pairs of set numbers that may be linked and don't have one label yet. a may be b, else as deep."""
    top = len(a.levels) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[top][0])), np.arange(len(b.levels[top][0])), indexing="ij"))
    if a is b:
        i, j = i[i <= j], j[i <= j]
    stack = [(top, i, j)]
    while stack:
        level, i, j = stack.pop()
        if len(i) > PAIRS:
            stack.append((level, i[PAIRS:], j[PAIRS:]))
            i, j = i[:PAIRS], j[:PAIRS]
        own_a, own_b = a.owners(label)[level], b.owners(label)[level]
        open_ = (own_a[i] != own_b[j]) | (own_a[i] < 0)
        i, j = i[open_], j[open_]
        keep = possible(a.levels[level], i, b.levels[level], j, need)
        i, j = i[keep], j[keep]
        if not level:
            if len(i):
                yield a.order[i], b.order[j]
            continue
        below_a, below_b = len(a.levels[level - 1][0]), len(b.levels[level - 1][0])
        step = np.arange(FANOUT)
        ci = np.broadcast_to((i[:, None] * FANOUT + step)[:, :, None], (len(i), FANOUT, FANOUT)).ravel()
        cj = np.broadcast_to((j[:, None] * FANOUT + step)[:, None, :], (len(j), FANOUT, FANOUT)).ravel()
        inside = (ci < below_a) & (cj < below_b) & ((ci <= cj) if a is b else True)
        stack.append((level - 1, ci[inside], cj[inside]))


def linked(x: np.ndarray, y: np.ndarray, need: int) -> bool:
    """100 * intersection >= need * union, exactly."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < need * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= need * (len(x) + len(y) - both)


def link(sets: list[np.ndarray], need: int, side: np.ndarray | None = None) -> np.ndarray:
    """The class of each set under links: every set against every other, or those of one side against the other's.

    Pairs in one class already are not tried again, so a group of alike sets costs about one comparison a set.
    """
    label = np.arange(len(sets))
    longest = max(map(len, sets))
    bits = int(min(1 << 16, max(256, 1 << (4 * longest - 1).bit_length())))
    groups = [np.arange(len(sets))] if side is None else [np.flatnonzero(~side), np.flatnonzero(side)]
    if any(len(g) == 0 for g in groups):
        return label
    trees = []
    for g in groups:
        tree = SignatureTree.of_sets([sets[k] for k in g], bits)
        tree.order = g[tree.order]
        trees.append(tree)
    a, b = level_out(trees[0], trees[-1])

    def try_all(i: np.ndarray, j: np.ndarray) -> None:
        size = 32
        while len(i):
            for x, y in zip(i[:size].tolist(), j[:size].tolist(), strict=True):
                if label[x] != label[y] and linked(sets[x], sets[y], need):
                    old, new = max(label[x], label[y]), min(label[x], label[y])
                    label[label == old] = new
            i, j = i[size:], j[size:]
            open_ = label[i] != label[j]
            i, j, size = i[open_], j[open_], min(4096, 2 * size)

    if a is b:
        try_all(a.order[:-1], a.order[1:])
    for i, j in leaf_pairs(a, b, need, label):
        open_ = label[i] != label[j]
        try_all(i[open_], j[open_])
    return label


def level_out(a: SignatureTree, b: SignatureTree) -> tuple[SignatureTree, SignatureTree]:
    """Make both as deep: the shorter gets a chain of single nodes on top."""
    depth = max(len(a.levels), len(b.levels))
    for tree in (a, b):
        while len(tree.levels) < depth:
            maps, low, high, slack = tree.levels[-1]
            zero = np.zeros(1, np.int64)
            tree.levels.append((np.bitwise_or.reduceat(maps, zero, axis=0), np.minimum.reduceat(low, zero), np.maximum.reduceat(high, zero), np.maximum.reduceat(slack, zero)))
    return a, b


def may_link(maps: list[np.ndarray], sizes: np.ndarray, need: int) -> np.ndarray:
    """Classes of sets that bitmaps (each of width_for its size) can't rule out to be linked, by trees of one width.

    Linked sizes are within a factor of two, so only equal and neighbouring widths meet, the wider ones folded.
    """
    label = np.arange(len(maps))
    widths = np.array([len(m) for m in maps])
    trees: dict[int, SignatureTree] = {}
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        own = own[np.lexsort((sizes[own], [int(maps[k][0]) for k in own]))]
        trees[width] = tree = SignatureTree(np.stack([maps[k] for k in own]), sizes[own], own)
        meet = [(tree, tree)]
        if width // 2 in trees:
            meet.append(level_out(trees[width // 2], SignatureTree(fold(tree.levels[0][0]), sizes[own], own)))
        for a, b in meet:
            for i, j in leaf_pairs(a, b, need, label):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if label[x] != label[y]:
                        label[label == max(label[x], label[y])] = min(label[x], label[y])
    return label
