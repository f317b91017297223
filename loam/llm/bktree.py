"""Forests of BK-trees over 64-bit fingerprints, built and searched level by level in numpy.

In a BK-tree the children of a node are keyed by their integer Hamming distance to it, at most one
child for a distance. A search for all entries within ``radius`` of a query at distance ``d`` from a
node needs only the edges ``d - radius`` to ``d + radius``, by the triangle inequality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Forest:
    """One tree for each value of ``shard``. ``prints`` uint64, ``shard`` int64, of the same length."""

    def __init__(self, prints: np.ndarray, shard: np.ndarray):
        self.prints = prints
        n = len(prints)
        self.roots: dict[int, int] = {}
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.shards, group = np.unique(shard, return_inverse=True)
        self.root_of = np.zeros(len(self.shards), np.int64)
        left, top, key = np.arange(n), np.full(n, -1, np.int64), group.astype(np.int64)
        first = True
        while len(left):
            order = np.argsort(key, kind="stable")
            left, top, key = left[order], top[order], key[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            heads = left[starts]
            if first:
                self.root_of[key[starts]] = heads
                first = False
            else:
                parent[heads], edge[heads] = top[starts], key[starts] % 65
            above = np.repeat(heads, np.diff(np.r_[starts, len(left)]))
            rest = np.ones(len(left), bool)
            rest[starts] = False
            left, top = left[rest], above[rest]
            key = top * 65 + np.bitwise_count(prints[left] ^ prints[top])
        order = np.lexsort((edge, parent))
        order = order[parent[order] >= 0]
        self.child, self.edge = order, edge[order]
        self.begin = np.searchsorted(parent[order], np.arange(n + 1))

    def within(self, prints: np.ndarray, shard: np.ndarray, radius: int, block: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (index of query, index of entry) no more than ``radius`` apart, in blocks of queries."""
        at = np.searchsorted(self.shards, shard)
        known = at < len(self.shards)
        known[known] = self.shards[at[known]] == shard[known]
        asked = np.flatnonzero(known)
        for i in range(0, len(asked), block):
            query = asked[i : i + block]
            node = self.root_of[at[query]]
            while len(query):
                distance = np.bitwise_count(prints[query] ^ self.prints[node]).astype(np.int64)
                hit = distance <= radius
                if hit.any():
                    yield query[hit], node[hit]
                fan = self.begin[node + 1] - self.begin[node]
                query, distance, low = np.repeat(query, fan), np.repeat(distance, fan), np.repeat(self.begin[node], fan)
                place = low + np.arange(len(query)) - np.repeat(np.cumsum(fan) - fan, fan)
                follow = np.abs(self.edge[place] - distance) <= radius
                query, node = query[follow], self.child[place[follow]]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i] in ``label``, where the least index of a set names it."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]
