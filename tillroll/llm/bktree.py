"""BK-trees over 64-bit fingerprints: the child edge of a node is the bit distance to it."""

from __future__ import annotations

import numpy as np

BITS = 64


class BKTree:
    """A tree of distinct fingerprints, kept as a table of children by distance.

    A search walks all its queries down the tree together. By the triangle inequality a query at distance d
    from a node can have partners only below the edges d - radius to d + radius.
    """

    def __init__(self, fingerprints: np.ndarray, radius: int):
        self.fingerprints = np.asarray(fingerprints, np.uint64)
        self.radius = radius
        # Edges are shifted by the radius, so that d - radius and d + radius are always columns.
        self.children = np.zeros((len(self.fingerprints), BITS + 2 * radius + 1), np.int32)
        for i, value in enumerate(self.fingerprints.tolist()):
            if i:
                self._insert(i, value)

    def _insert(self, i: int, value: int) -> None:
        values, children, node = self.fingerprints, self.children, 0
        while True:
            edge = (int(values[node]) ^ value).bit_count() + self.radius
            below = children[node, edge]
            if not below:
                children[node, edge] = i
                return
            node = below

    def search(self, queries: np.ndarray, at_once: int = 512):
        """Yield (query places, node places) of all pairs within the radius, a part at a time."""
        queries = np.asarray(queries, np.uint64)
        edges = np.arange(2 * self.radius + 1)
        if not len(self.fingerprints):
            return
        for start in range(0, len(queries), at_once):
            asked = np.arange(start, min(start + at_once, len(queries)))
            nodes = np.zeros(len(asked), np.int32)
            while len(asked):
                distance = np.bitwise_count(queries[asked] ^ self.fingerprints[nodes]).astype(np.int64)
                near = distance <= self.radius
                if near.any():
                    yield asked[near], nodes[near]
                below = self.children[nodes[:, None], distance[:, None] + edges]
                at, column = np.nonzero(below)
                asked, nodes = asked[at], below[at, column]
