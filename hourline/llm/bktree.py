"""BK-trees over fingerprints of one or more 64-bit words, queried by many fingerprints at a time.

Fingerprints are rows of a matrix of uint64 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A subtree of so many members or fewer is compared member by member.
LEAF = 64


def distances(ones: np.ndarray, twos: np.ndarray) -> np.ndarray:
    """Hamming distances along the last axis."""
    return np.bitwise_count(ones ^ twos).sum(axis=-1, dtype=np.int64)


class BkTree:
    """A pivot, and below it one child for each integer Hamming distance to the pivot."""

    def __init__(self, prints: np.ndarray, members: np.ndarray | None = None) -> None:
        self.members = np.arange(len(prints)) if members is None else members
        self.children: dict[int, BkTree] = {}
        if len(self.members) > LEAF:
            self.pivot = int(self.members[0])
            rest = self.members[1:]
            distance = distances(prints[rest], prints[self.pivot])
            order = np.argsort(distance, kind="stable")
            cuts = np.flatnonzero(np.diff(distance[order])) + 1
            for group in np.split(order, cuts):
                if len(group) < len(rest):
                    self.children[int(distance[group[0]])] = BkTree(prints, rest[group])
                else:  # all at one distance
                    self.children[int(distance[group[0]])] = _Leaf(rest[group])

    def near(self, prints: np.ndarray, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (of asked, of this tree) within the radius, following only edges that can hold some:
        a member at distance d from the pivot is at least |d - d(asked, pivot)| from the asked one."""
        if not self.children:
            yield from _compare(prints, asked, self.members, radius)
            return
        distance = distances(prints[asked], prints[self.pivot])
        hit = asked[distance <= radius]
        yield hit, np.full(len(hit), self.pivot)
        for edge, child in self.children.items():
            inside = asked[np.abs(distance - edge) <= radius]
            if len(inside):
                yield from child.near(prints, inside, radius)


class _Leaf(BkTree):
    def __init__(self, members: np.ndarray) -> None:
        self.members, self.children = members, {}


def _compare(prints: np.ndarray, asked: np.ndarray, members: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, (1 << 20) // max(1, prints[members].size))
    for k in range(0, len(asked), step):
        rows, columns = np.nonzero(distances(prints[asked[k : k + step], None], prints[None, members]) <= radius)
        yield asked[k + rows], members[columns]


def links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links between the fingerprints: (member, least member of its group)."""
    parent = np.arange(len(prints))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for ones, twos in BkTree(prints).near(prints, np.arange(len(prints)), radius):
        apart = parent[ones] != parent[twos]
        for a, b in zip(ones[apart].tolist(), twos[apart].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(len(prints))], dtype=np.int64)
    joined = np.flatnonzero(roots != np.arange(len(prints)))
    return joined, roots[joined]
